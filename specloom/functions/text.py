"""Column functions: cleaning, trimming, tokenising, numbers, chunk splitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom.functions import patterns as P


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included. A run inside is tried from its first character alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s(?<!\s\s)\s*+\z", "")


def clean(c: Column, dialect: P.Dialect = P.WORKSHOP) -> Column:
    """Raw document text without stamps, controls and typographic variants. The order matters."""
    sub = lambda t, p, r="": F.regexp_replace(t, P.java(p), r)
    c = sub(c, P.CONTROL)
    if dialect is P.WORKSHOP:
        c = sub(sub(sub(c, P.FILE_URL), P.PAGE_STAMP), P.REVISION_DATE)
        c = sub(c, P.SECTION_DATE, "$1\n")
    else:
        c = sub(c, P.ANY_URL)
    c = sub(sub(c, P.MANY_SPACES, " "), P.MANY_LINES, "\n\n\n")
    c = F.translate(c, "’‘“”", "''\"\"")
    c = F.translate(c, "–", "—") if dialect is P.WORKSHOP else F.translate(c, "–—", "--")
    return strip(c)


def retention(raw: Column, cleaned: Column) -> Column:
    """Percent of the raw characters that cleaning keeps."""
    return F.when(F.length(raw) > 0, F.round(100.0 * F.length(cleaned) / F.length(raw), 1)).otherwise(F.lit(0.0))


def error_text(c: Column) -> Column:
    """A message fit for a response: no controls but line feed and tab, 600 characters."""
    return F.btrim(F.substring(F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", ""), 1, 600), F.lit(" \t\n"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(P.TOKEN), F.lit(0))


def has(c: Column, pattern: str) -> Column:
    return c.rlike(P.java(pattern))


def part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, P.java(pattern), group)


def parts(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(P.java(pattern)), F.lit(group))


def number(c: Column, dialect: P.Dialect = P.WORKSHOP) -> Column:
    """A table cell as a double: the lower end of a range; null for dashes, N/A and what is no number."""
    s = strip(c)
    s = F.replace(s, F.lit(","), F.lit("")) if dialect is P.GENERIC else s
    low = F.coalesce(F.nullif(part(s, dialect.range, 1), F.lit("")), s)
    return F.when(low.rlike(r"^[\d.]+$"), low.try_cast("double"))


def comma_number(c: Column) -> Column:
    """A number with thousands commas; null if it is none."""
    s = F.replace(strip(c), F.lit(","), F.lit(""))
    return F.when(s.rlike(r"^[\d.]+$"), s.try_cast("double"))


def guess_component(context: Column, dialect: P.Dialect = P.WORKSHOP) -> Column:
    """The words before 'to <number> Nm', unless they begin with a verb of work; '' if none."""
    c = F.regexp_replace(strip(context), P.java(dialect.line_mark), "")
    found = strip(part(c, dialect.before_to, 1))
    return F.when(has(found, dialect.verb_first), F.lit("")).otherwise(F.substring(found, 1, 80))


def section_variants(name: Column) -> Column:
    two = F.when(name.contains("RWD") | name.contains("Rear Wheel"), F.lit("RWD"))
    four = F.when(name.contains("4WD") | name.contains("Four Wheel"), F.lit("4WD"))
    return F.array_compact(F.array(two, four))


def line_variants(line: Column) -> Column:
    low = F.lower(line)
    found = [F.when(low.contains(k), F.lit(v)) for k, v in (("svt raptor", "SVT Raptor"), ("rwd", "RWD"), ("4wd", "4WD"), ("all model", "All"))]
    return F.array_compact(F.array(*found))


def no_variants() -> Column:
    return F.array().cast("array<string>")


# ---- splitting long procedures into chunks ----

MOST, OVERLAP = 400, 60


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once for each row, however often ``use`` and its lambdas name it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def pack_sentences(c: Column, most: int = MOST) -> Column:
    """Sentences joined by a space while the sum of both lengths is under ``most``.

    One pass of a pattern from piece to piece, as an aggregate would copy all that is done at each sentence:
    as many whole sentences as fit, else one. White space counts in its sentence's length; it goes from the
    ends of what fits and stays on a sentence that doesn't.
    """
    end = r"(?:\z|(?<=[.!?])(?= ))"
    piece = rf"(?sU)(.{{1,{most}}}{end}|.+?{end}) ?"

    def pieces(text: Column) -> Column:
        first = F.regexp_replace(text, rf"(?sU)\A(?=.{{1,{most - 1}}}?{end})\s+", "")
        found = F.regexp_extract_all(F.when(F.length(text) < most, strip(text)).otherwise(first), F.lit(piece), F.lit(1))
        return F.transform(found, lambda p: F.when(p.rlike("[.!?] "), strip(p)).otherwise(p))

    spaced = F.regexp_replace(F.regexp_replace(c, r"(?U)(?<=[.!?])\s+", " "), r"(?<=[.!?]) \z", "")
    return bound(bound(spaced, pieces), lambda ps: F.when(F.size(ps) > 0, ps).otherwise(F.array(c)))


def step_parts(c: Column) -> Column:
    """Cut before each numbered step."""
    cut = F.transform(F.split(c, r"(?U)(?=\b\d{1,2}\.\s+\S)"), strip)
    return F.filter(cut, lambda x: x != "")


def overlapped(pieces: Column, overlap: int = OVERLAP) -> Column:
    """Each piece after the last characters of the one before it."""
    return bound(pieces, lambda ps: F.transform(ps, lambda p, i: strip(F.when(i > 0, F.concat(F.right(F.get(ps, i - 1), F.lit(overlap)), F.lit(" "), p)).otherwise(p))))


def hard_split(c: Column, most: int = MOST) -> Column:
    """Pieces of at most ``most`` characters, cut at the last space before it if there is one.

    One pass of a pattern from piece to piece: what is left if it fits, else up to the last space
    within reach, else as many characters as fit. White space around pieces goes.
    """
    piece = rf"(?sU)(?:\A|\s*)(.{{1,{most}}}\z|.{{0,{most - 1}}}(?= )|.{{{most}}})"
    bare = F.concat(F.regexp_extract(c, r"(?U)\A\s*", 0), strip(c))  # the first piece's reach counts white space before the text
    cut = F.transform(F.regexp_extract_all(bare, F.lit(piece), F.lit(1)), strip)
    return F.when(F.length(c) <= most, F.array(c)).otherwise(F.filter(cut, lambda x: x != ""))


def procedure_chunks(c: Column, most: int = MOST) -> Column:
    """A procedure's text as chunks: whole if short, else by steps, else by sentences; with overlap; hard-cut last."""

    def kept(steps: Column) -> Column:
        longest = F.coalesce(F.array_max(F.transform(steps, F.length)), F.lit(0))
        return F.when((F.size(steps) <= 1) | (longest > 2 * most), pack_sentences(c, most)).otherwise(steps)

    pieces = bound(step_parts(c), kept)
    cut = F.flatten(F.transform(overlapped(pieces), lambda p: hard_split(p, most)))
    return F.when(F.length(c) <= most, F.array(c)).otherwise(cut)
