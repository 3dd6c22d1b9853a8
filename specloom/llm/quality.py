"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule rejects a text by one condition.  ``plan`` estimates on a sample what each rule
costs and which texts it rejects, and puts first the rule with the most rejections per
cost, then again among the texts that are left, and so on; ``verdict`` evaluates the rules
in that order and stops at the first that rejects.  The order changes the work, never
which texts are kept.

A rule's cost is what it adds to an empty pass over the sample: the least of several passes,
each of which evaluates the rule many times in one task, so that a job's start does not
count, rounded to a power of four, so that small differences decide nothing.  What all rules
share, a text's words and their characters, is computed once and is no rule's cost.

Words are ``[^\\x20\\x09-\\x0D]+``. Null texts are empty texts: no words, rejected for that.
Ties in the order go by cost, then by rule name. Repeated rows are judged each; an empty table
gives the rules' own order and no rows. Columns other than the text pass through untouched,
whatever their names. Repeated 8-word windows are found by 64-bit hashes in one text.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm._common import discard, materialise

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str | Column) -> Column:
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def words(t: Column) -> Column:
    return F.array_remove(F.split(F.translate(t, BLANKS, " " * len(BLANKS)), " "), "")


def n_words(w: Column) -> Column:
    return F.size(w).cast("long")


def word_chars(t: Column) -> Column:
    return F.length(F.translate(t, " " + BLANKS, "")).cast("long")


def n_symbols(t: Column) -> Column:
    return (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")


def lines(t: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " " + BLANKS, "")) > 0)


def n_lines(t: Column) -> Column:
    return F.size(lines(t)).cast("long")


def n_dup_lines(t: Column) -> Column:
    return let(lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(w: Column, n: int = WINDOW) -> Column:
    """Of these words those covered by windows of ``n`` words that stand twice or more."""

    def covered(hashes: Column) -> Column:
        numbered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(numbered, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())))
        steps = let(twice, lambda p: F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1), x + n) - x)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(ids: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ids) - (n - 1)), lambda i: F.xxhash64(F.slice(ids, i, n)))

    def of(ids: Column) -> Column:
        found = let(windows(ids), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(ids) > n, found).otherwise(F.lit(0).cast("long"))

    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def n_upper(t: Column) -> Column:
    """Characters that lower-casing changes, ASCII and Latin-1 letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
    return (F.length(t) - F.length(F.translate(t, upper, ""))).cast("long")


def n_stutter(w: Column) -> Column:
    """Words equal to the word before them."""
    return F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long")


#: Measures of a text, and of its words.
OF_TEXT: dict[str, Callable[[Column], Column]] = {"word_chars": word_chars, "n_symbols": n_symbols, "n_lines": n_lines, "n_dup_lines": n_dup_lines, "n_upper": n_upper}
OF_WORDS: dict[str, Callable[[Column], Column]] = {"n_words": n_words, "n_repeat_words": n_repeat_words, "n_stutter": n_stutter}
SHARED = ("n_words", "word_chars")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the measures by name, each a column that is evaluated only if the rule is."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 25 * m("n_words")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 20 * m("n_words")),
    Rule("repeated_lines", lambda m: (m("n_dup_lines") >= 3) & (100 * m("n_dup_lines") > 30 * m("n_lines"))),
    Rule("stutter", lambda m: 100 * m("n_stutter") > 20 * m("n_words")),
    Rule("capitals", lambda m: 100 * m("n_upper") > 30 * m("word_chars")),
)
BASE = ("few_words", "repeated_words")


Measured = Callable[[str], Column]


def measured(t: Column, w: Column, known: dict[str, Column] | None = None) -> Measured:
    """Measures by name of a text and its words; those in ``known`` are at hand already."""
    at_hand = known or {}
    return lambda name: at_hand[name] if name in at_hand else OF_WORDS[name](w) if name in OF_WORDS else OF_TEXT[name](t)


@dataclass(frozen=True)
class Estimate:
    """``rejected``: of the texts that the rules before have left, the share that this one rejects. ``cost``: seconds a text, a power of four."""

    rule: Rule
    rejected: float
    cost: float


def _seconds(sample: DataFrame, value: Column, copies: int, passes: int) -> float:
    """The least time of several passes that evaluate ``value`` ``copies`` times for each row."""
    rows = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    least = math.inf
    for k in range(passes):
        began = time.perf_counter()
        rows.agg(F.sum(F.when(value, 1).otherwise(0))).first()
        least = min(least, time.perf_counter() - began)
        if k and least > 1:  # long enough that the rest does not matter; the first pass may have compiled code
            break
    return least


def in_order(rules: tuple[Rule, ...], costs: list[float], seen: dict[int, int]) -> list[Estimate]:
    """Rules by rejections per cost among the texts that those before have left. ``seen``: how many texts
    each set of rules rejects, a set being a number with a bit for each rule."""
    left, out = dict(enumerate(rules)), []
    while left:
        total = sum(seen.values())
        share = {k: sum(n for mask, n in seen.items() if mask >> k & 1) / total if total else 0.0 for k in left}
        k = min(left, key=lambda k: (-share[k] / costs[k], costs[k], left[k].name))
        out.append(Estimate(left.pop(k), share[k], costs[k]))
        seen = {mask: n for mask, n in seen.items() if not mask >> k & 1}
    return out


def plan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7, copies: int = 4, passes: int = 4) -> list[Estimate]:
    """The rules in the order of the cascade, as estimated on a sample of about ``sample_rows`` texts."""
    n = docs.count()
    if not n:
        return [Estimate(r, 0.0, 0.0) for r in rules]
    drawn = docs.select(text_of(text).alias("text")).sample(fraction=min(1.0, sample_rows / n), seed=seed)
    split = drawn.repartition(1).withColumn("words", words(F.col("text")))  # one task times a rule
    sample = materialise(split.withColumns({name: measured(F.col("text"), F.col("words"))(name) for name in SHARED}), "rule-sample")
    m = measured(F.col("text"), F.col("words"), {name: F.col(name) for name in SHARED})
    mask = sum((F.when(r.rejects(m), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)), F.lit(0).cast("long"))
    seen = {r["mask"]: r["n"] for r in sample.groupBy(mask.alias("mask")).agg(F.count("*").alias("n")).collect()}  # of the sample: bounded by it
    rows = max(1, sum(seen.values())) * copies
    # reads all columns, as the rules do
    empty = _seconds(sample, F.length("text") + F.size("words") + F.col("n_words") + F.col("word_chars") < 0, copies, passes)
    costs = [max(_seconds(sample, r.rejects(m), copies, passes) - empty, 0.0) / rows for r in rules]
    discard(sample)
    return in_order(rules, [4.0 ** max(-10, round(math.log(max(c, 1e-9), 4))) for c in costs], seen)


def verdict(order: list[Estimate], m: Measured) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated."""
    chain = None
    for e in order:
        step = (e.rule.rejects(m), F.lit(e.rule.name))
        chain = F.when(*step) if chain is None else chain.when(*step)
    return chain if chain is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, order: list[Estimate] | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and rejected_by (null: kept) for each row."""
    order = order or plan(docs)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    m = measured(F.col("_text"), F.col("_words"))
    t = docs.select("doc_id", text_of("text").alias("_text")).withColumn("_words", words(F.col("_text")))
    out = t.select("doc_id", "_text", "_words", *(m(name).alias(name) for name in base))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    by = verdict([e for e in order if e.rule.name not in BASE], measured(F.col("_text"), F.col("_words"), {name: F.col(name) for name in base}))
    return out.withColumn("base_failed", failed).withColumn("rejected_by", F.when(failed, F.lit("base")).otherwise(by)).select("doc_id", *base, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def keep(docs: DataFrame, text: str = "text", order: list[Estimate] | None = None) -> DataFrame:
    """The rows that no rule rejects, all columns as they are."""
    order, t = order or plan(docs, text), text_of(text)

    def of(w: Column) -> Column:
        shared = F.struct(n_words(w).alias("n_words"), word_chars(t).alias("word_chars"))
        return let(shared, lambda s: verdict(order, measured(t, w, {name: s[name] for name in SHARED})))

    return docs.filter(let(words(t), of).isNull())
