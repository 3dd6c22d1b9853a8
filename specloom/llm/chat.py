"""Chat formatting with a grammar round trip, in DataFrame expressions only.

A conversation is rendered turn by turn::

    <s>[INST]role<newline>text[/INST]</s>

``parse`` reads this grammar deterministically: turns end at ``[/INST]</s>``, the role ends at
the first newline and is percent-encoded, and in the text each control string with
backslashes after its first character loses one.  ``render`` tries the texts as they are,
parses the result and compares the turns with the source; if they differ it renders with
the conflicting control strings escaped (one more backslash each) and compares again; a
conversation that still differs stops the query.  Escaping changes nothing else, and
undoing it restores every text.

Turns are ordered by turn (null first), ties by role, then text; repeated rows are turns of
their own. Null texts and roles are empty. Rows with a null conv_id are one conversation.
No rows: no conversations. Other columns are not read. A conversation is one string,
so it is one row in one task, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>[INST]", "[/INST]</s>"
# fixed values: what counts as a control string, with the backslashes of earlier escapes
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])(\\*)\\(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def render_turns(turns: Column, prepare) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n"), prepare(t["text"]), F.lit(CLOSE))), "")


def _parts(formatted: Column) -> Column:
    """What stands between the turns' ends."""
    return F.filter(F.split(formatted, r"\[/INST\]</s>"), lambda x: x != "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: null roles and texts where the grammar is not met."""

    def turn(part: Column) -> Column:
        head = F.instr(part, "\n")
        good = part.startswith(OPEN) & (head > 0)
        return F.struct(
            F.when(good, F.try_url_decode(F.substring(part, F.lit(len(OPEN) + 1), head - 1 - len(OPEN)))).alias("role"),
            F.when(good, unescape(F.substring(part, head + 1, F.length(part)))).alias("text"),
        )

    return F.transform(_parts(formatted), turn)


def _same(parsed: Column, turns: Column) -> Column:
    source = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(F.to_json(parsed) == F.to_json(source), F.lit(False)) & (F.size(parsed) == F.size(source))


def loss_spans(formatted: Column, trained: str = "assistant") -> Column:
    """array<struct<start, stop>>: code points of the texts of ``trained`` turns inside ``formatted``."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        head = acc["at"] + F.instr(part, "\n")
        end = acc["at"] + F.length(part)
        mine = F.substring(part, F.lit(len(OPEN) + 1), F.instr(part, "\n") - 1 - len(OPEN)) == trained
        spans = F.when(mine, F.concat(acc["spans"], F.array(F.struct(head.cast("long").alias("start"), end.cast("long").alias("stop"))))).otherwise(acc["spans"])
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(_parts(formatted), zero, step)["spans"]


def render(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans, escaped (whether any text had to be) for each conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    tried = whole.withColumn("plain", render_turns(F.col("turns"), lambda x: x)).withColumn("clean", render_turns(F.col("turns"), escape))
    formatted = F.when(_same(parse(F.col("plain")), F.col("turns")), F.struct(F.col("plain").alias("text"), F.lit(False).alias("escaped"))).when(
        _same(parse(F.col("clean")), F.col("turns")), F.struct(F.col("clean").alias("text"), F.lit(True).alias("escaped"))
    )
    out = tried.select("conv_id", F.coalesce(formatted, F.raise_error(F.lit("a conversation does not survive its round trip"))).alias("f"))
    return out.select("conv_id", F.col("f.text").alias("formatted"), loss_spans(F.col("f.text"), trained).alias("loss_spans"), F.col("f.escaped").alias("escaped"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, escaped: from the rendered text and mask alone."""
    turns = parse(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = rendered.withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )
