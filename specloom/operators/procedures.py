"""Procedure blocks (gaps and islands over typed lines) and paragraph fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.functions.text import has, strip
from specloom.operators.specs import SEGMENT_COLUMNS, segment
from specloom.operators.structure import running


def blocks(lines: DataFrame) -> DataFrame:
    """One segment for each block of steps, notices and the general lines that follow them.

    Headers end a run; general lines before a run's first step or notice are dropped; a
    numbered step opens a block if something is gathered. Every block of a run carries the
    line, page and section of the run's first step or notice.
    """
    kind = F.col("content_type")
    anchor = kind.isin("procedure_step", "warning_notice")
    reset = ~(anchor | (kind == "general_text"))
    marked = lines.withColumn("_run", F.sum(reset.cast("int")).over(running())).filter(~reset).withColumn("_anchor", anchor)
    upto = Window.partitionBy("doc_id", "_run").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = marked.withColumn("_active", F.max("_anchor").over(upto)).filter("_active")
    before = Window.partitionBy("doc_id", "_run").orderBy("idx")
    opens = has(F.col("text"), P.STEP) & F.col("_anchor") & F.lag("idx").over(before).isNotNull()
    numbered = active.withColumn("_block", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(upto))
    first = {n: F.first(n).over(upto).alias(f"_{n}") for n in ("idx", "page_number", "section_id", "section_name", "subsection_type")}
    rows = numbered.select("doc_id", "_run", "_block", "idx", "text", *first.values())
    grouped = rows.groupBy("doc_id", "_run", "_block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.min("idx").alias("place"),
        *(F.min(f"_{n}").alias(n) for n in first),
    )
    return grouped.select(*segment("procedure_step", text=F.col("text"), is_safety_critical=has(F.upper("text"), "WARNING|NOTICE|CAUTION"), confidence=F.lit(1.0), place=F.col("place")))


def paragraphs(docs: DataFrame, dialect: P.Dialect = P.WORKSHOP) -> DataFrame:
    """Paragraphs of (doc_id, text) as segments. Workshop numbers what is left without blanks, generic before that."""
    cut = F.transform(F.split("text", r"(?U)\n\s*\n"), strip)
    numbered = F.transform(cut, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    numbered = F.filter(numbered, lambda x: x["t"] != "")
    if dialect is P.WORKSHOP:
        numbered = F.transform(numbered, lambda x, i: F.struct(i.alias("i"), x["t"].alias("t")))
    rows = docs.select("doc_id", F.explode(F.slice(numbered, 1, dialect.paragraphs)).alias("p")).select("doc_id", F.col("p.i").alias("idx"), F.col("p.t").alias("text"))
    return rows.select(*segment("procedure_step", text=F.col("text"), section_id=F.concat(F.lit("para_"), F.col("idx")), section_name=F.lit("Extracted Text"), subsection_type=F.lit(""), page_number=F.lit(0), line_number=F.lit(0), component=F.lit("General Text"), place=F.col("idx")))


__all__ = ["blocks", "paragraphs", "SEGMENT_COLUMNS"]
