"""Documents to typed lines: sections, subsections and pages are filled forward by windows.

Input (doc_id, text). Every window is over one document in line order, so the rows are
shuffled and sorted once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.functions.text import clean, has, part, strip

LINE_COLUMNS = ["doc_id", "idx", "text", "content_type", "section_id", "section_name", "subsection_type", "page_number"]


def in_order():
    return Window.partitionBy("doc_id").orderBy("idx")


def running():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def clean_documents(docs: DataFrame, dialect: P.Dialect = P.WORKSHOP) -> DataFrame:
    return docs.withColumn("text", clean(F.col("text"), dialect))


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, text): stripped lines with a character, numbered from 0 among all lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return lines.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")


def _content_type(dialect: P.Dialect) -> Column:
    t = F.col("text")
    warning = (has(t, dialect.warning), "warning_notice")
    step = (has(t, P.STEP) | has(t, dialect.bullet), "procedure_step")
    if dialect is P.WORKSHOP:
        chain = F.when(has(t, P.TABLE_HEADER), "table_header").when(*warning).when(*step)
    else:
        chain = F.when(*warning).when(*step).when(has(t, P.ALL_CAPS) & (F.length(t) < 60), "subsection_header")
    return chain.otherwise("general_text")


def typed_lines(lines: DataFrame, dialect: P.Dialect = P.WORKSHOP) -> DataFrame:
    """Lines with their type and where they stand; page marker lines themselves go."""
    t = F.col("text")
    section = F.lit(False)
    sec_id, name = F.lit(None), F.lit(None)
    for p in reversed(dialect.sections):
        sec_id = F.when(has(t, p), strip(part(t, p, 1))).otherwise(sec_id)
        name = F.when(has(t, p), strip(part(t, p, 2))).otherwise(name)
        section = section | has(t, p)
    page = F.when(has(t, P.PAGE), part(t, P.PAGE, 1).try_cast("int"))
    sub_name = F.upper(part(t, dialect.subsection, 1)) if dialect is P.WORKSHOP else F.upper(t)
    marked = (
        lines.withColumn("_page", page)
        .withColumn("_section", F.when(F.col("_page").isNull() & section, F.struct(sec_id.alias("id"), name.alias("name"))))
        .withColumn("_sub", F.when(F.col("_section").isNotNull(), F.lit("")).when(F.col("_page").isNull() & has(t, dialect.subsection), sub_name))
    )
    last = lambda c: F.last(c, ignorenulls=True).over(running())
    header = F.when(F.col("_section").isNotNull(), F.lit("section_header")).when(F.col("_sub").isNotNull(), F.lit("subsection_header"))
    filled = marked.select(
        "doc_id",
        "idx",
        "text",
        F.coalesce(header, _content_type(dialect)).alias("content_type"),
        F.coalesce(last("_section")["id"], F.lit("")).alias("section_id"),
        F.coalesce(last("_section")["name"], F.lit("")).alias("section_name"),
        F.coalesce(last("_sub"), F.lit("")).alias("subsection_type"),
        F.coalesce(last("_page"), F.lit(0)).alias("page_number"),
        "_page",
    )
    return filled.filter(F.col("_page").isNull()).drop("_page")


def parse(docs: DataFrame, dialect: P.Dialect = P.WORKSHOP, cleaned: bool = False) -> DataFrame:
    return typed_lines(split_lines(docs if cleaned else clean_documents(docs, dialect)), dialect)
