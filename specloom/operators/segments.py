"""All segments of documents in their order, deduplication, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.functions.text import clean, retention
from specloom.operators import procedures, specs, structure
from specloom.sources.tables import materialise

ORDER = {"table": 0, "coordinate": 1, "inline": 2, "procedure": 3}


def _tagged(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("_source", F.lit(ORDER[source]))


def numbered(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of the parts with ``seg_seq``, the place in the list: parts in order, lines in order, matches in order."""
    union = None
    for source, df in parts.items():
        tagged = _tagged(df, source)
        union = tagged if union is None else union.unionByName(tagged)
    # a block keeps its run's first line, so blocks follow their own first line, which is their place
    line = F.when(F.col("_source") == ORDER["procedure"], F.col("place")).otherwise(F.col("line_number"))
    w = Window.partitionBy("doc_id").orderBy("_source", line, "place", "text")
    return union.withColumn("seg_seq", F.row_number().over(w).cast("long") - 1).drop("_source", "place")


def spec_parts(lines: DataFrame, dialect: P.Dialect = P.WORKSHOP, tables: DataFrame | None = None) -> dict[str, DataFrame]:
    if dialect is P.WORKSHOP:
        return {"table": specs.table_rows(lines), "inline": specs.inline_specs(lines)}
    out = {"table": specs.generic_table_rows(lines), "inline": specs.generic_inline_specs(lines)}
    return out | ({"coordinate": specs.coordinate_rows(tables)} if tables is not None else {})


def all_segments(lines: DataFrame, dialect: P.Dialect = P.WORKSHOP, tables: DataFrame | None = None) -> DataFrame:
    """Spec segments, duplicates included, then procedure blocks. The lines are parsed once, for all of them."""
    lines = materialise(lines, "lines")
    return numbered(spec_parts(lines, dialect, tables) | {"procedure": procedures.blocks(lines)})


def deduplicated(segments: DataFrame) -> DataFrame:
    """One spec segment for each (component's first 60 characters, Nm, section): the first, or the last table row after it.

    ``seg_seq`` becomes the first occurrence's place. Segments without Nm fall together.
    """
    rows = segments.filter(F.col("content_type").isin(*P.SPEC_TYPES))
    key = [F.col("doc_id"), F.substring(F.btrim(F.lower("component")), 1, 60), F.col("spec_value.value_nm"), F.col("section_id")]
    whole = Window.partitionBy(*key)
    table = F.col("content_type") == "torque_table_row"
    first = F.min("seg_seq").over(whole)
    # a table row beats whatever came first, unless it is the first itself and none follows
    best = Window.partitionBy(*key).orderBy(F.when(table, -F.col("seg_seq")).otherwise(F.col("seg_seq") + F.lit(1 << 40)))
    return rows.withColumn("_first", first).withColumn("_n", F.row_number().over(best)).filter("_n = 1").withColumn("seg_seq", F.col("_first")).drop("_first", "_n")


def document_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, page, rows) of documents that bring a column ``tables`` of those found by position."""
    return docs.select("doc_id", F.explode("tables").alias("t")).select("doc_id", "t.page", "t.rows")


def extract(docs: DataFrame, dialect: P.Dialect = P.WORKSHOP, tables: DataFrame | None = None, cleaned: bool = False) -> tuple[DataFrame, DataFrame]:
    """(all segments, spec segments) of (doc_id, text), with the fallback for documents without specs.

    A document without specs has all its segments as specs; without any segment, its paragraphs.
    """
    docs = docs if cleaned else structure.clean_documents(docs, dialect)
    lines = structure.typed_lines(structure.split_lines(docs), dialect)
    every = materialise(all_segments(lines, dialect, tables), "segments")
    deduped = deduplicated(every)
    have = lambda df: df.select("doc_id").distinct()
    without = every.join(have(deduped), "doc_id", "left_anti")
    bare = docs.join(have(every), "doc_id", "left_anti")
    plain = numbered({"procedure": procedures.paragraphs(bare, dialect)})
    return every.unionByName(plain), deduped.unionByName(without).unionByName(plain)


def document_counts(docs: DataFrame, segments: DataFrame, specs_: DataFrame, dialect: P.Dialect = P.WORKSHOP) -> DataFrame:
    """doc_id, raw_chars, cleaned_chars, retention, total_segments, spec_segments, procedure_segments, torque_rows."""
    kind = F.col("content_type")
    counted = segments.groupBy("doc_id").agg(F.count("*").alias("total_segments"), F.count(F.when(kind == "procedure_step", 1)).alias("procedure_segments"), F.count(F.when(kind == "torque_table_row", 1)).alias("torque_rows"))
    spec = specs_.groupBy("doc_id").agg(F.count("*").alias("spec_segments"))
    c = clean(F.col("text"), dialect)
    base = docs.select("doc_id", F.length("text").cast("long").alias("raw_chars"), F.length(c).cast("long").alias("cleaned_chars"), retention(F.col("text"), c).alias("retention"))
    return base.join(counted, "doc_id", "left").join(spec, "doc_id", "left").na.fill(0, ["total_segments", "procedure_segments", "torque_rows", "spec_segments"])


def metadata(docs: DataFrame, segments: DataFrame, specs_: DataFrame, dialect: P.Dialect = P.WORKSHOP) -> DataFrame:
    """A document's counters, and its segments by type."""
    by_type = segments.groupBy("doc_id", "content_type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("content_type", "n")))).alias("segments_by_type"))
    return document_counts(docs, segments, specs_, dialect).join(by_type, "doc_id", "left")


def count_by_type(segments: DataFrame) -> DataFrame:
    return segments.groupBy("content_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "content_type")


def top_sections(specs_: DataFrame, k: int = 10) -> DataFrame:
    return specs_.groupBy("section_id", "section_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section_id", "section_name").limit(k)


def unique_components(specs_: DataFrame) -> DataFrame:
    name = F.nullif(F.btrim(F.lower("component")), F.lit(""))
    return specs_.groupBy("doc_id").agg(F.countDistinct(name).alias("components"))


def length_stats(chunks: DataFrame) -> DataFrame:
    n = F.length("embed_text")
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.floor(F.avg(n)).alias("avg_chars"), F.max(n).cast("long").alias("max_chars"))
