"""Names for specs that have none: by value, by the nearest named segment, by trim names nearby.

Three lookups over one document's segments: an equi join on the section with a band on the
value; and range windows over line numbers, so no segment is joined with its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.functions.text import has, part, strip

CLOSE, BACK, AHEAD, TOLERANCE = 30, 150, 40, 0.05


def value_match(specs: DataFrame) -> DataFrame:
    """(doc_id, line_number, seg_seq, hint): the table row of the section whose Nm is nearest, within 5 %."""
    nm = F.col("spec_value.value_nm")
    bare = specs.filter((F.btrim("component") == "") & (F.col("line_number") != 0) & nm.isNotNull()).select("doc_id", "section_id", "line_number", "seg_seq", nm.alias("v"))
    rows = specs.filter((F.btrim("component") != "") & (F.col("content_type") == "torque_table_row") & (nm != 0)).select("doc_id", "section_id", nm.alias("tv"), F.col("component").alias("name"), F.col("line_number").alias("tl"), F.col("seg_seq").alias("ts"))
    off = F.abs(F.col("v") - F.col("tv")) / F.greatest(F.col("tv"), F.lit(1.0))
    near = bare.join(rows, ["doc_id", "section_id"]).withColumn("off", off).filter(F.col("off") <= TOLERANCE)
    best = F.min_by("name", F.struct("off", F.abs(F.col("tl") - F.col("line_number")), "ts"))
    return near.groupBy("doc_id", "line_number", "seg_seq").agg(best.alias("hint"))


def _by_line(low: int, high: int):
    return Window.partitionBy("doc_id").orderBy("line_number").rangeBetween(low, high)


def nearest_component(segments: DataFrame) -> DataFrame:
    """Segments with ``near``: the component of the nearest named segment at most 30 lines before; ties: the first in order."""
    named = strip(F.col("component")) != ""
    key = F.when(named, F.struct("line_number", -F.col("seg_seq")))
    return segments.withColumn("near", F.max_by(F.when(named, strip(F.col("component"))), key).over(_by_line(-CLOSE, -1)))


def _variant(text: Column) -> Column:
    return F.nullif(part(text, P.TRIM, 1), F.lit(""))


def _phrase(text: Column) -> Column:
    return F.nullif(strip(part(text, P.PHRASE, 1)), F.lit(""))


def variant_scan(segments: DataFrame) -> DataFrame:
    """Segments with ``before`` (nearest line at most 150 back with a trim name: line, variant, phrase) and ``after`` (40 ahead).

    On one line a segment with both a trim name and a phrase counts before one with the name alone.
    """
    t = F.col("text")
    v, p = _variant(t), _phrase(t)
    back = F.when(v.isNotNull(), F.struct(F.col("line_number"), p.isNotNull().alias("both"), (-F.col("seg_seq")).alias("o"), v.alias("variant"), p.alias("phrase")))
    ahead = F.when(v.isNotNull(), F.struct(F.col("line_number"), F.col("seg_seq").alias("o"), v.alias("variant"), F.lit(None).cast("string").alias("phrase")))
    pick = lambda s: F.struct(s["line_number"].alias("line"), s["variant"].alias("variant"), s["phrase"].alias("phrase"))
    found = segments.withColumn("_b", F.max(back).over(_by_line(-BACK, -1))).withColumn("_a", F.min(ahead).over(_by_line(1, AHEAD)))
    return found.withColumn("before", F.when(F.col("_b").isNotNull(), pick(F.col("_b")))).withColumn("after", F.when(F.col("_a").isNotNull(), pick(F.col("_a")))).drop("_a", "_b")


def hints(segments: DataFrame, specs: DataFrame) -> DataFrame:
    """(doc_id, line_number, hint) for spec lines whose component is empty.

    Of several specs on one line the last one's hint counts. Of the lines that took their
    words from one source line only the last keeps the phrase, the others the trim name.
    """
    bare = specs.filter((F.btrim("component") == "") & (F.col("line_number") != 0)).select("doc_id", "line_number", "seg_seq")
    by_value = value_match(specs)
    # every spec stands in the segments too, so the windows give its surroundings
    around = variant_scan(nearest_component(segments)).select("doc_id", "line_number", "near", F.coalesce("before", "after").alias("scan")).groupBy("doc_id", "line_number").agg(F.first("near").alias("near"), F.first("scan").alias("scan"))
    rows = bare.join(by_value, ["doc_id", "line_number", "seg_seq"], "left").join(around, ["doc_id", "line_number"], "left")
    scan = F.col("scan")
    worded = F.when(scan["phrase"].isNotNull(), F.concat(scan["phrase"], F.lit(" ("), scan["variant"], F.lit(")"))).otherwise(scan["variant"])
    rows = rows.select("doc_id", "line_number", "seg_seq", F.coalesce("hint", "near", worded).alias("hint"), F.when(F.col("hint").isNull() & F.col("near").isNull(), scan["line"]).alias("source"), scan["variant"].alias("variant"))
    last = rows.filter("hint is not null").groupBy("doc_id", "line_number").agg(F.max_by(F.struct("hint", "source", "variant"), F.col("seg_seq")).alias("h")).select("doc_id", "line_number", "h.*")
    latest = F.max("line_number").over(Window.partitionBy("doc_id", "source"))
    earlier = F.col("source").isNotNull() & (F.col("line_number") < latest)
    return last.select("doc_id", "line_number", F.when(earlier, F.col("variant")).otherwise(F.col("hint")).alias("hint"))


__all__ = ["hints", "value_match", "nearest_component", "variant_scan", "has"]
