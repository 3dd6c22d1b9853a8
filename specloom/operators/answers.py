"""Chunks to specification records: fast path, text fallback, model responses, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.functions.text import comma_number, has, no_variants, parts, strip

RESULT_COLUMNS = ["query_id", "component", "spec_type", "value", "unit", "section_id", "section_name", "vehicle_variant", "is_safety_critical", "stage_number", "source", "confidence", "raw_text", "seq"]
VALUES = ["value_nm", "value_lbft", "value_lbin", "value_mm", "value_deg"]
FAR = 1 << 20


def eligible(with_kgcm: bool = False) -> Column:
    """A named component and a value. ``with_kgcm``: a value in kgf·cm alone counts too."""
    names = VALUES + ["value_kgcm"] * with_kgcm
    return (strip(F.col("component")) != "") & F.coalesce(*(F.col(f"spec_value.{n}") for n in names)).isNotNull()


def spec_name(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in P.SPEC_NAMES.items() for x in kv))[kind], F.lit("Other"))


def unpivot(chunks: DataFrame, with_kgcm: bool = False) -> DataFrame:
    """Eligible chunks (query_id, place, chunk columns) as one record for each value; millimetres and degrees only if nothing came before."""
    sv = lambda n: F.col(f"spec_value.{n}")
    kind = spec_name(F.col("content_type"))
    torque = F.coalesce(sv("value_nm"), sv("value_lbft"), sv("value_lbin"))
    one = lambda ok, v, unit, name: F.when(ok & v.isNotNull(), F.struct(v.cast("string").alias("value"), F.lit(unit).alias("unit"), name.alias("spec_type")))
    yes = F.lit(True)
    records = [one(yes, sv("value_nm"), "Nm", kind), one(yes, sv("value_lbft"), "lb-ft", kind), one(yes, sv("value_lbin"), "lb-in", kind)]
    records += [one(yes, sv("value_kgcm"), "kgf·cm", kind)] if with_kgcm else []
    records += [one(torque.isNull(), sv("value_mm"), "mm", F.lit("Dimension")), one(torque.isNull() & sv("value_mm").isNull(), sv("value_deg"), "degrees", F.lit("Alignment"))]
    rows = chunks.filter(eligible(with_kgcm)).select("*", F.posexplode(F.array_compact(F.array(*records))).alias("_k", "_r"))
    given = {"component": strip(F.col("component")), "spec_type": F.col("_r.spec_type"), "value": F.col("_r.value"), "unit": F.col("_r.unit"), "source": F.lit("table"), "raw_text": F.col("display_text"), "seq": (F.col("place") * FAR + F.col("_k")).cast("long")}
    return rows.select(*(given.get(n, F.col(n)).alias(n) for n in RESULT_COLUMNS))


def query_component(query: Column) -> Column:
    """The words of a question without one leading and one trailing phrase, 80 characters; the question itself if none are left."""
    q = F.regexp_replace(strip(query), P.java(P.QUERY_HEAD), "")
    q = F.substring(strip(F.regexp_replace(q, P.java(P.QUERY_TAIL), "")), 1, 80)
    return F.when(q == "", F.substring(query, 1, 80)).otherwise(q)


def imperial_unit(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(low.contains("kgf"), F.lit("kgf·cm")).when(low.contains("ft"), F.lit("lb-ft")).otherwise(F.lit("lb-in"))


def fallback(chunks: DataFrame) -> DataFrame:
    """Torques in the text of chunks (query_id, query, place, …) that are not eligible.

    Metric values, each with its imperial one; lines without any metric value give their
    lb-ft. One record for each (unit, value rounded half to even); an imperial value
    comes only with a metric one that is not a repeat, once for each text of it.
    """
    lines = chunks.select("query_id", "query", "place", "section_id", "section_name", F.posexplode(F.split("display_text", "\n")).alias("ln", "raw_text")).withColumn("raw_text", strip(F.col("raw_text"))).filter("raw_text != ''")
    t = F.col("raw_text")
    metric = has(t, P.FALLBACK_TORQUE)
    zipped = lambda p, groups: F.arrays_zip(*(parts(t, p, g).alias(n) for n, g in groups.items()))
    low = lambda c: strip(F.split(F.replace(c, F.lit(","), F.lit("")), "[-–]")[0])
    nm = lines.filter(metric).select("*", F.posexplode(zipped(P.FALLBACK_TORQUE, {"a": 1, "b": 3, "u": 4})).alias("k", "m"))
    ft = lines.filter(~metric).select("*", F.posexplode(zipped(P.FALLBACK_LBFT, {"a": 1})).alias("k", "m"))
    base = ["query_id", "query", "place", "section_id", "section_name", "ln", "k", "raw_text"]
    nm = nm.select(*base, low(F.col("m.a")).alias("value"), F.lit("Nm").alias("unit"), F.lit(0.65).alias("confidence"), low(F.col("m.b")).alias("imp"), imperial_unit(F.col("m.u")).alias("imp_unit"))
    ft = ft.select(*base, low(F.col("m.a")).alias("value"), F.lit("lb-ft").alias("unit"), F.lit(0.60).alias("confidence"), F.lit("").alias("imp"), F.lit("").alias("imp_unit"))
    both = nm.unionByName(ft).withColumn("v", comma_number(F.col("value"))).filter("v > 0").withColumn("component", query_component(F.col("query")))
    order = ["place", "ln", "k"]
    seen = Window.partitionBy("query_id", F.lower("component"), "unit", F.bround("v")).orderBy(*order)
    kept = both.withColumn("n", F.row_number().over(seen)).filter("n = 1")
    imp = kept.filter("imp != ''").select(*base, "component", F.col("imp").alias("value"), F.col("imp_unit").alias("unit"), "confidence")
    once = Window.partitionBy("query_id", F.lower("component"), "unit", "value").orderBy(*order)
    imp = imp.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n").withColumn("second", F.lit(1))
    rows = kept.select(*base, "component", "value", "unit", "confidence").withColumn("second", F.lit(0)).unionByName(imp)
    # behind all table records; room for a million chunks, 16 million lines of each and 65,536 matches on a line
    seq = F.lit(1 << 61) + F.shiftleft(F.col("place").cast("long"), 41) + F.shiftleft(F.col("ln").cast("long"), 17) + F.col("k") * 2 + F.col("second")
    given = {"spec_type": F.lit("Torque"), "vehicle_variant": no_variants(), "is_safety_critical": F.lit(False), "stage_number": F.lit(0), "source": F.lit("regex_fallback"), "seq": seq}
    return rows.select(*(given.get(n, F.col(n)).alias(n) for n in RESULT_COLUMNS))


RESPONSE = "specs array<struct<component:string,spec_type:string,value:string,unit:string>>, confidence double, reasoning string"


def parse_responses(responses: DataFrame, least: float = 0.30) -> DataFrame:
    """Records of model responses (query_id, response, section_id, section_name, vehicle_variant, raw_text).

    JSON, or what stands between the outermost braces; confidence 0.8 if not given; records need
    component, value and unit; those under ``least`` go.
    """
    inner = F.regexp_extract("response", r"(?s)\{.*\}", 0)
    read = F.from_json(inner, RESPONSE)
    rows = responses.withColumn("_j", read).withColumn("confidence", F.coalesce(F.col("_j.confidence"), F.lit(0.8))).filter(F.col("confidence") >= least)
    rows = rows.select("*", F.posexplode("_j.specs").alias("_k", "_s"))
    said = lambda n: F.coalesce(strip(F.col(f"_s.{n}")), F.lit(""))
    given = {"component": said("component"), "spec_type": F.coalesce(F.col("_s.spec_type"), F.lit("Torque")), "value": said("value"), "unit": said("unit"), "is_safety_critical": F.lit(False), "stage_number": F.lit(0), "source": F.lit("llm"), "seq": F.lit(FAR * FAR) + F.col("_k")}
    out = rows.select(*(given.get(n, F.col(n)).alias(n) for n in RESULT_COLUMNS))
    return out.filter("component != '' and value != '' and unit != ''")


def canonical_unit(unit: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in P.UNIT_ALIASES.items() for x in kv))
    return F.coalesce(known[strip(F.lower(unit))], unit)


def clean_value(value: Column) -> Column:
    """'90.0' as '90', '1.50' as '1.5'; what is no number only trimmed."""
    v = strip(value)
    d = F.when(v.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), v.try_cast("double"))
    return F.when(d == F.floor(d), d.cast("bigint").cast("string")).when(d.isNotNull(), d.cast("string")).otherwise(v)


def validate(results: DataFrame) -> DataFrame:
    """Records with canonical units and values, one for each (component, unit, stage, section), conflicts flagged.

    The first record's value stays; the most confident record with that value is kept (the first
    of equals); other values make a conflict. Order: table records, section, component, place.
    """
    rows = results.withColumn("unit", canonical_unit(F.col("unit"))).withColumn("value", clean_value(F.col("value")))
    key = ["query_id", F.btrim(F.lower("component")).alias("_c"), "unit", F.coalesce("stage_number", F.lit(0)).alias("_g"), F.btrim(F.coalesce("section_id", F.lit(""))).alias("_s")]
    whole = ["query_id", "_c", "unit", "_g", "_s"]
    rows = rows.select("*", *(k for k in key if not isinstance(k, str)))
    w = Window.partitionBy(*whole)
    first = F.min_by("value", "seq").over(w)
    rows = rows.withColumn("_v", first).withColumn("_first", F.min("seq").over(w)).withColumn("_low", F.min("value").over(w)).withColumn("_high", F.max("value").over(w))
    best = Window.partitionBy(*whole).orderBy((F.col("value") == F.col("_v")).desc(), F.desc("confidence"), "seq")
    kept = rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").withColumn("is_conflict", F.col("_low") != F.col("_high"))
    place = Window.partitionBy("query_id").orderBy(F.when(F.col("source") == "table", 0).otherwise(1), "section_id", "component", "_first")
    return kept.withColumn("position", F.row_number().over(place) - 1).select("query_id", "position", *RESULT_COLUMNS[1:-1], "is_conflict")


def with_empty(queries: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each question, also those without any record: ``full_results`` in order and how many came from tables and from elsewhere."""
    columns = [c for c in records.columns if c != "query_id"]
    ordered = F.sort_array(F.collect_list(F.struct(*columns)))
    grouped = records.groupBy("query_id").agg(ordered.alias("full_results"), F.count(F.when(F.col("source") == "table", 1)).alias("fast_path_count"), F.count(F.when(F.col("source") != "table", 1)).alias("llm_path_count"))
    rows = queries.join(grouped, "query_id", "left")
    some = F.coalesce("full_results", F.expr("array()").cast(dict(grouped.dtypes)["full_results"]))
    return rows.withColumn("full_results", some).na.fill(0, ["fast_path_count", "llm_path_count"])


def summary(responses: DataFrame) -> DataFrame:
    """Totals of a batch of ``with_empty`` rows: queries, records, fast and other records, records for each query."""
    n = F.size("full_results")
    return responses.agg(F.count("*").alias("queries"), F.sum(n).alias("specs"), F.sum("fast_path_count").alias("fast"), F.sum("llm_path_count").alias("other"), F.avg(n).alias("specs_per_query"))


def shown_value(value: Column) -> Column:
    """A value as shown: without '.0' at its end, a dash for none."""
    return F.coalesce(F.regexp_replace(value, r"\.0$", ""), F.lit("—"))


def unit_group(unit: Column) -> Column:
    """What a unit is shown as."""
    u = F.lower(unit)
    return F.when(u.contains("nm"), "nm").when(u.contains("lb-ft"), "lb-ft").when(u.contains("lb-in"), "lb-in").when(u.contains("mm") | u.contains("in"), "length").when(u.contains("deg"), "angle").otherwise("other")


def confidence_band(confidence: Column) -> Column:
    """'high' above 0.95, 'medium' above 0.8, else 'low'."""
    return F.when(confidence > 0.95, "high").when(confidence > 0.8, "medium").otherwise("low")


def short(results: DataFrame) -> DataFrame:
    return results.select("query_id", "position", "component", "spec_type", "value", "unit")
