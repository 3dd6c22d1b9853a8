"""Segments to chunks: enrichment of the embedded text, splitting, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.functions.text import part, procedure_chunks, strip

CHUNK_COLUMNS = ["doc_id", "chunk_id", "chunk_type", "embed_text", "display_text", "section_id", "section_name", "subsection_type", "page_number", "component", "vehicle_variant", "content_type", "is_safety_critical", "confidence", "spec_value", "stage_number", "chunk_pos"]
LEAST = 20


def enrich_text(text: Column, section: Column) -> Column:
    """Other than specs: 'variant | [section] text'."""
    variant = F.nullif(part(text, P.TRIM, 1), F.lit(""))
    place = F.when(section != "", F.concat(F.lit("["), section, F.lit("]")))
    prefix = F.concat_ws(" | ", variant, place)
    return F.when(prefix != "", strip(F.concat(prefix, F.lit(" "), text))).otherwise(text)


def enrich_spec(text: Column, section: Column, variants: Column, context: Column, component: Column) -> Column:
    """Specs: 'Section: … | Variant: … | Context: … | Component: … | body', a variant in the component's parentheses first, twice."""
    said = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    prefix = F.concat_ws(" | ", said("Section: ", section), said("Variant: ", F.array_join(variants, ", ")), said("Context: ", context), said("Component: ", component))
    inside = strip(part(component, P.PARENTHESIS, 1))
    bare = strip(F.regexp_replace(component, P.java(r"\s*\([^)]+\)\s*\z"), ""))
    loud = (
        F.when(inside != "", F.concat(inside, F.lit(" | "), inside, F.lit(" "), bare, F.lit(" | "), prefix))
        .when(component.contains("SVT Raptor") | text.contains("SVT Raptor"), F.concat(F.lit("SVT Raptor | SVT Raptor | "), prefix))
        .otherwise(prefix)
    )
    body = F.when((component != "") & text.startswith("Component:"), F.regexp_replace(text, P.java(r"^Component:\s*[^—]+—\s*"), "")).otherwise(text)
    return F.when(loud != "", F.concat(loud, F.lit(" | "), body)).otherwise(text)


def enriched(component: Column) -> Column:
    text, section = strip(F.col("text")), F.col("section_name")
    spec = enrich_spec(text, section, F.col("vehicle_variant"), F.col("subsection_type"), component)
    return F.when(F.col("content_type").isin(*P.SPEC_TYPES), spec).otherwise(enrich_text(text, section))


def spec_chunks(specs: DataFrame, hints: DataFrame) -> DataFrame:
    """One chunk for each spec segment, in order; a hint names specs without a component, in the embedded text only."""
    rows = specs.join(hints, ["doc_id", "line_number"], "left")
    own = strip(F.col("component"))
    named = F.when(own == "", F.coalesce("hint", F.lit(""))).otherwise(own)
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_seq")) - 1
    return rows.withColumn("chunk_pos", pos).select(*_columns("spec", F.format_string("spec_%04d", "chunk_pos"), enriched(named), F.col("text")))


def procedure_chunk_rows(segments: DataFrame) -> DataFrame:
    """Procedure segments cut into chunks of 20 characters or more, numbered through the document."""
    rows = segments.filter(F.col("content_type") == "procedure_step").select("*", F.posexplode(procedure_chunks(F.col("text"))).alias("_k", "_part"))
    rows = rows.withColumn("text", strip(F.col("_part"))).filter(F.length("text") >= LEAST)
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("seg_seq", "_k")) - 1
    return rows.withColumn("chunk_pos", pos).select(*_columns("procedure", F.format_string("proc_%05d", "chunk_pos"), enriched(strip(F.col("component"))), F.col("text")))


def _columns(kind: str, chunk_id: Column, embed: Column, display: Column) -> list[Column]:
    given = {"chunk_id": chunk_id, "chunk_type": F.lit(kind), "embed_text": embed, "display_text": display}
    return [given.get(n, F.col(n)).alias(n) for n in CHUNK_COLUMNS]


def build(segments: DataFrame, specs: DataFrame, hints: DataFrame) -> DataFrame:
    return spec_chunks(specs, hints).unionByName(procedure_chunk_rows(segments))
