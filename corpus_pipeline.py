"""A training-data pipeline over ``documents``: quality, near duplicates, benchmark passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of
``documents``.  Nulls, empty and repeated texts follow the operators' own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import decontaminate, lsh_forest, pfair, quality, repair
from specloom.llm._common import from_files, materialise
from specloom.llm.queries import read, tokenizer_file
from specloom.llm.tokens import definition


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, the rules ordered by the cascade."""
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each class of near duplicates."""
    return lsh_forest.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture."""
    return pfair.interleave(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the order in which the mixture was written, read back: a row for each document.

    The order of the input's files by name, and of the rows in each, is the mixture's.
    """
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")
    order = [number.alias("_part"), name.alias("_file"), F.col("_metadata.row_index").alias("_row")] if from_files(docs) else ["doc_id"]
    return repair.read_documents(repair.write_shards(docs, definition(tokenizer_file()), order=order))


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("mixture", mix), ("tokens", tokenise)]

#: The forest, the schedule and the tokenizer are not SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of ``documents``, each one's rows written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
