"""Output: CSV in three shapes, JSON, Parquet index bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the columns of the two command-line tables
COMPACT = ["component", "spec_type", "value", "unit"]
FULL = ["query", "component", "spec_type", "value", "unit", "section_id", "vehicle_variant", "source", "confidence", "is_conflict"]
# fixed values: the columns of the two browser tables
WIDE = ["component", "spec_type", "value", "unit", "section_id", "vehicle_variant", "source", "confidence"]
NARROW = ["component", "spec_type", "value", "unit", "section_id", "vehicle_variant"]


def _cell(df: DataFrame, name: str, between: str) -> Column:
    c = F.col(name)
    return F.array_join(c, between) if dict(df.dtypes)[name].startswith("array") else F.coalesce(c.cast("string"), F.lit(""))


def _quoted(c: Column) -> Column:
    """Quotes only where a cell needs them."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(df: DataFrame, columns: list[str], between: str = ", ") -> DataFrame:
    return df.select(F.concat_ws(",", *(_quoted(_cell(df, n, between)) for n in columns)).alias("line"))


def csv_lines_always_quoted(df: DataFrame, columns: list[str] = WIDE) -> DataFrame:
    """Every cell in quotes, quotes inside as they are, variants joined by ';'."""
    return df.select(F.concat_ws(",", *(F.concat(F.lit('"'), _cell(df, n, ";"), F.lit('"')) for n in columns)).alias("line"))


def csv_lines_never_quoted(df: DataFrame, columns: list[str] = NARROW) -> DataFrame:
    """No cell in quotes, variants joined by '|'."""
    return df.select(F.concat_ws(",", *(_cell(df, n, "|") for n in columns)).alias("line"))


def write_csv(df: DataFrame, path: str, full: bool = False) -> None:
    columns = FULL if full else COMPACT
    df.select(*(_cell(df, n, ", ").alias(n) for n in columns)).write.option("header", True).option("escape", '"').csv(path)


def json_records(df: DataFrame, columns: list[str] = COMPACT) -> DataFrame:
    """One JSON array of the records of each query, in their order."""
    rows = df.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", F.struct(*columns).alias("r")))).alias("rs"))
    return rows.select("query_id", F.to_json(F.transform("rs", lambda x: x["r"])).alias("json"))


def write_segments(segments: DataFrame, path: str) -> None:
    """JSON lines for each document, non-ASCII characters kept."""
    segments.write.partitionBy("doc_id").json(path)


def write_metadata(rows: DataFrame, path: str) -> None:
    """A JSON line for each document."""
    rows.write.json(path)


def write_text(docs: DataFrame, path: str) -> None:
    docs.select("doc_id", F.col("text").alias("value")).write.partitionBy("doc_id").option("lineSep", "\n").text(path)


class IndexBundle:
    """Chunk and posting tables under one folder, partitioned by session and chunk type, so a session reads its own files."""

    TABLES = ("chunks", "postings", "lengths", "terms", "stats")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, session_id: str, chunks: DataFrame, index) -> None:
        from specloom.operators.retrieval import counted

        tables = {"chunks": chunks.withColumnRenamed("chunk_type", "index_key"), "postings": counted(index.postings), "lengths": index.lengths, "terms": index.terms, "stats": index.stats}
        for name, df in tables.items():
            df.withColumn("session_id", F.lit(session_id)).write.mode("append").partitionBy("session_id", "index_key").parquet(f"{self.path}/{name}")

    def sessions(self) -> list[str]:
        """The stored sessions, by the folders' names."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/chunks/session_id=*")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(str(f.getPath().getName()).removeprefix("session_id=") for f in found)

    def load(self, session_id: str):
        from specloom.operators.retrieval import Bm25Index

        mine = {n: self.spark.read.parquet(f"{self.path}/{n}").filter(F.col("session_id") == session_id) for n in self.TABLES}
        if mine["chunks"].isEmpty():
            raise KeyError(f"no session {session_id}")
        return mine["chunks"].withColumnRenamed("index_key", "chunk_type"), Bm25Index(mine["postings"], mine["lengths"], mine["terms"], mine["stats"])
