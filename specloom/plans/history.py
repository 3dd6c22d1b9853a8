"""History of questions: append, newest first, search, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 100
SCHEMA = "entry_id string, ts timestamp, query string, variant string, n_results long"


class History:
    """An append-only table; deletions are a table of ids, so no file is rewritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame) -> None:
        rows.select("entry_id", "ts", "query", "variant", "n_results").write.mode("append").parquet(f"{self.path}/entries")

    def delete(self, entry_id: str | None = None) -> None:
        gone = self.all().select("entry_id") if entry_id is None else self.spark.sql("select :id as entry_id", {"id": entry_id})
        gone.write.mode("append").parquet(f"{self.path}/deleted")

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(conf).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def all(self) -> DataFrame:
        return self._read("entries", SCHEMA).join(self._read("deleted", "entry_id string"), "entry_id", "left_anti")

    def newest(self, limit: int = MOST) -> DataFrame:
        return page(self.all(), limit)


def page(rows: DataFrame, limit: int = MOST) -> DataFrame:
    return rows.orderBy(F.desc("ts"), F.desc("entry_id")).limit(min(limit, MOST))


def search(rows: DataFrame, word: str) -> DataFrame:
    return rows.filter(F.contains(F.lower("query"), F.lit(word.lower())))
