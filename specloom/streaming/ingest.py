"""Continuous ingestion: new text files become indexed sessions, one micro-batch each."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specloom.plans.engine import Engine


def watch(engine: Engine, folder: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Index each batch of new files in ``folder`` as session ``batch-<number>``; the checkpoint keeps files from coming twice."""
    files = engine.spark.readStream.format("text").option("wholetext", True).load(folder).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))

    def add(batch, number: int) -> None:
        if not batch.isEmpty():
            engine.add(batch, f"batch-{number}")

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
