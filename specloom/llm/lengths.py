"""Token counts: an exact histogram of encoded lengths, answering every context limit.

``token_lengths`` counts the ids of each document (null text: 0). ``histogram`` adds them up
by length, and suffix sums over the lengths give, for each limit that is some document's
length, how many documents reach it, the ids in them, what is left when texts are cut
at the limit, and the documents' share (a quantile).  ``at_limits`` answers any limit.

No rows: no lengths. Repeated rows count each. Other columns are not read, whatever
their names. The suffix sums run over ranges of lengths whose totals are summed first,
so no task needs the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm._common import slices, tidied
from specloom.llm.tokens import encoder


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Counts of documents by encoded length within each task's batches: length, n."""
    text = docs.sparkSession.sparkContext.broadcast(tokenizer)
    schema = pa.schema([("length", pa.int64()), ("n", pa.int64())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(text.value)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for at, rows in slices(t, "text"):
                lengths, n = np.unique(enc.encode(t.column("text").slice(at, rows))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "length long, n long")


def histogram(lengths: DataFrame, bucket: int = 128) -> DataFrame:
    """From rows of (length, n): for each length the documents and ids at it, at least it, and cut at it.

    ``truncated_total``: ids of all documents when each is cut at ``length``;
    ``quantile``: the share of documents that are no longer than ``length``.
    """
    h = lengths.groupBy("length").agg(F.sum("n").alias("n_docs")).withColumn("_range", F.floor(F.col("length") / bucket))
    tokens = F.col("length") * F.col("n_docs")
    ranges = h.groupBy("_range").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("_range", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"), F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all"))
    here = Window.partitionBy("_range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("d_here", F.sum("n_docs").over(here)).withColumn("t_here", F.sum(tokens).over(here)).join(ranges, "_range")
    docs_from, tokens_from = F.col("d_here") + F.col("d_above"), F.col("t_here") + F.col("t_above")
    return h.select(
        "length",
        "n_docs",
        tokens.alias("n_tokens"),
        docs_from.alias("docs_at_least"),
        tokens_from.alias("tokens_at_least"),
        (F.col("t_all") - tokens_from + docs_from * F.col("length")).alias("truncated_total"),
        ((F.col("d_all") - docs_from + F.col("n_docs")) / F.col("d_all")).alias("quantile"),
        F.col("d_all").alias("total_docs"),
        F.col("t_all").alias("total_tokens"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_total, dropped_tokens for any limits, from the histogram."""
    rows = hist.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    n, cut = F.col("n_docs"), F.least("length", "limit")
    return (
        rows.join(hist.select("length", "n_docs"), F.lit(True), "left")  # limits are few: a nested loop over a broadcast list
        .groupBy("limit")
        .agg(
            F.coalesce(F.sum(F.when(F.col("length") > F.col("limit"), n)), F.lit(0)).alias("docs_over"),
            F.coalesce(F.sum(cut * n), F.lit(0)).alias("truncated_total"),
            F.coalesce(F.sum((F.col("length") - cut) * n), F.lit(0)).alias("dropped_tokens"),
        )
    )


def quantile_length(hist: DataFrame, q: float) -> DataFrame:
    """The least length such that a share q of all documents is no longer."""
    return hist.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))
