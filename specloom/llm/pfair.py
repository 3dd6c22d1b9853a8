"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in doc_id order, are cut into blocks.  With a weight w, its part of
all weights, its block j (from 0) is released at slot floor(j / w) and due by slot
ceil((j + 1) / w); earliest deadline first among the released fills the slots, meets every
deadline, and so keeps each source within less than one block of its weight at every slot
until it has run out, however long the corpus.  Weights are whole numbers in the exact
ratio of the floats given, so nothing is rounded and nothing repeats.  One task walks
through the blocks of the whole corpus and writes the schedule as a table, a row for each
block; it holds a few numbers for each source, whose counts it reads as a table.  A source that has run out leaves its slots
to blocks already released, or idle: each document is placed exactly once.

Null is a source of its own. Sources without a given weight get
one slot in ``period`` each, taken off the largest weights.
Equal doc_ids of one source stand together, in the order of their whole rows' hash; null
doc_ids come first. Repeated rows are placed each. No rows: no slots. Other columns are
not read by ``schedule``; ``interleave`` keeps all columns as they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import batched
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm._common import from_files, materialise


def shares(weights: dict, period: int) -> dict:
    """Whole slots of one period for each source, one at least, that add up to it: largest remainders first. ``schedule`` does not round so."""
    total = float(sum(weights.values()))
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must be positive")
    names = sorted(weights, key=str)
    exact = {n: weights[n] / total * period for n in names}
    out = {n: max(1, int(exact[n])) for n in names}
    while (gap := period - sum(out.values())) > 0:
        for n in sorted(names, key=lambda n: (out[n] - exact[n], str(n)))[:gap]:
            out[n] += 1
    while (gap := sum(out.values()) - period) > 0:
        out[max(names, key=lambda n: (out[n] - exact[n] if out[n] > 1 and exact[n] > 1 else -1, out[n], str(n)))] -= 1
    return out


def exact_weights(weights: dict, period: int) -> dict:
    """Whole numbers in the exact ratio of ``weights``; those of zero get one in ``period``, which caps the largest others."""
    parts = {n: Fraction(w) for n, w in weights.items()}
    if not parts or min(parts.values()) < 0 or not (total := sum(parts.values())):
        raise ValueError("weights must be positive")
    if none := [n for n, w in parts.items() if not w]:
        given = sorted((w / total for w in parts.values() if w), reverse=True)
        cap, above = given[0], Fraction(-len(none), period)
        for k, w in enumerate(given, 1):
            above += w
            cap = above / k  # the k largest share what is left of their sum
            if k == len(given) or cap >= given[k]:
                break
        if cap <= 0:
            raise ValueError("too short a period")
        parts = {n: min(w / total, cap) if w else Fraction(1, period) for n, w in parts.items()}
    unit = lcm(*{w.denominator for w in parts.values()})
    return {n: int(w * unit) for n, w in parts.items()}


def in_slots(weights: dict, blocks: dict) -> Iterator[tuple[object, int, int]]:
    """(source, its block's number, slot) of all blocks in the order of slots, earliest deadline first; ``weights`` are whole numbers."""
    total = sum(weights.values())
    waiting = [(0, str(n), n, 0) for n in weights if blocks[n]]  # by release
    heapq.heapify(waiting)
    ready: list = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])  # idle until then
        while waiting and waiting[0][0] <= t:
            _, text, n, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[n]), text, n, j))
        deadline, text, n, j = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        yield n, j, t
        if j + 1 < blocks[n]:
            heapq.heappush(waiting, ((j + 1) * total // weights[n], text, n, j + 1))
        t += 1


def one_period(slots: dict) -> list[tuple[object, int]]:
    """(source, its block's number) in each slot of a period of whole slots."""
    return [(n, j) for n, j, _ in in_slots(slots, slots)]


_SCHEDULE = pa.schema([("source_key", pa.string()), ("block", pa.int64()), ("slot", pa.int64())])


def _schedule(weights: dict | None, block_docs: int, period: int, temperature: float):
    """From (source_key, count) of all sources, in one task, the schedule's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {n: c for batch in batches for n, c in zip(*(batch.column(k).to_pylist() for k in range(2)))}
        if not counts:
            return
        wanted = target_weights(counts, temperature)
        if weights is not None:
            wanted = {n: weights.get(n, 0.0) for n in counts}
            wanted = wanted if any(wanted.values()) else dict.fromkeys(counts, 1.0)
        exact = exact_weights(wanted, max(period, 8 * len(counts)))
        for rows in batched(in_slots(exact, {n: -(-c // block_docs) for n, c in counts.items()}), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEDULE.types)], schema=_SCHEDULE)

    return run


def _key(column: str = "source"):
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")).alias("source_key")


def target_weights(counts: dict, temperature: float) -> dict:
    """Each source's number of documents to the power of ``temperature``."""
    return {n: c**temperature for n, c in counts.items()}


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their 0-based rank in their source; a hot source lies in many ranges, whose counts are added up first."""
    order = ["source_key", "doc_id", "tie"]
    ranges = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "source-ranges")
    counts = ranges.groupBy("source_key", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_key", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range", "source_key").orderBy("doc_id", "tie")
    return ranges.withColumn("own", F.row_number().over(inside) - 1).join(starts, ["source_key", "range"]).withColumn("rank", F.col("own") + F.col("start")).drop("own", "start", "range")


def _placed(rows: DataFrame, weights: dict | None, block_docs: int, period: int, temperature: float) -> DataFrame:
    """``rows`` (source_key, doc_id, tie and more) with block, slot and position."""
    given = weights if weights is None else {"" if n is None else f"={n}": w for n, w in weights.items() if w > 0}
    counts = rows.groupBy("source_key").count().repartition(1)
    table = counts.mapInArrow(_schedule(given, block_docs, period, temperature), "source_key string, block long, slot long")
    ranked = _ranked(rows).withColumn("block", F.floor(F.col("rank") / block_docs))
    # shuffled at every size alike: both sides grow with the corpus
    placed = ranked.join(table.hint("merge"), ["source_key", "block"])
    return placed.withColumn("position", (F.col("rank") % block_docs).cast("long")).drop("rank")


def schedule(docs: DataFrame, weights: dict | None = None, block_docs: int = 32, period: int = 4096, temperature: float = 0.7) -> DataFrame:
    """doc_id, source, block, slot, position: (slot, position) is the order of the mixture.

    ``weights``: target weights by source; without them the source sizes to the power of
    ``temperature``. ``period``: in so many slots a source without a given weight has one.
    """
    rows = docs.select(_key(), F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("tie", F.lit(0))
    return _placed(rows, weights, block_docs, period, temperature).select("doc_id", "source", "block", "slot", "position")


def interleave(docs: DataFrame, weights: dict | None = None, block_docs: int = 32, period: int = 4096, temperature: float = 0.7) -> DataFrame:
    """All rows and columns of ``docs``, globally sorted by (slot, position): written files follow the mixture."""
    if not from_files(docs):
        docs = materialise(docs, "mix-input")
    fp, at = F.xxhash64("_metadata.file_path").alias("fp"), F.col("_metadata.row_index").alias("row")
    rows = docs.select(_key(), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text")).alias("tie"), fp, at)
    placed = _placed(rows, weights, block_docs, period, temperature).select("fp", "row", "slot", "position")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    marked = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names)), fp, at)
    return marked.join(placed.hint("merge"), ["fp", "row"]).sort("slot", "position").select(*(F.col(k).alias(c) for k, c in zip(names, docs.columns)))
