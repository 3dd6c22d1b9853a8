"""Shared pieces: materialised tables, chunking, byte arithmetic, packed key blobs.

The exact operators all face one problem: every document must be compared with all
others, yet no executor may hold more than a slice of them.  They share one shape:

1. ``with_chunk`` names a *chunk* for each row: a file and a run of row positions in
   it, the same on every evaluation, whatever the input splits.
2. each chunk emits, for every hash partition, one row with its sorted distinct keys
   (``pack``): a hot key is in a chunk's blob once, however often it occurs;
3. each hash partition merges the blobs and answers each chunk with a blob;
4. documents and answers meet again by chunk (``cogroup``).

Nothing is collected on the driver, and a lost task is computed again from its input.
"""

from __future__ import annotations

import ctypes
import gc
import time
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.sources import tables
from specloom.sources.tables import discard, new_path, shared_dir

__all__ = ["discard", "new_path", "shared_dir"]

SPACES = b" \t\n\x0b\x0c\r"


_tidied = 0.0


def tidy(every: float = 0.0) -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and what they hold counts against the executor."""
    global _tidied
    if time.monotonic() - _tidied < every:
        return
    _tidied = time.monotonic()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidied(run):
    """A generator over record batches that tidies up when its task ends."""

    @wraps(run)
    def tidying(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidying


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """For jobs that run inside: whole texts go to Python in batches of so many rows. Spark's 10,000 would
    hold tens of megabytes outside the heap, several times over while they grow, in each task."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, written with small batches."""
    with small_batches(df.sparkSession):
        return tables.materialise(df, name)


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of the size, None if it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return None if size > 1 << 56 else size


def from_files(df: DataFrame) -> bool:
    """Whether rows can name their file and their place in it (a Parquet scan)."""
    try:
        return "_metadata" not in df.columns and df.select("_metadata.file_path", "_metadata.row_index") is not None
    except AnalysisException:
        return False


class Layout:
    """Documents with a stable chunk, and how many hash partitions suit their size."""

    def __init__(self, docs: DataFrame, columns: dict[str, Column], chunk_bytes: int = 8 << 20, part_bytes: int = 8 << 20):
        """``columns``: names and expressions of what the chunks need. ``chunk_bytes``: text in a
        chunk, about; ``part_bytes``: input bytes for each hash partition, about."""
        slim = docs.select(*(c.alias(n) for n, c in columns.items()))
        if not from_files(docs):
            docs = materialise(slim, "chunk-input")
            columns = {n: F.col(n) for n in columns}
            slim = docs
        rows = max(1, docs.count())
        size = plan_bytes(slim) or rows * 4096
        self.rows_per_chunk = max(1, min(65_536, int(chunk_bytes / max(1.0, 1.7 * size / rows))))
        # a chunk's rows are never more than its keys, so any number of parts leaves the exchange linear in the input
        self.parts = max(8, size // part_bytes)
        place = F.floor(F.col("_metadata.row_index") / F.lit(self.rows_per_chunk))
        self.docs = docs.select(F.xxhash64(F.col("_metadata.file_path"), place).alias("chunk"), *(c.alias(n) for n, c in columns.items()))


def by_chunk(batches, most_rows: int = 1 << 16):
    """Tables of the rows that follow each other with one chunk, from an iterator of record batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        ids, at = b.column("chunk").to_numpy(zero_copy_only=False), 0
        for cut in [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]:
            if cut == at:
                continue
            piece = b.slice(at, cut - at)
            if held and held[0].column("chunk")[0] != piece.column("chunk")[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
            at = cut
    if held:
        yield pa.Table.from_batches(held)


def slices(table: pa.Table, column: str, most: int = 500_000):
    """(first row, rows) of runs with at most ``most`` bytes in ``column``, or one row."""
    sizes = text_lengths(table.column(column))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, base + most, side="right")) - at)
        yield at, n
        at += n


def flat(column) -> pa.Array:
    """One array with null as the empty string."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    return a.fill_null("").cast(pa.large_string())


def text_lengths(column) -> np.ndarray:
    return np.diff(text_bytes(column)[1])


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and the rows' n + 1 offsets."""
    a = flat(column)
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64, count=len(a) + 1 + a.offset)[a.offset :] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if len(a) and a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def numbers(column, null: int) -> np.ndarray:
    """int64 values with ``null`` for nulls."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    return a.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


# 64-bit arithmetic: products and sums are meant to wrap.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ np.uint64(seed & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """For polynomial hashes of any run: n + 1 wrapped sums of values times powers."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end): equal runs have equal hashes wherever they are."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of a run of documents: 64-bit ids, and each document's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        word = ~_IS_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= ~word[:-1] | edge[1:n]
            last[:-1] &= ~word[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ids = run_hash(prefix_sums(BYTE_CODES[data]), self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n words of one document start, and hashes of these words."""
        room = self.first[1:][self.doc] - np.arange(len(self.ids))
        at = np.flatnonzero(room >= n)
        return at, run_hash(prefix_sums(self.ids), at, at + n)


def planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, byte plane by byte plane, without the planes that are zero throughout."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + np.int64(len(values)).tobytes() + np.ascontiguousarray(raw.T).tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    width, n = blob[0], int(np.frombuffer(blob, np.int64, 1, 1)[0])
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(blob, np.uint8, width * n, 9).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob), dtype=np.uint64)


def pack_signed(values: np.ndarray) -> bytes:
    low = int(values.min()) if len(values) else 0
    return np.int64(low).tobytes() + planes((values.astype(np.int64) - low).view(np.uint64))


def unpack_signed(blob: bytes) -> np.ndarray:
    return unplanes(blob[8:]).view(np.int64) + np.frombuffer(blob, np.int64, 1)[0]


def split_parts(keys: np.ndarray, parts: int, bits: int = 64) -> list[tuple[int, slice]]:
    """For ascending keys below 2**bits: (part, slice) of each part that has keys; parts are key ranges."""
    high = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    part = (high * np.uint64(parts)) >> np.uint64(32)
    at = group_starts(part)
    return [(i, slice(a, b)) for i, a, b in zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)])]


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in the ascending table, and whether it is there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def find_all(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``find`` for many wanted keys in any order: they are looked up in key order, so that memory is read in order too."""
    by = np.argsort(wanted)
    at, there = find(table, wanted[by])
    place, has = np.empty(len(wanted), np.int64), np.empty(len(wanted), bool)
    place[by], has[by] = at, there
    return place, has


def fixed(column, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as a matrix of bytes."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    if not len(a):
        return np.zeros((0, width), np.uint8)
    ends = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_binary(a.type) else np.int32, count=len(a) + 1 + a.offset)[a.offset :]
    return np.frombuffer(a.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(a), width)


def blobs(table: pa.Table, column: str) -> list[bytes]:
    return table.column(column).to_pylist()


def record(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def table(schema: pa.Schema, columns: list[list]) -> pa.Table:
    return pa.Table.from_batches([record(schema, columns)])
