"""Suffix-array dedup over bytes with a logarithmic family of stored indexes.

A string of ``length`` bytes that starts in two places is found by sparse suffix arrays.
Of each ``reach`` neighbouring positions that with the least hash of its 8 bytes is an
*anchor*; it depends on these bytes alone, so equal strings have theirs at the same distance.
Suffixes at anchors are indexed, about 2 of every ``reach + 1``, in the order of their first
``core`` bytes, which are stored.  An entry also has two fingerprints: the *tail*, of the bytes
from the anchor on that every string with this anchor contains, and the *zone*, of all
bytes of all strings with this anchor and where it stands in them.

``SuffixIndex`` is a folder of levels.  A level is one suffix array, cut into parts by a hash of
the first 32 bytes (equal cores are in one part, each part in byte order); a row of its table is a
part.  ``add`` takes a batch of documents: each chunk's suffixes are sorted, and each part merges
them with the stored levels' parts in one scan.  Where a core of the batch stands elsewhere, in the
batch or in a level, both sides are told.  The batch then becomes a level; levels of as many batches
merge, as in a binary counter, so n batches leave about log2(n) levels.  What is told of an entry:

* SEEN: its core stands elsewhere too;
* ALL: its core, tail and zone do, so all strings with this anchor are repeats;
* TELL: core and tail stand before another zone, at an end of a repeat: some strings may be
  repeats.  These alone are compared by 64-bit hashes of their ``length`` bytes, whole.

An old entry is told once of each, by the scan that changes what is known of it: it keeps its
first chunk, and more occurrences were told when they came.  Whatever the batches, the results
are those of one batch.

Rows: each input row gives one row; null and empty texts have no bytes. Strings shorter
than ``length`` never match. Repeated rows match each other, whatever their doc_id, null
included. No rows: none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm._common import BYTE_CODES, Layout, blobs, by_chunk, find, group_starts, materialise, mix, new_path, pack, planes, powers, prefix_sums, run_hash, slices, small_batches, split_parts, table, text_bytes, tidied, tidy, unpack, unplanes
from specloom.sources.tables import delete

POSITION_BITS = 28
SEEN, ALL, TELL = 1, 2, 4
KEY_BYTES = 32
NO_STRING = np.uint64(1 << 32)  # the tail of an anchor that no whole string has


@dataclass(frozen=True)
class Sampling:
    """What is indexed. Any repeat of ``reach + core - 1`` bytes has an anchor whose core lies inside it."""

    length: int = 400
    reach: int = 128
    core: int = 64

    def __post_init__(self) -> None:
        if not (8 <= self.core <= self.length - self.reach + 1 and self.reach >= 1):
            raise ValueError("needs 8 <= core <= length - reach + 1")


class Anchors:
    """Anchors of a run of documents, with the strings that have each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, by: Sampling):
        n, length, reach, core = len(data), by.length, by.reach, by.core
        end = np.repeat(offsets[1:], np.diff(offsets))
        windows = np.flatnonzero(np.arange(n) + (reach - 1 + core) <= end)
        self.by, self.data, self.sums = by, data, prefix_sums(BYTE_CODES[data])
        self.at = self.first = self.last = self.group = self.starts = np.zeros(0, np.int64)
        self.zone = self.tail = np.zeros(0, np.uint64)
        if not len(windows):
            return
        grams = np.ndarray((n - 7,), np.dtype("<u8"), np.ascontiguousarray(data).data, strides=(1,))
        low = np.uint64((1 << POSITION_BITS) - 1)
        order = mix(grams) & ~low | np.arange(n - 7, dtype=np.uint64)
        blocks = -(-len(order) // reach)
        padded = np.full(blocks * reach, np.iinfo(np.uint64).max)
        padded[: len(order)] = order
        rows = padded.reshape(blocks, reach)
        after = np.minimum.accumulate(rows, axis=1).reshape(-1)
        before = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        anchor = (np.minimum(before[windows], after[windows + reach - 1]) & low).astype(np.int64)
        new = group_starts(anchor)  # anchors of ascending windows ascend; those of two documents differ
        self.at = anchor[new]
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(anchor))))
        whole = windows + length <= end[windows]
        self.starts, self.group = windows[whole], group[whole]  # strings, and the anchor of each
        count = np.bincount(self.group, minlength=len(new))
        self.first = self.starts[np.minimum(np.searchsorted(self.group, np.arange(len(new))), max(0, len(self.starts) - 1))] if len(self.starts) else np.zeros(len(new), np.int64)
        self.last = self.first + count - 1  # the windows of an anchor are neighbours
        some = count > 0
        self.first, self.last = np.where(some, self.first, self.at), np.where(some, self.last, self.at - length)
        self.tail = np.full(len(new), NO_STRING)
        self.tail[some] = run_hash(self.sums, self.at[some], self.at[some] + length - reach + 1) >> np.uint64(40)
        self.zone = run_hash(self.sums, self.at, self.at + core)
        self.zone[some] = run_hash(self.sums, self.first[some], self.last[some] + length) ^ mix((self.at - self.first)[some].astype(np.uint64), 7)

    def cores(self) -> np.ndarray:
        return self.data[self.at[:, None] + np.arange(self.by.core)]

    def strings(self, of: np.ndarray) -> np.ndarray:
        """Hashes of the strings at these places in ``starts``."""
        at = self.starts[of]
        return run_hash(self.sums, at, at + self.by.length)


@dataclass
class Suffixes:
    """Suffixes in byte order of their cores: (n, core) bytes, tail, zone, whether it stands twice or more, and a chunk that has it."""

    core: np.ndarray
    tail: np.ndarray
    zone: np.ndarray
    many: np.ndarray
    chunk: np.ndarray

    def __len__(self) -> int:
        return len(self.zone)

    def take(self, at) -> Suffixes:
        return Suffixes(self.core[at], self.tail[at], self.zone[at], self.many[at], self.chunk[at])

    @staticmethod
    def joined(arrays: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(a, n) for a in arrays]) for n in ("core", "tail", "zone", "many", "chunk")))


def suffix_order(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """The order by core, tail and zone, and the number of each one's core in it. Sorted runs one after the other are merged."""
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.ascontiguousarray(s.core).view(f"S{s.core.shape[1]}").ravel()
    order = np.argsort(text, kind="stable")
    held = text[order]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])
    order = np.lexsort((s.zone, s.tail, rank))
    return order, rank[order]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def distinct(s: Suffixes, order: np.ndarray, rank: np.ndarray) -> Suffixes:
    """Each suffix once; the chunk is that of its first entry."""
    t = s.take(order)
    at = np.flatnonzero(_new(rank, t.tail, t.zone))
    count = np.add.reduceat(1 + t.many.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    out = t.take(at)
    out.many = count > 1
    return out


def merge_scan(batch: Suffixes, levels: list[Suffixes], merged: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Suffixes]:
    """One scan of a batch (a run for each chunk) against the levels: (chunk, zone, flags) of what is newly
    known, and the level that the batch and the last ``merged`` levels make up."""
    s = Suffixes.joined([*levels, batch])
    source = np.repeat(np.arange(len(levels) + 1), [*map(len, levels), len(batch)])
    order, rank = suffix_order(s)
    s, source = s.take(order), source[order]
    weight = 1 + s.many.astype(np.int64)
    n_cores = int(rank[-1]) + 1 if len(rank) else 0
    new_class, new_group = _new(rank, s.tail, s.zone), _new(rank, s.tail)
    cls, group = np.cumsum(new_class) - 1, np.cumsum(new_group) - 1
    n_groups = int(group[-1]) + 1 if len(group) else 0
    in_class = np.bincount(cls, weights=weight) if len(cls) else np.zeros(0)
    in_core = np.bincount(rank, weights=weight, minlength=n_cores)
    zones = np.bincount(group[new_class], minlength=n_groups)
    touched = np.zeros(n_cores, bool)
    touched[rank[source == len(levels)]] = True
    flags = SEEN * (in_core[rank] > 1) + ALL * (in_class[cls] > 1) + TELL * (new_class & (zones[group] > 1))
    flags[~touched[rank]] = 0
    for k in range(len(levels)):  # what a level has told of itself is not told again
        mine = np.flatnonzero(source == k)
        own_core = np.bincount(rank[mine], weights=weight[mine], minlength=n_cores)[rank[mine]] > 1
        own_zones = np.bincount(group[mine], minlength=n_groups)[group[mine]] > 1
        flags[mine] &= ~(SEEN * own_core + ALL * s.many[mine] + TELL * own_zones)
    told = np.flatnonzero(flags)
    joins = np.flatnonzero(source >= len(levels) - merged)
    level = distinct(s.take(joins), np.arange(len(joins)), rank[joins])
    return s.chunk[told], s.zone[told], flags[told].astype(np.uint8), level


_ROW = [("part", pa.int64()), ("level", pa.int32()), ("n", pa.int64()), ("core", pa.binary()), ("tail", pa.binary()), ("zone", pa.binary()), ("many", pa.binary()), ("chunks", pa.binary()), ("held", pa.binary())]
_ROWS = pa.schema(_ROW)
ROWS = "part long, level int, n long, core binary, tail binary, zone binary, many binary, chunks binary, held binary"
_TOLD = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("flags", pa.binary()), *_ROW])
TOLD = "kind string, chunk long, flags binary, " + ROWS
BATCH = 1 << 30  # as a level: later than all others
_ZSTD = pa.Codec("zstd", compression_level=1)


def _packed(part: int, level: int, s: Suffixes) -> list:
    chunks, held = np.unique(s.chunk, return_inverse=True)
    core = _ZSTD.compress(np.ascontiguousarray(s.core).tobytes(), asbytes=True)
    return [part, level, len(s), core, planes(s.tail), planes(s.zone), np.packbits(s.many).tobytes(), chunks.astype("<i8").tobytes(), planes(held.astype(np.uint64))]


def _unpacked(row: dict, width: int) -> Suffixes:
    n = row["n"]
    core = np.frombuffer(_ZSTD.decompress(row["core"], n * width, asbytes=True), np.uint8).reshape(n, width)
    many = np.unpackbits(np.frombuffer(row["many"], np.uint8))[:n].astype(bool)
    return Suffixes(core, unplanes(row["tail"]), unplanes(row["zone"]), many, np.frombuffer(row["chunks"], "<i8")[unplanes(row["held"]).astype(np.int64)])


def _parts(core: np.ndarray, bits: int) -> np.ndarray:
    """The part of each suffix, by a hash of its first bytes."""
    up, _ = powers(KEY_BYTES)
    key = np.zeros(len(core), np.uint64)
    for k in range(min(KEY_BYTES, core.shape[1])):
        key += BYTE_CODES[core[:, k]] * up[k]
    return (mix(key) >> np.uint64(64 - bits)).astype(np.int64)


def _dealt(s: Suffixes, bits: int, level: int) -> Iterator[list]:
    """Rows of a suffix array cut into parts."""
    part = _parts(s.core, bits)
    order = np.argsort(part, kind="stable")
    at = group_starts(part[order])
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
        yield _packed(int(part[order[a]]), level, s.take(order[a:b]))


def _pieces(t: pa.Table, by: Sampling) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, Anchors]]:
    for at, n in slices(t, "text", 300_000):  # about 150 bytes of arrays for each byte
        piece = t.slice(at, n)
        data, offsets = text_bytes(piece.column("text"))
        yield piece, data, offsets, Anchors(data, offsets, by)


def _emit_suffixes(by: Sampling, bits: int):
    @tidied
    def run(batches):
        for t in by_chunk(batches):
            chunk = t.column("chunk")[0].as_py()
            found = [Suffixes(a.cores(), a.tail, a.zone, np.zeros(len(a.at), bool), np.full(len(a.at), chunk)) for _, _, _, a in _pieces(t, by)]
            s = Suffixes.joined(found)
            rows = list(_dealt(distinct(s, *suffix_order(s)), bits, BATCH))
            if rows:
                yield from table(_ROWS, list(zip(*rows))).to_batches()

    return run


def _cut_finer(by: Sampling, bits: int):
    """Rows of a level that was written with fewer parts."""

    def run(batches):
        for batch in batches:
            for row in pa.Table.from_batches([batch]).to_pylist():
                yield from table(_ROWS, list(zip(*_dealt(_unpacked(row, by.core), bits, row["level"])))).to_batches()

    return run


def _scan_part(by: Sampling, merged: int, keep: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("level", "ascending")])
        rows = t.to_pylist()
        held: dict[int, list[Suffixes]] = {}
        for row in rows:
            held.setdefault(row["level"], []).append(_unpacked(row, by.core))
        none = Suffixes(np.zeros((0, by.core), np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64))
        batch = Suffixes.joined(held.pop(BATCH, [none]))
        numbers = sorted(held)
        levels = [Suffixes.joined(held[k]) for k in numbers]
        chunk, zone, flags, level = merge_scan(batch, levels, sum(k >= merged for k in numbers))
        order = np.lexsort((zone, chunk))
        at = group_starts(chunk[order])
        out = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)]):
            mine = order[a:b]
            row = dict.fromkeys(_TOLD.names) | {"kind": "told", "chunk": int(chunk[mine[0]]), "zone": pack(zone[mine]), "flags": flags[mine].tobytes()}
            out.append(row)
        if keep and len(level):
            out.append(dict.fromkeys(_TOLD.names) | {"kind": "level"} | dict(zip(_ROWS.names, _packed(rows[0]["part"], 0, level))))
        tidy(1.0)
        return pa.Table.from_pylist(out, _TOLD)

    return run


@dataclass
class SuffixIndex:
    """Levels, the oldest first: (folder, batches in it, bits of its parts). ``bits``: those of parts to come."""

    spark: SparkSession
    path: str
    by: Sampling
    bits: int
    levels: list[tuple[str, int, int]] = field(default_factory=list)

    def save(self) -> None:
        """Write the list of levels beside them; ``opened`` reads the last one written."""
        rows = [(k, *level) for k, level in enumerate(self.levels)] or [(0, None, 0, 0)]
        number = 1 + max([0, *self._numbers(self.spark, self.path)])
        described = self.spark.createDataFrame(rows, "place int, folder string, batches int, level_bits int")
        described.withColumns({k: F.lit(v) for k, v in (("bits", self.bits), ("length", self.by.length), ("reach", self.by.reach), ("core", self.by.core))}).coalesce(1).write.parquet(f"{self.path}/levels-{number}")

    @staticmethod
    def _numbers(spark: SparkSession, path: str) -> list[int]:
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/levels-*/_SUCCESS")
        found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return [int(str(f.getPath().getParent().getName()).rpartition("-")[2]) for f in found]

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> SuffixIndex:
        rows = sorted(spark.read.parquet(f"{path}/levels-{max(cls._numbers(spark, path))}").collect(), key=lambda r: r.place)
        r = rows[0]
        return cls(spark, path, Sampling(r.length, r.reach, r.core), r.bits, [(r.folder, r.batches, r.level_bits) for r in rows if r.folder])

    def add(self, chunks: DataFrame, keep: bool = True) -> DataFrame:
        """Add a batch, (chunk, text) rows with ``chunk`` as ``Layout`` names them; (chunk, zone, flags) of what became known by it.

        ``keep``: the batch joins the index; without, it is only scanned against it. Levels that
        merge are deleted: ``save`` afterwards.
        """
        merged, batches = len(self.levels), 1
        while merged and self.levels[merged - 1][1] <= batches:
            merged -= 1
            batches += self.levels[merged][1]
        rows = chunks.mapInArrow(_emit_suffixes(self.by, self.bits), ROWS)
        for k, (folder, _, bits) in enumerate(self.levels):
            stored = self.spark.read.schema(ROWS).parquet(f"{self.path}/{folder}/kind=level").withColumn("level", F.lit(k))
            rows = rows.unionByName(stored if bits == self.bits else stored.mapInArrow(_cut_finer(self.by, self.bits), ROWS))
        folder = f"batch-{uuid.uuid4().hex}"
        with small_batches(self.spark):
            rows.groupBy("part").applyInArrow(_scan_part(self.by, merged, keep), TOLD).write.partitionBy("kind").parquet(f"{self.path}/{folder}")
        read = self.spark.read.schema(TOLD).option("basePath", f"{self.path}/{folder}")
        told = read.parquet(f"{self.path}/{folder}").filter("kind = 'told'").select("chunk", "zone", "flags")
        if keep:
            gone = self.levels[merged:]
            if not read.parquet(f"{self.path}/{folder}").filter("kind = 'level'").isEmpty():
                self.levels[merged:] = [(folder, batches, self.bits)]
                for old, _, _ in gone:
                    delete(self.spark, f"{self.path}/{old}/kind=level")
        return told


def _flags(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ascending zones of a chunk and all that was told of each."""
    rows = [(unpack(z), np.frombuffer(f, np.uint8)) for z, f in zip(blobs(answers, "zone"), blobs(answers, "flags")) if z is not None]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    zone, flags = (np.concatenate(x) for x in zip(*rows))
    order = np.argsort(zone, kind="stable")
    at = group_starts(zone[order])
    return zone[order][at], np.bitwise_or.reduceat(flags[order], at) if len(at) else flags


def _flags_of(anchors: Anchors, zone: np.ndarray, flags: np.ndarray) -> np.ndarray:
    if not len(zone) or not len(anchors.at):
        return np.zeros(len(anchors.at), np.uint8)
    place, there = find(zone, anchors.zone)
    return np.where(there, flags[place], 0)


STRINGS = "part long, chunk long, keys binary, more binary"
_STRINGS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])


def _emit_strings(by: Sampling, parts: int):
    """Hashes of the strings of anchors that are to TELL, and whether the chunk knows of two."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        zone, flags = _flags(answers)
        found = []
        if (flags & TELL).any():
            for _, _, _, a in _pieces(docs, by):
                mine = _flags_of(a, zone, flags)
                of = np.flatnonzero((mine & TELL > 0)[a.group])
                found.append((a.strings(of), np.where(mine[a.group[of]] & ALL > 0, 2, 1)))
        if found:
            k, n = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(k, kind="stable")
            at = group_starts(k[order])
            k, n = k[order][at], np.add.reduceat(n[order], at) > 1 if len(at) else n
            for part, s in split_parts(k, parts):
                for column, v in zip(out, (part, docs.column("chunk")[0].as_py(), pack(k[s]), np.packbits(n[s]).tobytes())):
                    column.append(v)
        tidy(1.0)
        return table(_STRINGS, out)

    return run


ANSWER = "chunk long, zone binary, flags binary, keys binary"
_ANSWER = pa.schema([("chunk", pa.int64()), ("zone", pa.binary()), ("flags", pa.binary()), ("keys", pa.binary())])


def _judge_strings(t: pa.Table) -> pa.Table:
    """For each chunk, those of its strings that stand twice or more."""
    keys = [unpack(b) for b in blobs(t, "keys")]
    more = [np.unpackbits(np.frombuffer(b, np.uint8))[: len(k)].astype(np.int64) for b, k in zip(blobs(t, "more"), keys)]
    every, n = np.concatenate(keys), 1 + np.concatenate(more)
    order = np.argsort(every, kind="stable")
    at = group_starts(every[order])
    twice = every[order][at][np.add.reduceat(n[order], at) > 1]
    out: list[list] = [[], [], [], []]
    for chunk, k in zip(t.column("chunk").to_pylist(), keys):
        _, there = find(twice, k)
        if there.any():
            for column, v in zip(out, (chunk, None, None, pack(k[there]))):
                column.append(v)
    tidy(1.0)
    return table(_ANSWER, out)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("longest_seen", pa.int64())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<first:long,end:long>>, longest_seen long"


def _longest_seen(a: Anchors, seen: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document, the bytes from the first to the last of the longest run of neighbouring anchors whose cores stand elsewhere too."""
    out = np.zeros(len(offsets) - 1, np.int64)
    if not seen.any():
        return out
    doc = np.searchsorted(offsets, a.at, side="right") - 1
    begin = np.flatnonzero(seen & _new(doc, seen))
    stop = np.flatnonzero(seen & np.append(_new(doc, seen)[1:], True))
    np.maximum.at(out, doc[begin], a.at[stop] + a.by.core - a.at[begin])
    return out


def _remove(by: Sampling, with_text: bool):
    length = by.length

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _RESULT]
        zone, flags = _flags(answers)
        twice = [unpack(b) for b in blobs(answers, "keys") if b is not None]
        twice = np.unique(np.concatenate(twice)) if twice else np.zeros(0, np.uint64)
        for piece, data, offsets, a in _pieces(docs, by):
            edges = np.zeros(len(data) + 1, np.int64)
            mine = _flags_of(a, zone, flags)
            whole = (mine & ALL > 0) & (a.last >= a.first)
            np.add.at(edges, a.first[whole], 1)
            np.add.at(edges, a.last[whole] + length, -1)
            of = np.flatnonzero((mine & (ALL | TELL) == TELL)[a.group])
            repeat = a.starts[of[find(twice, a.strings(of))[1]]] if len(of) else of
            np.add.at(edges, repeat, 1)
            np.add.at(edges, repeat + length, -1)
            covered = np.cumsum(edges)[:-1] > 0
            longest = _longest_seen(a, mine & SEEN > 0, offsets)
            raw = data.tobytes()
            for doc, b, e, seen in zip(piece.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), longest.tolist()):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered[b:e].astype(np.int8), [0]]))).tolist()
                spans = list(zip(edge[::2], edge[1::2]))
                kept, at = [], b
                for x, y in spans:
                    kept.append(raw[at : b + x])
                    at = b + y
                kept = b"".join([*kept, raw[at:e]])
                for column, v in zip(out, (doc, e - b, sum(y - x for x, y in spans), len(spans), kept if with_text else None, hashlib.sha256(kept).hexdigest(), [{"first": x, "end": y} for x, y in spans], max([seen, *(y - x for x, y in spans)]))):
                    column.append(v)
        tidy(1.0)
        return table(_RESULT, out)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, reach: int | None = None, core: int | None = None, with_text: bool = True, batches: int = 3, part_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes; null without ``with_text``), kept_sha256, spans (bytes), longest_seen.

    Removed is each byte of a string of ``length`` bytes that starts elsewhere too, in the
    same document or another; strings are judged on the input.  ``longest_seen`` tells of shorter
    repeats as well: the bytes of the longest removed run, or of the longest run of neighbouring
    indexed suffixes whose first ``core`` bytes stand elsewhere too.  The documents go through a family
    of indexes in ``batches``; the last one is only scanned, as nothing comes after it.
    """
    reach = reach or max(1, min(128, length // 2))
    spark, by = docs.sparkSession, Sampling(length, reach, core or min(64, length - reach + 1))
    layout = Layout(docs, {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}, part_bytes=part_bytes)
    index = SuffixIndex(spark, new_path(spark, "suffix-index"), by, max(3, (layout.parts - 1).bit_length()))
    told = None
    for k in range(batches):
        batch = layout.docs.filter(F.pmod("chunk", F.lit(batches)) == k).select("chunk", "text")
        new = index.add(batch, keep=k < batches - 1)
        told = new if told is None else told.unionByName(new)
    chunks = layout.docs.groupBy("chunk")
    strings = chunks.cogroup(told.groupBy("chunk")).applyInArrow(_emit_strings(by, layout.parts), STRINGS)
    repeats = strings.groupBy("part").applyInArrow(_judge_strings, ANSWER)
    answers = materialise(told.withColumn("keys", F.lit(None).cast("binary")).unionByName(repeats), "suffix-repeats")
    return chunks.cogroup(answers.groupBy("chunk")).applyInArrow(_remove(by, with_text), RESULT)
