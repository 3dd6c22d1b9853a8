"""Token-ID / binary output: Re-Pair grammar compression of id shards, with random access.

``write_shards`` encodes texts and writes shards: a Parquet table with one row for each
shard.  A shard holds the documents' ids after Re-Pair: the pairs of neighbouring
symbols that occur most often are replaced by new symbols (nonterminals), round after
round, until no pair has 24 occurrences in the shard.  Stored are the rules, each rule's expansion length,
the packed symbols, and where each document begins, so a document, or a run of its ids,
is decoded without the rest.  ``read_documents`` decodes all; ``decode_range`` a part.

Order: ascending ``doc_id`` (null first, equal ids by a hash of their text). A null or empty text
is the end id alone. No rows: no shards. Repeated rows are documents of their own. Long
texts: a shard always holds whole documents, so it is as large as its largest one.
Other columns of the input, of whatever name, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm._common import new_path, numbers, plan_bytes, slices, small_batches, tidied
from specloom.llm.tokens import encoder

SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("doc_nulls", pa.binary()), ("doc_lengths", pa.binary()), ("doc_symbols", pa.binary()), ("vocab", pa.int32()), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("symbol_bytes", pa.int32()), ("symbols", pa.binary())])
SHARD_DDL = "part int, shard int, n_docs long, n_ids long, doc_ids binary, doc_nulls binary, doc_lengths binary, doc_symbols binary, vocab int, rules binary, rule_lengths binary, symbol_bytes int, symbols binary"


def compress(ids: np.ndarray, ends: np.ndarray, vocab: int, rounds: int = 3, per_round: int = 4096, least: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair. ``ends``: where each document's ids end; no pair spans two documents.

    In each round the ``per_round`` most frequent pairs with ``least`` occurrences or more
    get a nonterminal each; of overlapping occurrences that of the more frequent pair is
    replaced, in a run of one pair the first. All pairs are counted ``rounds`` times; from
    the last of these counts on ``_settle`` goes on, by the places that change, until no
    pair has ``least`` occurrences. Returns symbols, each document's end in them, the
    rules (n, 2) and the number of ids each rule stands for.
    """
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    lengths = [np.ones(vocab, np.int64)]
    n_rules = 0
    for turn in range(rounds):
        if len(s) < 2:
            break
        key = s[:-1].astype(np.uint64) << np.uint64(32) | s[1:]
        inner = ~last[:-1]
        ordered = np.sort(key[inner])
        at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(ordered)))
        often = np.flatnonzero(count >= least)
        if turn == rounds - 1:
            s, last = _settle(s, last, _places(key, inner, ordered[at[often]]), vocab, rules, lengths, per_round, least)
            break
        often = often[np.argsort(-count[often], kind="stable")][: min(per_round, (1 << 31) - vocab - n_rules)]
        if not len(often):
            break
        pair = ordered[at[often]]  # the rank of a pair is its index
        slot = (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        _, first = np.unique(slot, return_index=True)  # of pairs with one slot, the most frequent is replaced in this round
        first.sort()
        pair, slot = pair[first], slot[first]
        slots, ranks = np.zeros(1 << 16, np.uint64), np.full(1 << 16, len(pair), np.int32)
        slots[slot], ranks[slot] = pair, np.arange(len(pair), dtype=np.int32)
        mine = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        hit = (slots[mine] == key) & inner
        rank = np.where(hit, ranks[mine], np.int32(len(pair)))
        none = np.full(1, len(pair), np.int32)
        before, after = np.concatenate([none, rank[:-1]]), np.concatenate([rank[1:], none])
        take = np.flatnonzero(hit & (rank < before) & (rank <= after))
        s[take] = np.uint32(vocab + n_rules) + rank[take].astype(np.uint32)
        last[take] = last[take + 1]
        keep = np.ones(len(s), bool)
        keep[take + 1] = False
        s, last = s[keep], last[keep]
        new = np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        known = np.concatenate(lengths)
        rules.append(new)
        lengths.append(known[new[:, 0]] + known[new[:, 1]])
        n_rules += len(new)
    all_rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return s, np.flatnonzero(last) + 1, all_rules, np.concatenate(lengths)[vocab:]


def _places(key: np.ndarray, inner: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where ``key`` is one of the ascending ``pairs``."""
    mark = np.zeros(1 << 16, bool)
    mark[(pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)] = True
    at = np.flatnonzero(mark[(key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)] & inner)
    return at[pairs[np.minimum(np.searchsorted(pairs, key[at]), len(pairs) - 1)] == key[at]] if len(pairs) else at[:0]


def _settle(s: np.ndarray, last: np.ndarray, at: np.ndarray, vocab: int, rules: list, lengths: list, per_round: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounds until no pair has ``least`` occurrences; ``at``: the places of all pairs that have, ascending.

    A pair without a new symbol only loses occurrences, and one with a new symbol stands
    beside a replacement, so no other place is looked at again. Every other pair of a run
    of one pair is replaced. Appends to ``rules`` and ``lengths``.
    """
    n = len(s)
    s, last = np.append(s, np.uint32(0)), np.append(last, True)  # place n stands for both ends
    after, before = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n)
    before[0] = n
    live = np.ones(n + 1, bool)
    none = np.iinfo(np.int32).max
    rank_at = np.full(n + 1, none, np.int32)
    n_rules = sum(map(len, rules))
    known = np.concatenate(lengths)
    while True:
        key = s[at].astype(np.uint64) << np.uint64(32) | s[after[at]]
        pair, which, count = np.unique(key, return_inverse=True, return_counts=True)
        at, which = at[count[which] >= least], which[count[which] >= least]
        if not len(at):
            break
        often = np.flatnonzero(count >= least)
        often = often[np.argsort(-count[often], kind="stable")][: min(per_round, (1 << 31) - vocab - n_rules)]
        if not len(often):
            break  # all symbols are given
        ranks = np.full(len(pair), none, np.int32)
        ranks[often] = np.arange(len(often), dtype=np.int32)
        rank = rank_at[at] = ranks[which]
        left = rank_at[before[at]]
        step = np.arange(len(at))
        odd = (step - np.maximum.accumulate(np.where(rank == left, 0, step))) & 1
        take = (rank < none) & (rank <= left) & (rank <= rank_at[after[at]]) & (odd == 0)
        rank_at[at] = none
        used, rule = np.unique(rank[take], return_inverse=True)
        here = at[take]
        gone = after[here]
        beyond = after[gone]
        s[here] = (vocab + n_rules + rule).astype(np.uint32)
        last[here] = last[gone]
        live[gone] = False
        after[here], before[beyond] = beyond, here
        new = pair[often[used]]
        new = np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        rules.append(new)
        lengths.append(known[new[:, 0]] + known[new[:, 1]])
        known = np.concatenate([known, lengths[-1]])
        n_rules += len(new)
        at = np.union1d(at[live[at]], np.concatenate([here, before[here]]))
        at = at[~last[at]]
    return s[live][:-1], last[live][:-1]


def _unroll(symbols: np.ndarray, vocab: int, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: all nonterminals are replaced at once, level by level."""
    s = symbols.astype(np.uint32)
    while len(big := np.flatnonzero(s >= vocab)):
        width = np.ones(len(s), np.int64)
        width[big] = 2
        end = np.cumsum(width)
        out = np.empty(end[-1], np.uint32)
        out[end - 1] = s
        pair = rules[s[big] - vocab]
        out[end[big] - 2], out[end[big] - 1] = pair[:, 0], pair[:, 1]
        s = out
    return s


def expand(symbols: np.ndarray, vocab: int, rules: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for. With the rules' expansion ``lengths`` each rule is unrolled once and copied."""
    big = np.flatnonzero(symbols >= vocab)
    if lengths is None or not len(big):
        return _unroll(symbols, vocab, rules)
    texts = _unroll(np.arange(vocab, vocab + len(rules)), vocab, rules)
    size = lengths.astype(np.int64)
    begin = np.cumsum(size) - size
    rule = symbols[big].astype(np.int64) - vocab
    width = np.ones(len(symbols), np.int64)
    width[big] = size[rule]
    end = np.cumsum(width)
    out = np.empty(end[-1], np.uint32)
    out[end - 1] = symbols  # right for terminals; the others' places are written next
    w = width[big]
    upto = np.cumsum(w)
    run = np.arange(upto[-1])
    out[run + np.repeat(end[big] - upto, w)] = texts[run + np.repeat(begin[rule] - (upto - w), w)]
    return out


def _shard(part: int, number: int, ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, vocab: int) -> list:
    symbols, ends, rules, lengths = compress(ids, np.cumsum(counts), vocab)
    width = 2 if vocab + len(rules) <= 1 << 16 else 4
    return [part, number, len(counts), len(ids), doc_ids.astype("<i8").tobytes(), np.packbits(nulls).tobytes(), counts.astype("<u4").tobytes(), ends.astype("<u4").tobytes(), vocab, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), width, symbols.astype(f"<u{width}").tobytes()]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, order: list | None = None, shard_ids: int = 1 << 20, part_bytes: int = 16 << 20) -> DataFrame:
    """Encode ``doc_id, text`` with a tokenizer definition and write shards; returns the shard table, read back.

    ``order``: columns to order by in place of ``doc_id``. ``shard_ids``: a shard is closed
    at so many ids. ``part_bytes``: input for each range partition, about.
    """
    spark = docs.sparkSession
    order = order or ["doc_id"]
    slim = docs.select(*(F.col(c) if isinstance(c, str) else c for c in order if not (isinstance(c, str) and c == "doc_id")), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [c for c in slim.columns if c not in ("doc_id", "text")]
    keys = [*names, "doc_id"]
    text = spark.sparkContext.broadcast(tokenizer)
    size = plan_bytes(slim) or slim.count() * 4096
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // part_bytes))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, number = encoder(text.value), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        total = 0

        def close():
            nonlocal held, total, number
            ids, counts, docs_, nulls = (np.concatenate(x) for x in zip(*held))
            out = _shard(part, number, ids, counts, docs_, nulls, enc.size)
            held, total, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, SHARD)], schema=SHARD)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            for at, n in slices(t, "text"):
                piece = t.slice(at, n)
                ids, counts = enc.encode(piece.column("text"))
                ends = np.cumsum(counts)
                whole = np.insert(ids, ends, np.uint32(end_id))
                ends = ends + np.arange(1, n + 1)
                null = piece.column("doc_id").is_null().to_numpy()
                begin = 0
                while begin < n:  # cut into shards at document ends
                    base = ends[begin - 1] if begin else 0
                    stop = min(n, max(begin + 1, int(np.searchsorted(ends, base + shard_ids - total, side="right"))))
                    held.append((whole[base : ends[stop - 1]], np.diff(ends[begin:stop], prepend=base), numbers(piece.column("doc_id"), 0)[begin:stop], null[begin:stop]))
                    total += int(ends[stop - 1] - base)
                    begin = stop
                    if total >= shard_ids or begin < n:
                        yield close()
        if held:
            yield close()

    # by xxhash64(text), rows whose keys are equal spread over several ranges and have an order: theirs is free among equal texts
    dealt = slim.withColumn("_tie", F.xxhash64("text")).repartitionByRange(parts, *keys, "_tie").sortWithinPartitions(*keys, "_tie")
    shards = dealt.select("doc_id", "text").mapInArrow(run, SHARD_DDL)
    path = path or new_path(spark, "token-shards")
    with small_batches(spark):
        shards.write.parquet(path)
    return spark.read.schema(shards.schema).parquet(path)


def _doc_ids(row: dict) -> list:
    ids = np.frombuffer(row["doc_ids"], "<i8").tolist()
    nulls = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8))[: len(ids)].tolist()
    return [None if z else i for i, z in zip(ids, nulls)]


def _grammar(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["symbols"], f"<u{row['symbol_bytes']}"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rule_lengths"], "<u4")


def decode_range(row: dict, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids [start, stop) of the shard's document number ``doc``; only symbols that reach into the range are expanded."""
    symbols, rules, lengths = _grammar(row)
    ends = np.frombuffer(row["doc_symbols"], "<u4")
    mine = symbols[ends[doc - 1] if doc else 0 : ends[doc]].astype(np.int64)
    size = np.where(mine < row["vocab"], 1, lengths[np.maximum(mine - row["vocab"], 0)] if len(lengths) else 1)
    upto = np.cumsum(size)
    stop = int(upto[-1]) if stop is None else min(stop, int(upto[-1]))
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = int(np.searchsorted(upto, start, side="right")), int(np.searchsorted(upto, stop - 1, side="right"))
    skip = start - (int(upto[a - 1]) if a else 0)
    return expand(mine[a : b + 1], row["vocab"], rules)[skip : skip + stop - start]


def offsets(shards: DataFrame) -> DataFrame:
    """(part, shard, start): ids before each shard. Totals of parts first, so that no task reads all shards' rows."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own"))
    return own.join(base, "part").select("part", "shard", (F.col("own") + F.col("base")).alias("start"))


def read_documents(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Decode shards: doc_id, start, n_tokens, ids_crc32, n_symbols and, if asked for, the ids."""
    out = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_symbols", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(out)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                symbols, rules, lengths = _grammar(row)
                ids = expand(symbols, row["vocab"], rules, lengths).astype("<u4", copy=False)
                raw = memoryview(ids).cast("B") if len(ids) else b""
                counts = np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                cuts = list(zip((ends - counts).tolist(), ends.tolist()))
                columns = [_doc_ids(row), (row["start"] + ends - counts).tolist(), counts.tolist(), [zlib.crc32(raw[4 * a : 4 * b]) for a, b in cuts], np.diff(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64), prepend=0).tolist()]
                columns += [[ids[a:b].tolist() for a, b in cuts]] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return shards.join(offsets(shards), ["part", "shard"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_symbols long" + ", ids array<int>" * with_ids)
