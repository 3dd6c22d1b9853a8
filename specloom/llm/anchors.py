"""Substring dedup by fixed-block anchors, over words.

A document's words are cut into non-overlapping blocks of ``block`` words, counted from
its first word; these blocks are the index.  Every rolling window of ``block`` words of
every document probes it.  With ``window >= 2 * block - 1`` each run of ``window`` words
holds a whole block of the document it stands in, so a run that stands in two documents
makes a hit at the same place inside the run.  Hits are extended to the windows around
them, and windows are kept as removable when the same word sequence starts in a document
with a smaller id: neighbouring windows make up the maximal exact repeats.

Probes and blocks travel as sorted distinct 48-bit keys for each chunk and key range (a
false hit costs an extension, nothing more); extended windows are compared by 64-bit
hashes of their word sequences.

Rows: each input row gives one row. Null and empty texts have no words. A null doc_id is
larger than all others. Rows with equal doc_id remove nothing from each other. Repeated
rows give repeated results. No rows: none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm._common import Layout, Words, blobs, by_chunk, find, find_all, flat, group_starts, materialise, numbers, pack, pack_signed, slices, split_parts, table, text_bytes, tidied, tidy, unpack, unpack_signed

NEVER = np.iinfo(np.int64).max
SHIFT = np.uint64(16)
ROWS = "part int, chunk long, keys binary, docs binary, flags binary"
ANSWER = "chunk long, keys binary, docs binary"
_ROWS = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("flags", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])


def _least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ascending keys, the least document of each, and whether another document has it too."""
    order = np.argsort(keys)
    k, d = keys[order], docs[order]
    at = group_starts(k)
    if not len(at):
        return k, d, np.zeros(0, bool)
    least = np.minimum.reduceat(d, at)
    return k[at], least, np.maximum.reduceat(d, at) != least


def _merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from several triples (key, least document, more than one document)."""
    keys, docs, more = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    k, d, m = keys[order], docs[order], more[order]
    at = group_starts(k)
    if not len(at):
        return k, d, m
    least = np.minimum.reduceat(d, at)
    return k[at], least, np.logical_or.reduceat(m, at) | (np.maximum.reduceat(d, at) != least)


def _pieces(t: pa.Table) -> Iterator[tuple[pa.Table, Words, np.ndarray]]:
    """(rows, their words, each word's document id) of small runs of rows."""
    for at, n in slices(t, "text", 300_000):
        piece = t.slice(at, n)
        words = Words(*text_bytes(piece.column("text")))
        yield piece, words, numbers(piece.column("doc_id"), NEVER)[words.doc]


def _probes(words: Words, docs: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every rolling window of ``block`` words: position, 48-bit key, whether it is a block of the index."""
    at, keys = words.windows(block)
    return at, keys >> SHIFT, (at - words.first[words.doc[at]]) % block == 0


def _emit_probes(block: int, parts: int):
    @tidied
    def run(batches):
        for t in by_chunk(batches):
            found, indexed = [], []
            for _, words, docs in _pieces(t):
                at, keys, is_block = _probes(words, docs, block)
                found.append(_least(keys, docs[at]))
                indexed.append(_least(keys[is_block], docs[at][is_block]))
            if not found:
                continue
            keys, _, more = _merge(found)
            block_keys, block_docs, _ = _merge(indexed)
            place, has = find(block_keys, keys)
            out: list[list] = [[], [], [], [], []]
            for part, s in split_parts(keys, parts, 48):
                mine = has[s]
                for column, v in zip(out, (part, t.column("chunk")[0].as_py(), pack(keys[s]), pack_signed(block_docs[place[s][mine]]), np.packbits(np.stack([mine, more[s]])).tobytes())):
                    column.append(v)
            yield from table(_ROWS, out).to_batches()

    return run


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8))[: 2 * n].reshape(2, n).astype(bool)


def _answer_probes(t: pa.Table) -> pa.Table:
    """For each chunk, its keys that are a block somewhere and stand in more than one document, with the least document that has the block."""
    keys = [unpack(b) for b in blobs(t, "keys")]
    flags = [_flags(b, len(k)) for b, k in zip(blobs(t, "flags"), keys)]
    docs = []
    for b, (mine, _) in zip(blobs(t, "docs"), flags):
        d = np.full(len(mine), NEVER)
        d[mine] = unpack_signed(b)
        docs.append(d)
    every, has, more, least = np.concatenate(keys), np.concatenate([f[0] for f in flags]), np.concatenate([f[1] for f in flags]), np.concatenate(docs)
    order = np.argsort(every)
    at = group_starts(every[order])
    many = (np.diff(np.append(at, len(every))) > 1) | np.logical_or.reduceat(more[order], at)
    wanted = many & np.logical_or.reduceat(has[order], at)
    table_keys, table_docs = every[order][at][wanted], np.minimum.reduceat(least[order], at)[wanted]
    out: list[list] = [[], [], []]
    for chunk, k in zip(t.column("chunk").to_pylist(), keys):
        place, there = find(table_keys, k)
        if there.any():
            for column, v in zip(out, (chunk, pack(k[there]), pack_signed(table_docs[place[there]]))):
                column.append(v)
    tidy(1.0)
    return table(_ANSWER, out)


def _table_of(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """One ascending table of a chunk's answers."""
    keys = [unpack(b) for b in blobs(answers, "keys")]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, d = np.concatenate(keys), np.concatenate([unpack_signed(b) for b in blobs(answers, "docs")])
    order = np.argsort(k)
    at = group_starts(k[order])
    return k[order][at], d[order][at]


def _extend(block: int, window: int, parts: int):
    """Windows around the hits of a chunk, with the least document of the chunk that has each."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        index_keys, index_docs = _table_of(answers)
        found = []
        if len(index_keys):
            for _, words, ids in _pieces(docs):
                at, keys, is_block = _probes(words, ids, block)
                place, there = find_all(index_keys, keys)
                hit = np.zeros(len(words.ids) + 1, np.int64)
                hit[at] = there & (is_block | (index_docs[place] < ids[at]))
                upto = np.concatenate([[0], np.cumsum(hit)])
                starts, hashes = words.windows(window)
                near = upto[starts + window - block + 1] > upto[starts]  # a hit that lies inside the window
                found.append(_least(hashes[near], ids[starts[near]]))
        if found:
            keys, least, more = _merge(found)
            for part, s in split_parts(keys, parts):
                for column, v in zip(out, (part, docs.column("chunk")[0].as_py(), pack(keys[s]), pack_signed(least[s]), None)):
                    column.append(v)
        tidy(1.0)
        return table(_ROWS, out)

    return run


def _answer_windows(t: pa.Table) -> pa.Table:
    """For each chunk, its windows that stand in a document with a smaller id than the chunk's own."""
    keys, docs = [unpack(b) for b in blobs(t, "keys")], [unpack_signed(b) for b in blobs(t, "docs")]
    every, least, _ = _merge([(k, d, np.zeros(len(k), bool)) for k, d in zip(keys, docs)])
    out: list[list] = [[], [], []]
    for chunk, k, d in zip(t.column("chunk").to_pylist(), keys, docs):
        place, _ = find(every, k)
        lower = least[place] < d
        if lower.any():
            for column, v in zip(out, (chunk, pack(k[lower]), pack_signed(least[place[lower]]))):
                column.append(v)
    tidy(1.0)
    return table(_ANSWER, out)


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))])


def _remove(window: int, with_text: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        other_keys, other_docs = _table_of(answers)
        out: list[list] = [[], [], [], [], [], []]
        own = _merge([_least((w := words.windows(window))[1], ids[w[0]]) for _, words, ids in _pieces(docs)]) if docs.num_rows else None
        for piece, words, ids in _pieces(docs):
            starts, hashes = words.windows(window)
            least = own[1][find_all(own[0], hashes)[0]] if len(hashes) else np.zeros(0, np.int64)
            place, there = find_all(other_keys, hashes)
            if there.any():
                least = np.where(there, np.minimum(least, other_docs[place]), least)
            repeat = starts[least < ids[starts]]
            edges = np.zeros(len(words.ids) + 1, np.int64)
            np.add.at(edges, repeat, 1)
            np.add.at(edges, repeat + window, -1)
            covered = np.cumsum(edges)[:-1] > 0
            for text, doc, a, b in zip(flat(piece.column("text")).to_pylist(), piece.column("doc_id").to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist()):
                mine = covered[a:b]
                kept = text.encode().split()
                if mine.any():
                    kept = [w for w, gone in zip(kept, mine.tolist()) if not gone]
                kept = b" ".join(kept)
                for column, v in zip(out, (doc, b - a, int(mine.sum()), kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest(), [{"first": x, "end": y} for x, y in _spans(mine)])):
                    column.append(v)
        tidy(1.0)
        return table(_RESULT, out)

    return run


def remove_repeats(docs: DataFrame, block: int = 7, window: int = 13, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by a space; null without ``with_text``), kept_sha256, spans.

    ``spans``: removed runs of words, [first, end). A word goes when a window of ``window``
    words over it also starts in a document with a smaller ``doc_id``; windows are judged
    on the input.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts: window >= 2 * block - 1")
    layout = Layout(docs, {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    probes = layout.docs.mapInArrow(_emit_probes(block, layout.parts), ROWS)
    hits = materialise(probes.groupBy("part").applyInArrow(_answer_probes, ANSWER), "anchor-hits")
    by = layout.docs.groupBy("chunk")
    windows = by.cogroup(hits.groupBy("chunk")).applyInArrow(_extend(block, window, layout.parts), ROWS)
    repeats = materialise(windows.groupBy("part").applyInArrow(_answer_windows, ANSWER), "anchor-repeats")
    out = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, spans array<struct<first:long,end:long>>"
    return by.cogroup(repeats.groupBy("chunk")).applyInArrow(_remove(window, with_text), out)
