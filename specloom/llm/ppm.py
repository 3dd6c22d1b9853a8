"""Language-model scoring by partial matching over a byte-context trie.

The model is a trie of byte contexts of up to ``order`` bytes, with counts of the byte
that follows.  A byte is predicted in its longest context that was seen.  Escapes are estimated
by absolute discounting: each distinct follower of a context gives up ``discount`` of its count,
and what they give up is the chance of the escape to the next shorter context (method D with
one half); bytes already offered by the longer context are excluded there; at the end all
bytes left are alike.  An end symbol closes each text, so a score is the log10 probability of the
whole text.

Training covers all texts of the training fold. The trie is never gathered: chunks send
their distinct (context, byte) strings with training counts to ranges of the trie that
are kept together by the last three bytes of the context, and get the log probabilities
back. The orders 0 to 2 are the same everywhere: 2 ** 24 counts at most (ten thousands in
natural texts) are broadcast. Words and their counts, for the unigram base score, travel the same way.

Rows: each input row gives one row. Null texts are empty: only the end symbol. A null
doc_id has the empty string as its text form. No rows: none. Repeated rows train and are
scored each. Other columns are not read. Without training texts all bytes are alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm._common import LOWER, Layout, Words, blobs, by_chunk, discard, find, group_starts, materialise, mix, pack, planes, slices, split_parts, table, text_bytes, tidied, tidy, unpack, unplanes

END = 255  # never a byte of UTF-8: the end symbol, and what stands before a text
WORD, GRAM, LOW = 0, 1, 2
SHARED_ORDER = 2
ROWS = "kind int, part int, chunk long, keys binary, counts binary"
_ROWS = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
END_WORD = mix(np.array([1], np.uint64), 0xE0D)


def _fold(doc_ids: list, folds: int, held: int) -> np.ndarray:
    """True for held-out rows: crc32 of the id's text form modulo ``folds``."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == held for i in doc_ids], bool)


class Texts:
    """A run of rows: lower-cased bytes with an end symbol each, words, and who trains."""

    def __init__(self, piece: pa.Table, folds: int, held: int):
        data, offsets = text_bytes(piece.column("text"))
        data = LOWER[data]
        self.words = Words(data, offsets)
        self.held = _fold(piece.column("doc_id").to_pylist(), folds, held)
        n = len(offsets) - 1
        self.ends = offsets[1:] + np.arange(1, n + 1)  # after each text's end symbol
        self.bytes = np.insert(data, offsets[1:], END).astype(np.uint64)
        self.lengths = np.diff(self.ends, prepend=0)
        self.doc = np.repeat(np.arange(n), self.lengths)

    def grams(self, order: int) -> np.ndarray:
        """(context of ``order`` bytes, byte) of each position as one number, the byte lowest."""
        place = np.arange(len(self.bytes)) - np.repeat(self.ends - self.lengths, self.lengths)
        out = self.bytes.copy()
        for back in range(1, order + 1):
            before = np.full(len(self.bytes), END, np.uint64)
            before[back:] = self.bytes[: max(0, len(self.bytes) - back)]
            before[place < back] = END
            out |= before << np.uint64(8 * back)
        return out


def _pieces(t: pa.Table, folds: int, held: int) -> Iterator[tuple[pa.Table, Texts]]:
    for at, n in slices(t, "text"):
        piece = t.slice(at, n)
        yield piece, Texts(piece, folds, held)


def _count(keys: np.ndarray, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys with the number of training occurrences."""
    order = np.argsort(keys)
    k = keys[order]
    at = group_starts(k)
    return (k[at], np.add.reduceat(trains[order].astype(np.int64), at)) if len(at) else (k, np.zeros(0, np.int64))


def _sum(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, n = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(k)
    k = k[order]
    at = group_starts(k)
    return (k[at], np.add.reduceat(n[order], at)) if len(at) else (k, n)


def _add(found: list[tuple[np.ndarray, np.ndarray]], more: tuple[np.ndarray, np.ndarray]) -> None:
    """Append counts, and sum up what has gathered once it is twice what was left by the last sum."""
    found.append(more)
    if len(found) > 2 and sum(len(k) for k, _ in found[1:]) > len(found[0][0]) + (1 << 17):
        found[:] = [_sum(found)]


def _range_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The trie range of each gram: by its context's last bytes, one more than the orders that all ranges share."""
    return (mix(grams >> np.uint64(8) & np.uint64((1 << 8 * (SHARED_ORDER + 1)) - 1), 11) % np.uint64(parts)).astype(np.int64)


def _emit(order: int, folds: int, held: int, word_parts: int, gram_parts: int):
    @tidied
    def run(batches):
        for t in by_chunk(batches):
            words, grams, chunk = [], [], t.column("chunk")[0].as_py()
            for _, x in _pieces(t, folds, held):
                _add(words, _count(x.words.ids, ~x.held[x.words.doc]))
                _add(words, (END_WORD, np.array([(~x.held).sum()])))
                _add(grams, _count(x.grams(order), ~x.held[x.doc]))
            out: list[list] = [[], [], [], [], []]
            keys, n = _sum(words)
            for part, s in split_parts(keys, word_parts):
                for column, v in zip(out, (WORD, part, chunk, pack(keys[s]), planes(n[s].astype(np.uint64)))):
                    column.append(v)
            keys, n = _sum(grams)
            low, count = _sum([(keys[n > 0] & np.uint64((1 << 8 * (SHARED_ORDER + 1)) - 1), n[n > 0])])
            for column, v in zip(out, (LOW, 0, chunk, pack(low), planes(count.astype(np.uint64)))):
                column.append(v)
            where = _range_of(keys, gram_parts)
            by_part = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[by_part], np.arange(gram_parts + 1))
            for part in np.flatnonzero(np.diff(edges)).tolist():
                mine = by_part[edges[part] : edges[part + 1]]
                for column, v in zip(out, (GRAM, part, chunk, pack(keys[mine]), planes(n[mine].astype(np.uint64)))):
                    column.append(v)
            yield from table(_ROWS, out).to_batches()

    return run


class Level:
    """The trie's nodes of one order: contexts with their followers."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        context = keys >> np.uint64(8)
        self.at = group_starts(context)
        self.contexts = context[self.at]
        self.total = np.add.reduceat(counts, self.at) if len(self.at) else counts
        self.distinct = np.diff(np.append(self.at, len(keys)))
        self.taken = np.zeros(len(self.at), np.int64)  # what a context's followers count in the next shorter one

    def shorter(self, order: int) -> Level:
        """Nodes of order - 1 below the same ranges."""
        return Level(*_sum([(self.keys & np.uint64((1 << 8 * order) - 1), self.counts)]))

    def exclude_in(self, lower: Level, order: int) -> None:
        if len(self.keys):
            place, there = find(lower.keys, self.keys & np.uint64((1 << 8 * order) - 1))
            self.taken = np.add.reduceat(np.where(there, lower.counts[place], 0), self.at)


def shared_levels(low: tuple[np.ndarray, np.ndarray]) -> dict[int, Level]:
    """The trie's orders 0 to 2 from the counts of order 2."""
    levels = {SHARED_ORDER: Level(*low)}
    for k in range(SHARED_ORDER, 0, -1):
        levels[k - 1] = levels[k].shorter(k)
        levels[k].exclude_in(levels[k - 1], k)
    return levels


def log_probabilities(grams: np.ndarray, counts: np.ndarray, order: int, shared: dict[int, Level], discount: float) -> np.ndarray:
    """log10 probability of each gram's byte after its context. ``grams``: ascending, with training
    counts, complete for the contexts' last three bytes; ``shared``: the lowest orders."""
    levels = dict(shared)
    if order > SHARED_ORDER:
        seen = counts > 0
        levels[order] = Level(grams[seen], counts[seen])
        for k in range(order, SHARED_ORDER + 1, -1):
            levels[k - 1] = levels[k].shorter(k)
        for k in range(order, SHARED_ORDER, -1):
            levels[k].exclude_in(levels[k - 1], k)
    out = np.zeros(len(grams))
    left = np.arange(len(grams))
    taken, gone = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)  # counts and followers excluded so far
    for k in range(order, -1, -1):
        level = levels[k]
        if not len(level.contexts):
            continue
        node = grams[left] & np.uint64((1 << 8 * (k + 1)) - 1)
        place, known = find(level.contexts, node >> np.uint64(8))
        at, hit = find(level.keys, node)
        total = np.maximum(level.total[place] - taken[left], 1)
        followers = level.distinct[place] - gone[left]
        good = known & hit
        out[left[good]] += np.log10((level.counts[at[good]] - discount) / total[good])
        miss = known & ~hit & (followers > 0)
        out[left[miss]] += np.log10(discount * followers[miss] / total[miss])
        taken[left] = np.where(known, level.taken[place], taken[left])
        gone[left] = np.where(known, level.distinct[place], gone[left])
        left = left[~good]
    out[left] += np.log10(1 / (256 - gone[left]))
    return out


ANSWER = "kind int, chunk long, keys binary, values binary, n_train long, n_distinct long"
_ANSWER = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("values", pa.binary()), ("n_train", pa.int64()), ("n_distinct", pa.int64())])


def _answer(order: int, low, discount: float):
    levels: dict[int, Level] = {}

    def run(t: pa.Table) -> pa.Table:
        if not levels:
            levels.update(shared_levels(low.value))
        kind = t.column("kind")[0].as_py()
        keys, counts = [unpack(b) for b in blobs(t, "keys")], [unplanes(b).astype(np.int64) for b in blobs(t, "counts")]
        every, n = _sum(list(zip(keys, counts)))
        values = n if kind == WORD else log_probabilities(every, n, order, levels, discount).astype("<f8")
        out: list[list] = [[], [], [], [], [], []]
        for i, (chunk, k) in enumerate(zip(t.column("chunk").to_pylist(), keys)):
            mine = values[find(every, k)[0]]
            stated = planes(mine.astype(np.uint64)) if kind == WORD else mine.tobytes()
            totals = (int(n.sum()), int((n > 0).sum())) if kind == WORD and i == 0 else (0, 0)
            for column, v in zip(out, (kind, chunk, pack(k), stated, *totals)):
                column.append(v)
        tidy(1.0)
        return table(_ANSWER, out)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, n_bytes long"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_sum", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def _per_doc(values: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[ends] - upto[begins]


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys, all of which are among the ascending ``keys``; in order, as memory is then read in order."""
    by = np.argsort(wanted)
    w = wanted[by]
    at = group_starts(w)
    out = np.empty(len(w))
    if len(w):
        out[by] = np.repeat(values[np.searchsorted(keys, w[at])], np.diff(np.append(at, len(w))))
    return out


def _score(order: int, folds: int, held: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        learnt = {}
        for kind in (WORD, GRAM):
            rows = [(unpack(k), unplanes(v).astype(np.float64) if kind == WORD else np.frombuffer(v, "<f8")) for which, k, v in zip(answers.column("kind").to_pylist(), blobs(answers, "keys"), blobs(answers, "values")) if which == kind]
            k, v = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, np.uint64), np.zeros(0))
            by = np.argsort(k, kind="stable")
            learnt[kind] = k[by], v[by]
        out = [[] for _ in _SCORED]
        for piece, x in _pieces(docs, folds, held):
            keys, values = learnt[WORD]
            first = x.words.first
            c, end_count = _look_up(keys, values, x.words.ids), _look_up(keys, values, END_WORD)[0]
            known = _per_doc((c > 0).astype(np.int64), first[1:], first[:-1]) + int(end_count > 0)
            base = _per_doc(np.log10(c + 0.5), first[1:], first[:-1]) + np.log10(end_count + 0.5)
            keys, values = learnt[GRAM]
            score = _per_doc(_look_up(keys, values, x.grams(order)), x.ends, x.ends - x.lengths)
            for column, v in zip(out, (piece.column("doc_id").to_pylist(), x.held.tolist(), (x.words.counts + 1).tolist(), known.tolist(), base.tolist(), score.tolist(), (x.lengths - 1).tolist())):
                column += v
        tidy(1.0)
        return table(_SCORED, out)

    return run


def _low_counts(sent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The trie's order 2: at most 2 ** 24 counts of the training texts, summed over all chunks."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            found = [(unpack(k), unplanes(n).astype(np.int64)) for k, n in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist())]
            if found:
                gram, n = _sum(found)
                yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int32)), pa.array(n)], schema=schema)

    rows = sent.filter(F.col("kind") == LOW).select("keys", "counts").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().sort_by("gram")
    return rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.int64)


def score(docs: DataFrame, order: int = 5, folds: int = 5, held: int = 1, discount: float = 0.3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    The fold crc32(doc_id as text) mod ``folds`` = ``held`` is scored but not learnt from.
    ``base_score``: word unigrams with add-one-half smoothing; ``score``: the trie's log10
    probability of the lower-cased text and its end.
    """
    if not (SHARED_ORDER <= order <= 7 and 0 < discount < 1):
        raise ValueError("order: 2 to 7 bytes; discount: between 0 and 1")
    spark = docs.sparkSession
    layout = Layout(docs, {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    sent = materialise(layout.docs.mapInArrow(_emit(order, folds, held, layout.parts, layout.parts), ROWS), "trie-counts")
    low = spark.sparkContext.broadcast(_low_counts(sent))
    answers = materialise(sent.filter(F.col("kind") != LOW).groupBy("kind", "part").applyInArrow(_answer(order, low, discount), ANSWER), "trie-answers")
    discard(sent)
    totals = answers.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("n_distinct"), F.lit(0)).alias("v"))
    scored = layout.docs.groupBy("chunk").cogroup(answers.select("kind", "chunk", "keys", "values").groupBy("chunk")).applyInArrow(_score(order, folds, held), SCORED)
    base = F.col("base_sum") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("v") + 1))
    bits = -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)
    return scored.join(F.broadcast(totals), F.lit(True)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score", "n_bytes", bits.alias("bits_per_byte"))
