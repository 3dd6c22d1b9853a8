"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows.

Texts are normalised to lower-cased (A-Z) words joined by one space, on their UTF-8
bytes; an item's windows of ``window`` words (a shorter item is one window) become
patterns with a space at either end, so matches are whole words. A text is scanned once.
Matches are mapped back to words and, on demand, to character offsets of the original.

The automaton is on every executor, so the benchmark's size is checked: beyond
``most_bytes`` of patterns the items are dealt into several automata of that size, and
the texts are scanned once for each; results are the same.

Rows: each document row gives one row. Null or wordless texts have no words and no
hits; null or wordless items have no windows; items with a null id are ignored. Items that
share an id count as one. No documents: no rows. No items: nothing is contaminated.
Repeated rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm._common import flat, materialise, tidied

# fixed value: what is no word character
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TABLE = bytes(32 if _TABLE[b] in SEPARATORS else _TABLE[b] for b in range(256))
_SPACES = re.compile(b" +")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalise(text: str) -> bytes:
    """' w1 w2 ... wn ' in UTF-8, or one space if there are no words."""
    return _SPACES.sub(b" ", b" " + text.encode().translate(_TABLE) + b" ")


def patterns(text: str, window: int) -> list[bytes]:
    words = normalise(text).split(b" ")[1:-1]
    if not words:
        return []
    return [b" " + b" ".join(words[k : k + window]) + b" " for k in range(max(1, len(words) - window + 1))]


class Automaton:
    """All windows of the items; knows which items have each."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        import ahocorasick

        owners: dict[bytes, set[int]] = {}
        for item, text in items:
            for p in patterns(text, window):
                owners.setdefault(p, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for p, who in owners.items():
            self.automaton.add_word(p.decode("latin-1"), (len(p), tuple(who)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, runs [first, end) of hit words, items."""
        plain = normalise(text)
        n, runs, items = plain.count(b" ") - 1, [], set()
        if self.empty or not n:
            return n, runs, items
        found = [(end + 1 - size, end, who) for end, (size, who) in self.automaton.iter(plain.decode("latin-1"))]
        if not found:
            return n, runs, items
        gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)  # word k stands between gaps k and k + 1
        for a, b in zip(np.searchsorted(gaps, [f[0] for f in found]).tolist(), np.searchsorted(gaps, [f[1] for f in found]).tolist()):
            runs.append((a, b))
        for f in found:
            items.update(f[2])
        runs.sort()
        merged: list[tuple[int, int]] = []
        for a, b in runs:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return n, merged, items


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of word runs in the original text."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(re.sub("[A-Z]", "a", text))]  # lower-casing A-Z keeps all offsets
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


_SCAN = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.int64()))])
SCAN = "n_words long, runs array<struct<first:long,end:long>>, spans array<struct<start:long,stop:long>>, items array<long>"

_automata: dict[str, Automaton] = {}


def _automaton(key: str, items: list[tuple[int, str]], window: int) -> Automaton:
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(items, window)
    return _automata[key]


def _shares(benchmark: DataFrame, most_bytes: int, window: int) -> Iterator[list[tuple[int, str]]]:
    """Items dealt into shares, one after the other, the patterns of each within ``most_bytes`` (about ``window`` times the text).

    Only one share at a time is on the driver.
    """
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total * window // most_bytes))
    for k in range(n):
        rows = sized if n == 1 else sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in rows.collect()]


def _scan_share(docs: DataFrame, items: list[tuple[int, str]], window: int, with_spans: bool) -> DataFrame:
    """``docs`` with the scan's columns appended; all columns pass through. The items stay in the broadcast's file, not on the driver's heap."""
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    names = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)  # clashing and repeated names pass
    text = names[docs.columns.index("text")]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                out: list[list] = [[], [], [], []]
                for t in flat(piece.column(text)).to_pylist():
                    n, runs, hit = automaton.scan(t)
                    where = spans(t, runs) if with_spans else []
                    for column, v in zip(out, (n, [{"first": a, "end": b} for a, b in runs], [{"start": a, "stop": b} for a, b in where], sorted(hit))):
                        column.append(v)
                arrays = [*piece.columns, *(pa.array(c, f.type) for c, f in zip(out, _SCAN))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*piece.schema.names, *_SCAN.names])

    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields), SCAN])
    return renamed.mapInArrow(run, ddl)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, with_spans: bool = True, most_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans (characters of the original), contaminated."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shares = _shares(benchmark, most_bytes, window)
    first, second = next(shares), next(shares, None)
    if second is None:
        found = [_scan_share(slim.select("doc_id", "text"), first, window, with_spans).withColumnRenamed("_c0", "doc_id").drop("_c1")]
    else:
        slim = materialise(slim.withColumn("row", F.monotonically_increasing_id()), "scan-input")  # row numbers stay as written
        merged = None
        for items in chain((first, second), shares):
            # of texts without a hit the first scan tells
            more = _scan_share(slim, items, window, with_spans).drop("_c1")
            merged = more if merged is None else merged.unionByName(more.filter(F.size("runs") > 0))
        found = [
            merged.groupBy(F.col("_c2"))
            .agg(F.first("_c0").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .withColumn("runs", _merged("runs", "first", "end"))
            .withColumn("spans", _merged("spans", "start", "stop"))
        ]
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["first"])
    return found[0].select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("runs") > 0).alias("contaminated"))


def _merged(column: str, first: str, end: str):
    """Overlapping or touching runs of several scans as one."""
    ordered = F.array_sort(F.col(column))
    empty = F.filter(F.col(column), lambda _: F.lit(False))

    def join(acc, r):
        last = F.try_element_at(acc, F.lit(-1))  # null if there is none
        longer = F.struct(last[first].alias(first), F.greatest(last[end], r[end]).alias(end))
        return F.when(r[first] <= last[end], F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(ordered, empty, join)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns as they are."""
    kept = docs
    for items in _shares(benchmark, 64 << 20, window):
        kept = _scan_share(kept, items, window, False).filter(F.size("runs") == 0).drop(*_SCAN.names).toDF(*docs.columns)
    return kept


def items_sha256(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def digest(items) -> F.Column:
    """The same over a column of item ids."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)
