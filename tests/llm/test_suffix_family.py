import hashlib
from collections import Counter

import numpy as np
from corpus import ODD, frame, texts

from specloom.llm import suffix_family


def brute(rows, length):
    docs = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in docs for k in range(len(b) - length + 1))
    out = []
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_equals_brute_force(spark):
    rows = list(enumerate(texts(3, 120, 80) + ODD))
    rows += [(None, rows[0][1]), (None, rows[0][1]), (3, "q" + rows[3][1] + "z")]
    for length in (20, 45):
        assert result(suffix_family.remove_repeats(frame(spark, rows), length=length)) == brute(rows, length)


def test_production_length(spark):
    base = texts(4, 12, 300)
    rows = list(enumerate([*base, "u" + base[0], base[1][:700] + "#" + base[1][701:], "ab" * 900, base[2] + base[2]]))
    assert result(suffix_family.remove_repeats(frame(spark, rows))) == brute(rows, 400)


def test_batches_one_by_one_are_one_batch(spark, tmp_path):
    rows = list(enumerate(texts(9, 300, 80, passages=3)))
    df = frame(spark, rows)
    df.repartition(7).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = brute(rows, 45)
    assert sum(r[2] for r in want) > 0
    for batches in (1, 2, 5):
        assert result(suffix_family.remove_repeats(docs, length=45, batches=batches)) == want


def suffixes(cores, zones, chunk):
    core = np.array([list(c.encode().ljust(8)) for c in cores], np.uint8).reshape(len(cores), 8)
    n = len(cores)
    s = suffix_family.Suffixes(core, np.ones(n, np.uint64), np.array(zones, np.uint64), np.zeros(n, bool), np.full(n, chunk))
    return suffix_family.distinct(s, *suffix_family.suffix_order(s))


def test_merge_scan_tells_both_sides_once():
    level = suffixes(["b", "a", "c"], [1, 2, 3], 10)
    batch = suffixes(["a", "c", "d"], [2, 9, 4], 20)
    chunk, zone, flags, merged = suffix_family.merge_scan(batch, [level], 1)
    told = {(c, z): f for c, z, f in zip(chunk.tolist(), zone.tolist(), flags.tolist())}
    seen, whole, tell = suffix_family.SEEN, suffix_family.ALL, suffix_family.TELL
    assert told == {(10, 2): seen | whole, (20, 2): seen | whole, (10, 3): seen | tell, (20, 9): seen | tell}
    assert [bytes(c)[:1] for c in merged.core] == [b"a", b"b", b"c", b"c", b"d"]
    assert merged.many.tolist() == [True, False, False, False, False]
    chunk, _, flags, _ = suffix_family.merge_scan(suffixes(["c", "a"], [3, 2], 30), [merged], 0)
    assert dict(zip(chunk.tolist(), flags.tolist())) == {10: whole, 30: seen | whole}  # for (c, 3); of a its level has told all


def test_a_stored_index_takes_later_batches(spark, tmp_path):
    texts_ = texts(11, 160, 120, passages=2)
    by = suffix_family.Sampling(45, 22, 24)
    index = suffix_family.SuffixIndex(spark, f"file://{tmp_path}/index", by, 3)
    told = []
    for k in range(6):
        if k == 3:
            index.save()
            index = suffix_family.SuffixIndex.opened(spark, index.path)
            index.bits = 4  # more data, more parts: older levels are cut finer
        batch = spark.createDataFrame([(100 + k, t) for t in texts_[k * 20 : k * 20 + 20]], "chunk long, text string").coalesce(1)
        told += [(r.chunk, bytes(r.zone), bytes(r.flags)) for r in index.add(batch).collect()]
        assert [b for _, b, _ in index.levels] == [1 << p for p in range(3, -1, -1) if (k + 1) >> p & 1]

    def known(told):
        out = {}
        for c, z, f in told:
            for zone, flag in zip(suffix_family.unpack(z).tolist(), f):
                out[c, zone] = out.get((c, zone), 0) | flag & ~suffix_family.TELL  # who of several tells the others is free
        return {k: v for k, v in out.items() if v}

    whole = suffix_family.SuffixIndex(spark, f"file://{tmp_path}/whole", by, 3)
    every = spark.createDataFrame([(100 + k // 20, t) for k, t in enumerate(texts_[:120])], "chunk long, text string").coalesce(1)
    at_once = [(r.chunk, bytes(r.zone), bytes(r.flags)) for r in whole.add(every).collect()]
    first = {k for k, v in known(at_once).items() if v & suffix_family.ALL}
    assert known(told) == known(at_once) and first


def test_shorter_repeats_are_reported(spark):
    r = np.random.default_rng(5)
    words = ["".join(map(chr, r.integers(97, 123, 6))) for _ in range(3000)]
    passage = " ".join(words[:45])  # 314 bytes
    docs = [" ".join(words[100 + 150 * k : 250 + 150 * k]) for k in range(6)]
    docs[1], docs[4] = docs[1] + " " + passage + " " + docs[1][::-1], passage + " " + docs[4]
    found = {x.doc_id: x for x in suffix_family.remove_repeats(frame(spark, list(enumerate(docs)))).collect()}
    assert all(x.n_removed == 0 for x in found.values())
    assert {k for k, x in found.items() if x.longest_seen} == {1, 4}


def test_empty_table(spark):
    assert suffix_family.remove_repeats(frame(spark, [])).count() == 0
