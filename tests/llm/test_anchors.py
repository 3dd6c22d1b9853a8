import hashlib
import re

from corpus import ODD, frame, texts

from specloom.llm import anchors


def brute(rows, window):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, float("inf")), key(i))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_equals_brute_force(spark):
    rows = list(enumerate(texts(1, 150) + ODD))
    rows += [(None, rows[0][1]), (None, rows[0][1]), (3, rows[3][1]), (5, rows[9][1])]
    assert result(anchors.remove_repeats(frame(spark, rows))) == brute(rows, 13)


def test_small_windows_and_many_ranges(spark, monkeypatch):
    rows = list(enumerate(texts(2, 80, 30)))
    assert result(anchors.remove_repeats(frame(spark, rows), block=2, window=3)) == brute(rows, 3)


def test_kept_and_spans(spark):
    a = " ".join(f"w{i}" for i in range(20))
    got = {r.doc_id: r for r in anchors.remove_repeats(frame(spark, [(1, a), (2, f"p {a}\nq")])).collect()}
    assert got[1].n_removed == 0 and got[2].kept == "p q"
    assert [tuple(s) for s in got[2].spans] == [(1, 21)]


def test_empty_table(spark):
    assert anchors.remove_repeats(frame(spark, [])).count() == 0
