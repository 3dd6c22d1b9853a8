import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from corpus import ODD, frame, texts

from specloom.llm import ppm


def lower(t):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())


def brute(rows, order, d=0.3):
    """The same model, byte by byte with dictionaries."""
    trie = [defaultdict(Counter) for _ in range(order + 1)]
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows}
    words = Counter()
    for i, t in rows:
        if held[i]:
            continue
        b = b"\xff" * order + lower(t) + b"\xff"
        for k in range(order, len(b)):
            for o in range(order + 1):
                trie[o][b[k - o : k]][b[k]] += 1
        words.update(re.findall(rb"[^\x20\x09-\x0D]+", lower(t)))
        words["end"] += 1
    n, v = sum(words.values()), len(words)
    out = []
    for i, t in rows:
        b, total = b"\xff" * order + lower(t) + b"\xff", 0.0
        for k in range(order, len(b)):
            gone = set()
            for o in range(order, -1, -1):
                node = trie[o].get(b[k - o : k])
                if not node:
                    continue
                here = {s: c for s, c in node.items() if s not in gone}
                whole = sum(here.values())
                if b[k] in here:
                    total += math.log10((here[b[k]] - d) / whole)
                    break
                if here:
                    total += math.log10(d * len(here) / whole)
                gone |= set(node)
            else:
                total += math.log10(1 / (256 - len(gone)))
        ws = [*re.findall(rb"[^\x20\x09-\x0D]+", lower(t)), "end"]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((i, held[i], len(ws), sum(words[w] > 0 for w in ws), n, base, total))
    return out


@pytest.mark.parametrize("order", [2, 3, 5])
def test_equals_brute_force(spark, order):
    rows = [(i, (t or "").title() if i % 3 else t) for i, t in enumerate(texts(7, 60) + ODD)] + [(None, "abc"), (None, "abc")]
    got = ppm.score(frame(spark, rows), order=order).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    key = lambda r: (str(r[0]), r[2], round(r[6], 3))
    want = sorted(brute(rows, order), key=key)
    for g, w in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_held_out_texts_are_predicted_better_than_by_words(spark):
    rows = list(enumerate(texts(8, 300)))
    got = [r for r in ppm.score(frame(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_table_and_no_training_texts(spark):
    assert ppm.score(frame(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = ppm.score(frame(spark, [(only, "ab")])).collect()[0]
    assert got.held_out and got.score == pytest.approx(3 * math.log10(1 / 256)) and got.train_tokens == 0
