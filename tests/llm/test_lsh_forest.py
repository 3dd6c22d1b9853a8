import random
import re

import numpy as np
from corpus import ODD, frame, texts

from specloom.llm import graph, lsh_forest


def shingle_set(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    """(class as a frozenset of row numbers, links) of each row."""
    sets = [shingle_set(t) for _, t in rows]
    text = [t or "" for _, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and (text[i] == text[j] or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))] for i in range(len(rows))]
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            todo, got = [i], {i}
            while todo:
                for j in linked[todo.pop()]:
                    if j not in got:
                        got.add(j)
                        todo.append(j)
            ids = [rows[k][0] for k in got if rows[k][0] is not None]
            seen |= dict.fromkeys(got, min(ids, default=None))
        out.append((str(rows[i][0]), str(seen[i]), len(linked[i])))
    return sorted(out)


def near_copies(seed):
    r = random.Random(seed)
    out = texts(seed, 50, 90, passages=2)
    base = [" ".join(f"w{r.randint(0, 500)}" for _ in range(120)) for _ in range(3)]
    for b in base:
        for _ in range(25):
            w = b.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 50)}"
            out.append(" ".join(w))
    return out + ODD + ["a b c", "a  b c", "a b"]


def result(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in df.collect())


def test_equals_brute_force(spark):
    rows = list(enumerate(near_copies(21)))
    rows += [(None, rows[60][1]), (None, "only null"), (4, rows[5][1]), (7, rows[7][1])]
    want = brute(rows)
    assert max(r[2] for r in want) > 8
    assert result(lsh_forest.join(frame(spark, rows))) == want
    assert result(lsh_forest.join(frame(spark, rows), block=4, shingles_in_block=600)) == want  # groups cut into many blocks


def test_one_row_of_each_class_stays(spark):
    rows = list(enumerate(near_copies(22))) + [(3, "dup id"), (3, "dup id"), (None, "n"), (None, "n")]
    df = frame(spark, rows)
    kept = lsh_forest.keep_one(df)
    assert kept.columns == df.columns
    classes = {r["class"]: r.class_id for r in lsh_forest.join(df).collect()}
    got = kept.collect()
    assert len(got) == len(classes)
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, classes.values()))


def test_prefixes_shorten_until_the_target_recall():
    assert lsh_forest.prefix_depth(0.8, 32, 8, 0.5) == 8
    for target in (0.99, 0.9999, 0.999999):
        k = lsh_forest.prefix_depth(0.8, 32, 8, target)
        assert 1 - (1 - 0.8**k) ** 32 >= target > 1 - (1 - 0.8 ** (k + 1)) ** 32 or k == 8


def test_tries_connect_what_shares_a_prefix(spark):
    """Components of the ties of each depth, over several ranges with one hot prefix, against plain grouping."""
    r = np.random.default_rng(3)
    labels = r.integers(0, 3, size=(300, 2, 4)).astype("<u2")
    labels[:120, 0, :3] = 7
    rows = [(bytes([k % 256, k // 256]) * 8, labels[k].tobytes()) for k in range(300)]
    nodes = spark.createDataFrame([*rows, (b"z" * 16, None)], "node binary, signature binary")
    ties = lsh_forest.forest_ties(nodes, 2, 4, 2).collect()
    assert len(ties) <= 2 * 300
    for depth in (4, 3, 2):
        root = {n: n for n, _ in rows}

        def of(x):
            while root[x] != x:
                x = root[x]
            return x

        for t in ties:
            if t.depth >= depth:
                root[of(bytes(t.u))] = of(bytes(t.v))
        want = {n: n for n, _ in rows}
        mine, root = {n: of(n) for n, _ in rows}, want
        for tree in range(2):
            first = {}
            for k, (n, _) in enumerate(rows):
                root[of(n)] = of(first.setdefault(labels[k, tree, :depth].tobytes(), n))
        theirs = {n: of(n) for n, _ in rows}
        assert len(set(mine.values())) == len(set(theirs.values())) == len(set(zip(mine.values(), theirs.values())))


def test_share_found_decides_on_the_depth():
    assert lsh_forest.seen_share({100: 50}, 32, 8) == 1
    assert 0.997 < lsh_forest.seen_share({80: 10}, 32, 8) < 0.998
    assert lsh_forest.seen_share({80: 10}, 32, 6) > 0.9999 > lsh_forest.seen_share({80: 10}, 32, 7)
    assert lsh_forest.seen_share({}, 32, 8) == 0  # nothing is known: go on


def test_min_hashes_estimate_similarity():
    r = np.random.default_rng(1)
    both, a, b = (r.integers(1 << 63, size=n, dtype=np.uint64) for n in (300, 50, 50))
    x, y = lsh_forest.signatures([np.concatenate([both, a]), np.concatenate([both, b])], 256)
    assert abs((x == y).mean() - 0.75) < 0.1


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 170), (303, 301), (303, 302), (304, 302)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 150: 150, 170: 150, 200: 150, 301: 301, 302: 301, 303: 301, 304: 301}


def test_empty_table(spark):
    assert lsh_forest.join(frame(spark, [])).count() == 0
    assert lsh_forest.keep_one(frame(spark, [])).count() == 0
