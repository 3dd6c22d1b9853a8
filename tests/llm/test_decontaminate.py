import re

from corpus import ODD, frame, texts

from specloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        for k in range(max(1, len(w) - n + 1)):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, who = words(t), set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                found = windows.get(tuple(w[k : k + s]))
                if found:
                    hit |= set(range(k, k + s))
                    who |= found
        out.append((str(i), len(w), len(hit), len(who), dc.items_sha256(who), bool(hit)))
    return sorted(out)


def items(spark):
    rows = [(i, t) for i, t in enumerate(texts(14, 12, 14))] + [(50, "Short, one!"), (50, "and another"), (51, None), (52, "--"), (None, "a b c"), (110, "É x")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, n_words string")


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, dc.items_sha256(r["items"]), r.contaminated) for r in df.collect())


def corpus():
    bench = texts(14, 12, 14)
    some = texts(15, 60, 30)
    for k in range(0, 60, 4):
        some[k] += " " + bench[k % 12].replace(" ", ", ", 3).upper() + some[k][:20]
    return list(enumerate(some + ODD + ["short one", "SHORT--ONE", "shortone", "é x é X"])) + [(None, bench[0]), (None, None), (3, "again short one")]


def test_equals_brute_force(spark):
    docs, (rows, bench) = corpus(), items(spark)
    want = brute(docs, rows, 10)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert result(dc.scan(frame(spark, docs), bench)) == want
    assert result(dc.scan(frame(spark, docs), bench, most_bytes=2000)) == want  # several automata


def test_spans_point_into_the_original(spark):
    _, bench = items(spark)
    r = dc.scan(frame(spark, [(1, "Ä ok. SHORT --\n one? É  X!")]), bench).collect()[0]
    assert [r_ for r_ in (("Ä ok. SHORT --\n one? É  X!")[a:b] for a, b in r.spans)] == ["SHORT --\n one? É  X"]


def test_spans_of_several_automata_are_those_of_one(spark):
    _, bench = items(spark)
    one, several = ({(str(r.doc_id), r.n_words, tuple(map(tuple, r.spans))) for r in dc.scan(frame(spark, corpus()), bench, most_bytes=m).collect()} for m in (1 << 20, 1500))
    assert one == several and any(spans for _, _, spans in one)


def test_removal_keeps_clean_rows_and_columns(spark):
    docs, (rows, bench) = corpus(), items(spark)
    df = frame(spark, docs)
    kept = dc.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    clean = sorted(r[0] for r in brute(docs, rows, 10) if not r[5])
    assert sorted(str(r.doc_id) for r in kept.collect()) == clean


def test_empty_tables(spark):
    _, bench = items(spark)
    assert dc.scan(frame(spark, []), bench).count() == 0
    got = dc.scan(frame(spark, [(1, "a b")]), bench.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
