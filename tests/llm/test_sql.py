"""The registered SQL against the operators, on small tables with odd rows."""

import duckdb
import pytest
from corpus import texts

from specloom.llm import chat, quality, queries

ODD = [None, "", "  ", "a b\x0bc", "UPPER ÀÉ Words " * 9, "x x x " * 12, "one\n two\n\none\none\n" * 6, "# $ % " * 10, "w " * 30, "a b c d e f g h i " * 4, "the quick brown fox jumps over it all " * 3, "ü\xa0é word " * 15, "n" * 900, "1 2 3 4 5 6 7 8", "lone\x1cword " * 25]
SAID = [None, "", "plain", "a [/INST]</s> b", "<\\s> </s>", "[INST] <s>", "[\\\\/INST]", "[/INST", "two\nlines ü", "<\\\\\\s>x<s>"]


def same(spark, name, got, **tables):
    con = duckdb.connect()
    for k, df in tables.items():
        con.register(k, df.toArrow())
    out = con.sql(queries.SQL[name])
    assert out.columns == got.columns
    assert sorted(map(repr, out.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_cascade(spark):
    docs = spark.createDataFrame([(i % 12, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    same(spark, "op2_cascade", quality.judge(docs).drop("rejected_by"), documents=docs)


def test_chat(spark):
    rows = [(i // 2, None if i == 5 else i % 2, role, t) for i, (t, role) in enumerate((t, r) for t in SAID for r in ("user", "assistant", "a b*~ü", None))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    odd = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], turns.schema)
    same(spark, "op4_chat", chat.read_back(chat.render(turns.unionByName(odd))), conversations=turns)


@pytest.mark.parametrize("name", ["op5_anchors", "op8_automaton", "op9_forest", "repeated_bytes"])
def test_windows_pairs_and_strings(spark, tmp_path, name):
    near = texts(41, 60, 120)
    docs = [*near, *ODD, near[3], near[4] + " more", " ".join(near[5].split()[2:]), "Ä, " + near[6].upper() + "!", "é" * 500, "é" * 450 + "x", None]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, near[6]), (2, "x x x"), (3, None), (4, "--"), (5, " ".join(near[7].split()[:14])), (None, near[8])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.register(t, spark.read.parquet(str(tmp_path / f"{t}.parquet")).toArrow())
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    rows = sorted(map(repr, want.fetchall()))
    assert rows == sorted(repr(tuple(r)) for r in got.collect()) and len(rows) == len(docs)


@pytest.mark.parametrize("name", ["op2_cascade", "op4_chat", "op5_anchors", "op8_automaton", "op9_forest", "repeated_bytes"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.oracle_sql()
