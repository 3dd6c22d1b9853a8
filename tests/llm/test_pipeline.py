import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from corpus import texts
from test_decontaminate import words
from test_lsh_forest import brute as near
from tokenizers import Tokenizer

from specloom.llm import pfair, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    base = [t for t in texts(31, 90, 120) if len(t.split()) > 30]
    leak = " ".join(f"leak{i}" for i in range(14))
    docs = [*base, *base[:10], base[11] + " tail", "too short", None, base[12] + " " + leak.upper(), "### $$$ %%% &&& " * 40]
    rows = [(i, t, "en", f"s{i % 3 if i % 2 else 0}", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, leak), (1, "never seen words at all in any of these texts here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, leak


def test_stages_against_brute_force(spark, folder, tmp_path):
    path, rows, leak = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == COLUMNS
        got.append(docs.collect())
    text = {r[0]: r[1] for r in rows}
    kept = {r.doc_id for r in got[0]}
    assert len(rows) - 1 not in kept and len(rows) - 3 not in kept and len(rows) - 4 not in kept
    assert {r.doc_id for r in got[1]} == {int(c) for _, c, _ in near([(i, text[i]) for i in sorted(kept)])}
    window = set(zip(*(words(leak)[k:] for k in range(10))))
    clean = {r.doc_id for r in got[1] if not window & set(zip(*(words(r.text)[k:] for k in range(10))))}
    assert len(clean) < len(got[1]) and {r.doc_id for r in got[2]} == clean
    assert Counter(tuple(r) for r in got[3]) == Counter(tuple(r) for r in got[2])
    place = {r.doc_id: (r.slot, r.position) for r in pfair.schedule(spark.read.parquet(f"{tmp_path}/2")).collect()}
    order = sorted(place, key=place.get)
    tokens = sorted(got[4], key=lambda r: r.start)
    assert [r.doc_id for r in tokens] == order
    t, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r in tokens:
        ids = np.array([*t.encode(text[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_gives_the_same(spark, folder):
    path, *_ = folder
    one = sorted(tuple(r) for r in corpus_pipeline.run(spark, path).collect())
    assert one == sorted(tuple(r) for r in queries.pipeline(spark, path).collect()) and one


def through(spark, docs, bench, path):
    """The stages one after the other, as the driver runs them; the first four keep the columns."""
    docs.write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(path)).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        assert k == 4 or docs.columns == columns
    return docs.collect()


BENCH = "item_id long, text string"


def test_no_documents(spark, tmp_path):
    assert through(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame([(1, "a b c")], BENCH), tmp_path) == []


def test_no_benchmark_null_ids_and_clashing_columns(spark, tmp_path):
    """Columns named like the operators' own; null and repeated ids; repeated rows; null sources."""
    base = [t for t in texts(33, 40, 120) if len(set(t.split())) > 40][:12]
    rows = [(None if i % 5 == 0 else i // 2, t, None if i % 3 else "s", 1, "k", b"x", 2, "c", 3.0) for i, t in enumerate([*base, base[0], base[3], None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, chunk long, node string, signature binary, n_words int, _c0 string, slot double")
    got = through(spark, docs, spark.createDataFrame([], BENCH), tmp_path)
    want = near([(k, t) for k, t in enumerate(base)])
    assert len(got) == len({c for _, c, _ in want})
    # row 0 has no id, its copy has: that one stays
    assert sum(r.doc_id is None for r in got) == sum(1 for k in {int(c) for _, c, _ in want} if k and k % 5 == 0)
