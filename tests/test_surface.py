"""Registered queries against their SQL, upload checks, companion texts, tables by position, session numbers, demos."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from specloom import cli
from specloom.plans import engine as E
from specloom.plans import queries, surface  # noqa: F401
from specloom.sources import readers, tables

DATA = "/root/testdata/sf0.001"
MORE = ["procedure_chunk_texts", "context_hints", "chunk_table", "fallback_chain", "generic_lines", "generic_stacked", "coordinate_segments", "segment_json", "question_file", "json_export", "model_responses", "empty_answers", "two_kinds_search", "hash_vectors", "text_sink"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the synthetic tables are not here")
@pytest.mark.parametrize("name", MORE)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "part", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, DATA).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_uploads_are_checked(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    readers.check_upload(spark, str(tmp_path))
    (tmp_path / "b.docx").write_text("x")
    with pytest.raises(ValueError, match="neither"):
        E.Engine(spark, str(tmp_path / "e")).ingest(str(tmp_path))
    (tmp_path / "b.docx").unlink()
    (tmp_path / "a.txt").write_text("")
    with pytest.raises(ValueError, match="empty"):
        readers.check_upload(spark, str(tmp_path))


def test_text_beside_an_unreadable_pdf(spark, tmp_path):
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (tmp_path / name).write_bytes(b"%PDF-1.4 nothing to read")
    (tmp_path / "a_cleaned.txt").write_text("second choice")
    (tmp_path / "a.txt").write_text("first choice")
    (tmp_path / "b_cleaned.txt").write_text("of b")
    (tmp_path / "extracted_text.txt").write_text("of all")
    found = {r.source_file: r.text for r in readers.read_documents(spark, str(tmp_path)).filter("extraction_method = 'none'").collect()}
    assert found == {"a.pdf": "first choice", "b.pdf": "of b", "c.pdf": "of all"}


def test_tables_by_position_reach_the_index(spark, tmp_path):
    rows = [("d1", "AB-1  TITLE\nPart N·m ft·lbf\nplain nut 25 -\n", [(1, [["Part", "Torque N·m"], ["Cell nut", "77"]])]), ("d2", "AB-1  TITLE\nPart N·m ft·lbf\nother nut 30 -\n", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, tables array<struct<page:int,rows:array<array<string>>>>")
    one = E.Engine(spark, str(tmp_path), config=E.Config(generic=True))
    assert one.health() == {"status": "ok", "sessions": 0, "model": False}
    one.add(docs, "s")
    assert one.health()["sessions"] == 1 and one.bundle.sessions() == ["s"]
    chunks, _ = one.bundle.load("s")
    assert {r.component for r in chunks.filter("chunk_type = 'spec'").collect()} == {"plain nut", "Cell nut", "other nut"}


def test_session_numbers_run_through_all_documents(spark):
    rows = [(kind, f"d{d:02}", p) for kind in ("spec", "procedure") for d in range(30) for p in range(d % 4)]
    got = E.numbered(spark.createDataFrame(rows, "chunk_type string, doc_id string, chunk_pos int").withColumn("was", F.col("chunk_pos")).repartition(5)).collect()
    for kind in ("spec", "procedure"):
        mine = sorted((r.chunk_pos, r.doc_id, r.was) for r in got if r.chunk_type == kind)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_forgotten_tables_are_deleted(spark):
    with tables.forgotten():
        t = tables.materialise(spark.range(3), "gone")
        assert t.count() == 3
        path = t._table_path.removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.isdir(path)
    kept = tables.materialise(spark.range(3), "kept")
    tables.discard(kept)
    assert not os.path.isdir(kept._table_path.removeprefix("file://"))


def test_demos_and_configuration(spark, tmp_path):
    assert [len(E.demo(n)) for n in ("api", "extraction", "retrieval", "suggestions")] == [10, 8, 5, 6]
    assert E.demo("retrieval")[2] == ("How to install lower control arm", None, False) and E.demo("extraction")[1] == ("Shock absorber lower nuts specification", "4WD", True)
    one = E.Engine(spark, str(tmp_path))
    assert one.configure(k=7).k == 7 and one.config.k == 7
    with pytest.raises(ValueError):
        one.configure(k=21)


def test_interactive_session(spark, tmp_path, monkeypatch, capsys):
    E.Engine(spark, str(tmp_path)).add(spark.createDataFrame([("d", "SECTION 1-1: Brakes\nTighten the caliper bolt to 30 Nm (22 lb-ft).")], "doc_id string, text string"), "s")
    lines = iter(["caliper bolt torque", "quit", "never asked"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    assert cli.main(["--path", str(tmp_path), "interactive", "s"], spark) == 0
    shown = [x for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(shown) == 1 and "30" in shown[0]
