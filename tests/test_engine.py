"""From files to answers, and the plans' shape."""

import math
import random

import pytest
from pyspark.sql import functions as F

from specloom import cli
from specloom.operators import context, retrieval, segments
from specloom.plans import backends
from specloom.plans.engine import Config, Engine, summary
from specloom.plans.history import History
from specloom.sources import readers, sinks
from specloom.streaming import ingest

MANUAL = """SECTION 204-01: Front Suspension 4WD
SPECIFICATIONS
Description Nm lb-ft lb-in
Shock absorber lower nuts 90 66 —
Stabilizer bar link nuts 80 59 —
REMOVAL AND INSTALLATION
1. Remove the wheel and the tire before any other work.
z Tighten the new nut to 350 Nm (258 lb-ft).
2. NOTICE: Do not tighten the lower shock nut on SVT Raptor until the end.
z To install, tighten to 81 Nm (60 lb-ft).
SECTION 206-03: Brakes RWD
SPECIFICATIONS
Description Nm lb-ft lb-in
Brake caliper bolts 37 27 —
"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("engine")
    (d / "in").mkdir()
    (d / "in" / "manual.txt").write_text(MANUAL, encoding="utf-8")
    (d / "in" / "empty.txt").write_text("")
    e = Engine(spark, str(d / "data"), config=Config(k=3))
    assert e.ingest(str(d / "in"), "s1") == "s1"
    return e


def test_answers(engine):
    got = engine.ask(["brake caliper bolts torque", "shock absorber lower nuts"], "s1", remember=True)
    assert {"component": "Brake caliper bolts", "spec_type": "Torque", "value": "37", "unit": "Nm"} in got[0]["results"]
    assert {"component": "Shock absorber lower nuts", "spec_type": "Torque", "value": "66", "unit": "lb-ft"} in got[1]["results"]
    assert engine.history.newest().count() == 2


def test_variant_filter_and_fallback(engine):
    got = engine.ask(["torque for nut"], "s1", variant="RWD", spec_only=False, force_llm=True)
    assert all(r["source"] == "regex_fallback" for r in got[0]["full_results"])
    rows = engine.spark.createDataFrame([(0, "nuts", "RWD")], "query_id int, query string, variant string").transform(lambda d: d.withColumn("spec_only", F.lit(True)).withColumn("force_llm", F.lit(False)))
    assert all(not r.vehicle_variant or "RWD" in r.vehicle_variant for r in engine.retrieve(rows, "s1").collect())


def test_questions_without_answer_get_a_row(engine):
    got = engine.ask(["zzz"], "s1", variant="no such variant", spec_only=True)
    assert len(got) == 1 and got[0]["query"] == "zzz"


def test_model_path(engine):
    class Fake:
        def online(self):
            return True

        def generate(self, prompt):
            return '{"specs": [{"component": "X", "value": "5.0", "unit": "newton metres"}], "confidence": 0.9}' if "Question: q" in prompt else "{}"

    e = Engine(engine.spark, engine.path, extractor=Fake(), config=Config(k=2))
    (r,) = e.ask(["q"], "s1", spec_only=False, force_llm=True)
    assert r["results"] == [{"component": "X", "spec_type": "Torque", "value": "5", "unit": "Nm"}]


def test_unknown_session(engine):
    with pytest.raises(KeyError):
        engine.bundle.load("nope")


def test_sinks(engine, tmp_path):
    q = engine.spark.createDataFrame([(0, "stabilizer bar link nuts")], "query_id int, query string")
    full = engine.answer(q, "s1").join(q, "query_id").persist()
    sinks.write_csv(full, str(tmp_path / "csv"), full=True)
    back = engine.spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == sinks.FULL and back.count() == full.count()
    assert sinks.csv_lines_always_quoted(full).first().line.startswith('"')
    assert "|" not in sinks.csv_lines_never_quoted(full).first().line
    assert sinks.json_records(full).first().json.startswith('[{"component":')
    assert summary(engine.responses(q, "s1")).first().queries == 1


def test_history(spark, tmp_path):
    h = History(spark, str(tmp_path))
    assert h.newest().count() == 0
    rows = spark.createDataFrame([(f"e{i}", f"query {i}", i) for i in range(130)], "entry_id string, query string, i int")
    h.append(rows.select("entry_id", F.timestamp_seconds("i").alias("ts"), "query", F.lit(None).cast("string").alias("variant"), F.lit(0).cast("long").alias("n_results")))
    assert [r.entry_id for r in h.newest(3).collect()] == ["e129", "e128", "e127"]
    assert h.newest(1000).count() == 100
    h.delete("e129")
    assert h.newest(1).first().entry_id == "e128"
    h.delete()
    assert h.all().count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\nb\n".encode() + b"\xff")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing readable")
    (tmp_path / "b.txt").write_text("beside")
    got = {r.source_file: r for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "é\nb\n�" and got["b.pdf"].extraction_method == "none" and got["b.pdf"].text == "beside"
    (tmp_path / "q").write_text("  one  \n# no\n\n # yes\ntwo\n")
    assert sorted(r.query for r in readers.read_queries(spark, str(tmp_path / "q")).collect()) == ["# yes", "one", "two"]


def test_pdf_pages_and_tables(spark):
    class Fake:
        def pages(self, data):
            return ["", "1 2\n3 4\n5 6\n7 8", "prose"]

        def tables(self, data, pages):
            return [(n, [["a", " "], ["", ""], ["5", "6"]]) for n in pages]

    files = spark.createDataFrame([("x.pdf", bytearray(b"%PDF"))], "path string, content binary")
    r = readers.assemble(readers.decode_pdfs(files, (Fake(),))).first()
    assert r.text == "<<PAGE 2>>\n1 2\n3 4\n5 6\n7 8\n<<PAGE 3>>\nprose\n<<STRUCTURED_TABLES>>\n<<TABLE page=2>>\na\t—\n5\t6"
    assert (r.total_pages, r.table_pages, r.extraction_method) == (2, 1, "Fake")


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.txt").write_text(MANUAL)
    e = Engine(spark, str(tmp_path / "data"))
    q = ingest.watch(e, str(tmp_path / "in"), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    chunks, _ = e.bundle.load("batch-0")
    assert chunks.filter("chunk_type = 'spec'").count() > 0


def test_cli(engine, capsys):
    assert cli.main(["--path", engine.path, "ask", "s1", "brake", "caliper", "bolts"], engine.spark) == 0
    assert "Brake caliper bolts" in capsys.readouterr().out


def bm25_model(docs, question):
    import re

    toks = [re.findall("[a-z0-9]+", d.lower()) for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = []
    for t in toks:
        out.append(round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in re.findall("[a-z0-9]+", question.lower())), 6))
    return sorted(range(n), key=lambda i: (-out[i], -i)), out


def test_bm25_equals_a_loop(spark):
    r = random.Random(3)
    docs = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 9))) for _ in range(30)]
    chunks = spark.createDataFrame([("k", i, d) for i, d in enumerate(docs)], "index_key string, chunk_pos int, text string")
    q = spark.createDataFrame([(0, "a b b"), (1, "zz")], "query_id int, query string")
    top = retrieval.bm25_top(retrieval.bm25_index(chunks), q, 12).collect()
    for i, text in ((0, "a b b"), (1, "zz")):
        order, score = bm25_model(docs, text)
        got = sorted((x for x in top if x.query_id == i), key=lambda x: x.rank)
        assert [x.score for x in got] == pytest.approx([score[j] for j in order[:12]], abs=2e-6)
        assert i == 0 or [x.chunk_pos for x in got] == order[:12]


def test_hash_embeddings_are_unit_vectors(spark):
    e = backends.HashEmbedder(16)
    v = spark.createDataFrame([("lower nuts",), ("Nuts lower",)], "t string").select(e.documents(F.col("t")).alias("v")).collect()
    assert v[0].v == v[1].v and sum(x * x for x in v[0].v) == pytest.approx(1)


def test_top_k_is_limited_before_the_sort_ends(spark):
    vectors = spark.range(50).select(F.lit("k").alias("index_key"), F.col("id").alias("chunk_pos"), F.array(F.col("id").cast("float")).alias("embedding"))
    q = spark.range(2).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("qvec"))
    df = retrieval.dense_top(vectors, q, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan
    assert [r.chunk_pos for r in df.filter("query_id = 0").orderBy("rank").collect()] == [49, 48, 47]


def test_fusion_ignores_the_order_of_its_rows(spark):
    dense = spark.createDataFrame([(0, "k", i, i) for i in range(5)], "query_id int, index_key string, chunk_pos int, rank int")
    sparse = spark.createDataFrame([(0, "k", 9 - i, i) for i in range(5, 10)] + [(0, "k", 7, 0)], "query_id int, index_key string, chunk_pos int, rank int")
    a = retrieval.fuse_within(dense, sparse, 4).orderBy("rank").collect()
    b = retrieval.fuse_within(dense.orderBy(F.desc("rank")), sparse.orderBy("rank"), 4).orderBy("rank").collect()
    assert a == b


def test_deferred_step_keeps_the_phrase(spark):
    lines = ["SECTION 1: A", "1. first", "NOTICE: Do not tighten the lower shock nut on SVT Raptor.", "2. second", "z to 5 Nm (4 lb-ft)", "3. third", "z to 6 Nm (5 lb-ft)"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    every, kept = segments.extract(docs)
    got = {r.line_number: r.hint for r in context.hints(every, kept).collect()}
    assert got == {4: "SVT Raptor", 6: "lower shock nut (SVT Raptor)"}


def hints_model(every, kept):
    """The lookups as loops over one document's segments."""
    import re

    from specloom.functions import patterns as P

    trim, phrase = re.compile(P.TRIM), re.compile(P.PHRASE)
    found, source = {}, {}
    for s in kept:
        ln, v = s.line_number, s.spec_value.value_nm if s.spec_value else None
        if s.component.strip() or not ln:
            continue
        source.pop(ln, None)
        tables = [t for t in kept if t.component.strip() and t.content_type == "torque_table_row" and t.spec_value.value_nm and t.section_id == s.section_id]
        close = [(abs(v - t.spec_value.value_nm) / max(t.spec_value.value_nm, 1), abs(t.line_number - ln), t.seg_seq, t.component) for t in tables if v is not None]
        close = [c for c in close if c[0] <= 0.05]
        if close:
            found[ln] = min(close)[3]
            continue
        named = [t for t in every if ln - 30 <= t.line_number < ln and t.component.strip()]
        if named:
            found[ln] = max(named, key=lambda t: (t.line_number, -t.seg_seq)).component.strip()
            continue
        back = [t for t in every if ln - 150 <= t.line_number < ln and trim.search(t.text)]
        ahead = [t for t in every if ln < t.line_number <= ln + 40 and trim.search(t.text)]
        if back:
            t = max(back, key=lambda t: (t.line_number, phrase.search(t.text) is not None, -t.seg_seq))
            p = phrase.search(t.text)
        elif ahead:
            t, p = min(ahead, key=lambda t: (t.line_number, t.seg_seq)), None
        else:
            continue
        name = trim.search(t.text).group(1)
        found[ln] = f"{p.group(1).strip()} ({name})" if p else name
        source[ln] = (t.line_number, name)
    for line in {x for x, _ in source.values()}:
        for ln in sorted(n for n, x in source.items() if x[0] == line)[:-1]:
            found[ln] = source[ln][1]
    return found


def test_hints_equal_a_loop(spark):
    r = random.Random(5)
    lines = []
    for s in range(4):
        lines += [f"SECTION 10{s}: Part {s}", "SPECIFICATIONS", "Nm lb-ft"] + [f"Bolt {s}{i} {r.randint(5, 60)} 3 —" for i in range(3)] + ["ADJUSTMENTS"]
        for _ in range(60):
            lines.append(
                r.choice(
                    [
                        f"z Tighten all to {r.randint(5, 90)} Nm (4 lb-ft).",
                        "NOTICE: Do not tighten the lower shock nut on SVT Raptor.",
                        "1. Remove the Lariat trim.",
                        "z Nothing of note.",
                        "2. Look at it.",
                        "z Gap: 5.5 mm (0.2 in).",
                        "The long link to 33 Nm (24 lb-ft).",
                    ]
                )
            )
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    every, kept = segments.extract(docs)
    got = {x.line_number: x.hint for x in context.hints(every, kept).collect()}
    order = lambda rows: sorted(rows, key=lambda x: x.seg_seq)
    want = hints_model(order(every.collect()), order(kept.collect()))
    assert got == want and len(set(want.values())) > 5
