"""Line shapes one by one, with the results written out by hand."""

import time

import pytest
from pyspark.sql import functions as F

from specloom.functions import patterns as P
from specloom.functions import text as X
from specloom.operators import answers, chunks, procedures, segments, specs, structure


def parsed(spark, text, dialect=P.WORKSHOP):
    return structure.parse(spark.createDataFrame([("d", text)], "doc_id string, text string"), dialect)


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


TABLE = """SECTION 204-01: Front Suspension 4WD 2014-03-01
SPECIFICATIONS
Description Nm lb-ft lb-in
Brake disc shield bolts 17 — 150
Shock absorber lower nuts 90 66 —
Bleeder screw 1.5-3.0 — 13-26
Note to be passed over 1 2 3
Hub cap screws
12
N/A
106
All dashes — — —
REMOVAL AND INSTALLATION
Not a row 1 2 3"""


def test_table_rows(spark):
    got = {r.component: r for r in specs.table_rows(parsed(spark, TABLE)).collect()}
    values = {c: (r.spec_value.value_nm, r.spec_value.value_lbft, r.spec_value.value_lbin) for c, r in got.items()}
    assert values == {"Brake disc shield bolts": (17, None, 150), "Shock absorber lower nuts": (90, 66, None), "Bleeder screw": (1.5, None, 13), "Hub cap screws": (12, None, 106)}
    r = got["Shock absorber lower nuts"]
    assert r.text == "Component: Shock absorber lower nuts — Torque: 90.0 Nm — (66.0 lb-ft) — [Front Suspension 4WD]"
    assert (r.section_id, r.subsection_type, r.vehicle_variant, r.confidence) == ("204-01", "SPECIFICATIONS", ["4WD"], 0.98)
    assert got["Hub cap screws"].confidence == 0.96 and got["Hub cap screws"].spec_value.raw == "Hub cap screws 12 N/A 106"


@pytest.mark.parametrize(
    "line, kind, nm, lbft, lbin, mm, stage, variants",
    [
        ("Tighten to 90 Nm (66 lb-ft).", "inline_torque", 90, 66, None, None, 0, []),
        ("(SVT Raptor) To install, tighten to 80 Nm (59 lb-ft)", "inline_torque", 80, 59, None, None, 0, ["SVT Raptor"]),
        ("Stage 1: Tighten in a cross pattern to 35 Nm (26 lb-ft).", "multi_stage_torque", 35, 26, None, None, 1, []),
        ("CV shaft depth minimum: 15.5 mm (0.61 in)", "dimensional_spec", None, None, None, 15.5, 0, []),
        ("Tighten the valve stem-to-TPMS sensor screw to 1.5 Nm (13 lb-in).", "inline_torque", 1.5, None, 13, None, 0, []),
        ("RWD all models: to 7 Nm (62 LB-IN)", "inline_torque", 7, None, None, None, 0, ["RWD", "All"]),
        ("to 1.2.3 Nm (4 lb-ft)", "inline_torque", None, 4, None, None, 0, []),
    ],
)
def test_inline_lines(spark, line, kind, nm, lbft, lbin, mm, stage, variants):
    (r,) = specs.inline_specs(parsed(spark, line)).collect()
    v = r.spec_value
    assert (r.content_type, v.value_nm, v.value_lbft, v.value_lbin, v.value_mm, r.stage_number, r.vehicle_variant) == (kind, nm, lbft, lbin, mm, stage, variants)


def test_a_second_torque_close_after_is_swallowed(spark):
    assert specs.inline_torques(parsed(spark, "to 5 Nm (4 lb-ft), then to 9 Nm (7 lb-ft)")).count() == 1


def test_component_guess(spark):
    guess = lambda s: one(spark, X.guess_component(F.lit(s)))
    assert guess("z The new bolts to 5 Nm (4 lb-ft)") == "The new bolts"
    assert guess("Tighten the bolts to 5 Nm (4 lb-ft)") == ""
    assert guess("nothing here") == ""


def test_generic_lines(spark):
    text = "AB-12  BRAKES\nPart tightened N·m kgf·cm ft·lbf\nCaliper pin 209 2,131 154\nStacked bolt\n35\n357\nz Tighten to 1.5–3.0 N·m.\nStage 2: turn to 90 N·m."
    lines = parsed(spark, text, P.GENERIC)
    rows = {r.component: r.spec_value for r in specs.generic_table_rows(lines).collect()}
    assert (rows["Caliper pin"].value_nm, rows["Caliper pin"].value_kgcm, rows["Caliper pin"].value_lbft) == (209, 2131, 154)
    assert (rows["Stacked bolt"].value_nm, rows["Stacked bolt"].value_kgcm, rows["Stacked bolt"].value_lbft) == (35, 357, None)
    inline = {r.content_type: r for r in specs.generic_inline_specs(lines).collect()}
    assert inline["inline_torque"].spec_value.value_nm == 1.5 and inline["inline_torque"].section_id == "AB-12"
    assert inline["multi_stage_torque"].stage_number == 2
    (r,) = specs.generic_inline_specs(parsed(spark, "Tighten to 209 N·m (2,131 kgf·cm, 154 ft·lbf)", P.GENERIC)).collect()
    assert (r.spec_value.value_nm, r.spec_value.value_kgcm, r.spec_value.value_lbft) == (209, 2131, 154)


def test_blocks_share_their_runs_first_line(spark):
    text = "SECTION 1: A\ndropped\n1. one\nmore\n2. two\nNOTICE: careful\nz bullet\nSPECIFICATIONS\nlost\n3. three"
    got = [(r.text, r.line_number, r.is_safety_critical) for r in procedures.blocks(parsed(spark, text)).orderBy("place").collect()]
    assert got == [("1. one\nmore", 2, False), ("2. two\nNOTICE: careful\nz bullet", 2, True), ("3. three", 9, False)]


def dedup_model(rows):
    seen = {}
    for r in rows:
        key = (r.component.lower().strip()[:60], r.spec_value.value_nm, r.section_id)
        if key not in seen:
            seen[key] = (r.seg_seq, r.seg_seq)
        elif r.content_type == "torque_table_row":
            seen[key] = (seen[key][0], r.seg_seq)
    return sorted(seen.values())


def test_dedup_equals_a_loop(spark):
    lines = ["SECTION 1: A", "SPECIFICATIONS", "Nm lb-ft", "Bolt 5 4 —", "bolt 5 3 —", "Bolt 5 9 —", "Nut 7 1 1", "ADJUSTMENTS"]
    lines += ["z x: 5 mm (0.2 in) and 6 mm (0.3 in)", "The Bolt to 5 Nm (4 lb-ft)", "to 5 Nm (4 lb-ft)", "Nm lb-ft", "Nut 7 2 2"]
    every = segments.all_segments(parsed(spark, "\n".join(lines))).filter(F.col("content_type") != "procedure_step")
    rows = sorted(every.collect(), key=lambda r: r.seg_seq)
    kept = segments.deduplicated(every).collect()
    assert sorted((r.seg_seq, next(x.seg_seq for x in rows if x.text == r.text and x.spec_value == r.spec_value)) for r in kept) == dedup_model(rows)


def test_documents_without_specs_fall_back(spark):
    docs = spark.createDataFrame([(1, "1. step only\nmore"), (2, "just\n\nprose \n \n here"), (3, "")], "doc_id long, text string")
    every, kept = segments.extract(docs)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "1. step only\nmore"), (2, "here"), (2, "just"), (2, "prose")]
    assert sorted(r.section_id for r in kept.filter("doc_id = 2").collect()) == ["para_0", "para_1", "para_2"]
    assert every.count() == kept.count()


def hard(text, most=400):
    out = []
    while len(text) > most:
        at = text.rfind(" ", 0, most)
        at = most if at == -1 else at
        out.append(text[:at].strip())
        text = text[at:].strip()
    return out + [text] if text else out


def split_model(text):
    import re

    if len(text) <= 400:
        return [text]
    pieces = [p.strip() for p in re.split(r"(?=\b\d{1,2}\.\s+\S)", text) if p.strip()]
    if len(pieces) <= 1 or max(map(len, pieces)) > 800:
        pieces, buf = [], ""
        for s in re.split(r"(?<=[.!?])\s+", text):
            if len(buf) + len(s) < 400:
                buf = (buf + " " + s).strip()
            else:
                pieces += [buf] if buf else []
                buf = s
        pieces += [buf] if buf else []
    return [c for i, p in enumerate(pieces) for c in hard(((pieces[i - 1][-60:] + " " if i else "") + p).strip())]


def test_procedure_splitting_equals_a_loop(spark):
    words = "tighten the bolt. Then check it! Is it tight? " * 30
    texts = ["short", words, "x" * 1000, "1. " + "go on " * 60 + "2. " + "stop " * 70, "a " + "y" * 900 + " z " + "w" * 401, "1. " + words + " 2. end", " ".join("é" * (i % 13 + 1) for i in range(300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.procedure_chunks(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == split_model(t), i


def test_a_long_text_is_split_once(spark):
    texts = [" ".join(f"sentence {i}{' word' * (i % 23)} ends{'.!?'[i % 3]}" for i in range(2000)), " ".join(f"{i % 90 + 1}. step {i}{' word' * (i % 150)}" for i in range(500))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.procedure_chunks(F.col("t")).alias("c"))
    plan = df._jdf.queryExecution().analyzed().toString()  # an expression in a lambda is worked out anew for each element
    assert (plan.count("(?U)(?<=[.!?])"), plan.count(r"\b\d{1,2}")) == (1, 1)
    got = {r.i: r.c for r in df.collect()}
    for i, t in enumerate(texts):
        assert got[i] == split_model(t), i


def test_long_texts_take_time_in_proportion(spark):
    texts = ["a" + " " * 120_000 + "b", " ".join(f"sentence {i}{' word' * 70} ends." for i in range(9000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.procedure_chunks(F.col("t")).alias("c"))
    began = time.perf_counter()
    got = {r.i: r.c for r in df.collect()}
    assert time.perf_counter() - began < 20
    for i, t in enumerate(texts):
        assert got[i] == split_model(t), i
    counts = [1, 2, 255, 256, 257, 1000]
    rows = spark.createDataFrame([(n, " ".join(f"{i}." for i in range(n))) for n in counts], "n int, t string")
    assert {r.n: r.c for r in rows.select("n", X.pack_sentences(F.col("t"), 2).alias("c")).collect()} == {n: [f"{i}." for i in range(n)] for n in counts}


def test_enrichment(spark):
    spec = lambda c, t, v=(): one(spark, chunks.enrich_spec(F.lit(t), F.lit("Front"), F.array(*map(F.lit, v)).cast("array<string>"), F.lit("SPECIFICATIONS"), F.lit(c)))
    assert spec("Nut (SVT Raptor)", "Component: Nut (SVT Raptor) — Torque: 5.0 Nm", ["4WD"]) == "SVT Raptor | SVT Raptor Nut | Section: Front | Variant: 4WD | Context: SPECIFICATIONS | Component: Nut (SVT Raptor) | Torque: 5.0 Nm"
    assert spec("", "to 5 Nm on SVT Raptor") == "SVT Raptor | SVT Raptor | Section: Front | Context: SPECIFICATIONS | to 5 Nm on SVT Raptor"
    assert one(spark, chunks.enrich_text(F.lit("on Lariat only"), F.lit("Front"))) == "Lariat | [Front] on Lariat only"


def test_values_and_units(spark):
    clean = lambda v: one(spark, answers.clean_value(F.lit(v)))
    assert [clean(v) for v in ("90.0", "1.50", " 7 ", "5-6", "N/A")] == ["90", "1.5", "7", "5-6", "N/A"]
    unit = lambda v: one(spark, answers.canonical_unit(F.lit(v)))
    assert [unit(v) for v in (" N·m", "ft-lb", "Inches", "bar")] == ["Nm", "lb-ft", "in", "bar"]
    about = lambda q: one(spark, answers.query_component(F.lit(q)))
    assert [about(q) for q in ("torque for brake caliper bolts", "What is the nut torque", "spec torque")] == ["brake caliper bolts", "the nut", "torque"]


def test_model_responses(spark):
    bad = 'text before {"specs": [{"component": "Nut", "value": "5", "unit": "Nm"}, {"component": "", "value": "1", "unit": "Nm"}]} after'
    rows = [(1, bad), (2, "no json"), (3, '{"specs": [{"component": "A", "value": "1", "unit": "mm", "spec_type": "Dimension"}], "confidence": 0.1}')]
    df = spark.createDataFrame([(*r, "s", "n", ["RWD"], "raw") for r in rows], "query_id int, response string, section_id string, section_name string, vehicle_variant array<string>, raw_text string")
    got = answers.parse_responses(df).collect()
    assert [(r.query_id, r.component, r.spec_type, r.confidence) for r in got] == [(1, "Nut", "Torque", 0.8)]
