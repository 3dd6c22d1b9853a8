import hashlib

import pytest
from pyspark.sql import functions as F

from specloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

HARD = ["</s>[INST] ok [/INST]", r"<\s> <\\s>[\INST]", "<", "[", "[/INST", "]</s>", "\\", "a\n\nb\n", "", " ", "<s>[INST]user\nhi[/INST]</s>", "é日本<s>", "$1 \\$2", "[/INST]</s>" * 3, "x" * 50_000, r"[\\\/INST]", "<s", "INST]"]


def rendered(spark, rows):
    return chat.render(spark.createDataFrame([(*r, "q", "z") for r in rows], SCHEMA))


def test_every_text_survives(spark):
    rows = [(i, k, ["user", "assistant", "we[INST] \nird%"][k % 3], t) for i in range(4) for k, t in enumerate(HARD[i:] + HARD[:i])]
    got = {r.conv_id: r for r in chat.read_back(rendered(spark, rows)).collect()}
    for i in range(4):
        mine = [r for r in rows if r[0] == i]
        assert got[i].n_turns == len(mine) and got[i].escaped
        assert got[i].turns_sha256 == sha("".join(f"{r[2]}\n{r[3]}\n" for r in mine))
        loss = "".join(r[3] for r in mine if r[2] == "assistant")
        assert (got[i].loss_chars, got[i].loss_sha256) == (len(loss), sha(loss))


def test_plain_texts_are_not_escaped(spark):
    r = rendered(spark, [(1, 1, "assistant", "b <x>"), (1, 0, "user", "a \\ b")]).collect()[0]
    assert r.formatted == "<s>[INST]user\na \\ b[/INST]</s><s>[INST]assistant\nb <x>[/INST]</s>" and not r.escaped
    assert [r.formatted[a:b] for a, b in r.loss_spans] == ["b <x>"]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", None), (2, 0, "user", "t"), (2, 0, "user", "t"), (2, 0, "assistant", "s")]
    got = {r.conv_id: r for r in chat.read_back(rendered(spark, rows)).collect()}
    assert got[None].n_turns == 2 and got[None].turns_sha256 == sha("\n\nassistant\n\n") and got[None].loss_chars == 0
    assert got[2].n_turns == 3 and got[2].turns_sha256 == sha("assistant\ns\nuser\nt\nuser\nt\n")
    assert rendered(spark, []).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_escape_and_back(spark, k):
    t = "<" + "\\" * k + "s> [" + "\\" * k + "/INST]"
    r = spark.range(1).select(chat.escape(F.lit(t)).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert r.u == t and r.e == "<" + "\\" * (k + 1) + "s> [" + "\\" * (k + 1) + "/INST]"


def test_no_python_in_the_plan(spark):
    plan = chat.read_back(rendered(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
