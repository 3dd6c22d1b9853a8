from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specloom.llm import pfair


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_every_prefix_is_within_one_block(parts):
    slots = dict(enumerate(parts))
    period, got = sum(parts), Counter()
    for t, (n, j) in enumerate(pfair.one_period(slots), 1):
        assert got[n] == j
        got[n] += 1
        assert all(abs(got[k] - q * t / period) < 1 for k, q in slots.items())
    assert dict(got) == slots


def test_shares_add_up():
    assert sum(pfair.shares({"a": 1, "b": 1, "c": 1}, 4096).values()) == 4096
    assert pfair.shares({"a": 1.0, "b": 1e-9}, 16) == {"a": 15, "b": 1}
    with pytest.raises(ValueError):
        pfair.shares({"a": 0.0}, 8)


def rows():
    out = [(i, f"t{i}", "big") for i in range(700)] + [(i, f"u{i}", "small") for i in range(900, 990)] + [(i, "x", None) for i in range(2000, 2020)]
    return [*out, (None, None, "big"), (None, None, "big"), (3, "t3", "big"), (5000, "e", "")]


def frame(spark, data):
    return spark.createDataFrame([(*r, "c") for r in data], "doc_id long, text string, source string, slot string").repartition(5)


def test_schedule(spark):
    data = rows()
    got = pfair.schedule(frame(spark, data), weights={"big": 3, "small": 1, None: 1}, block_docs=8, period=100).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in got) == sorted((str(r[0]), str(r[2])) for r in data)
    slots = pfair.shares({"=big": 3.0, "=small": 1.0, "": 1.0, "=": 0.0}, 100)
    assert slots["=big"] == 59 and slots["="] == 1
    at = {}
    for r in got:
        assert at.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)  # a slot holds one block
    for source, key in (("big", "=big"), ("small", "=small"), (None, "")):
        mine = sorted((r for r in got if r.source == source), key=lambda r: (r.block, r.position))
        assert [r.doc_id for r in mine] == sorted((r[0] for r in data if r[2] == source), key=lambda i: -1 if i is None else i)
        assert [(r.block, r.position) for r in mine] == [(k // 8, k % 8) for k in range(len(mine))]
        last = mine[-1].block
        for r in mine:  # within one block of the weight while the source lasts
            if r.block < last:
                assert abs(r.block + 1 - slots[key] * (r.slot + 1) / 100) < 1


def test_interleave_writes_the_mixture(spark, tmp_path):
    data = rows()
    df = frame(spark, data)
    out = pfair.interleave(df, block_docs=8)
    assert out.columns == df.columns and out.count() == len(data)
    order = {(r.doc_id, r.source): (r.slot, r.position) for r in pfair.schedule(df, block_docs=8).collect()}
    places = [order[r.doc_id, r.source][0] for r in out.collect()]
    assert places == sorted(places)


def test_no_rows(spark):
    assert pfair.schedule(frame(spark, [])).count() == 0
    assert pfair.interleave(frame(spark, [])).count() == 0


def drift(got, weights):
    """The largest distance from the unrounded weight, in blocks, before or after a block of a source that lasts."""
    total, last = sum(weights.values()), Counter()
    for r in got:
        last[r.source] = max(last[r.source], r.block)
    until = min(r.slot for r in got if r.block == last[r.source])  # all sources last so long
    return max(max(abs(r.block + 1 - weights[r.source] / total * (r.slot + 1)), abs(r.block - weights[r.source] / total * r.slot)) for r in got if r.slot < until)


def test_no_drift_over_many_periods(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    data = [(i, "x", s) for i, s in enumerate("a" * 1500 + "b" * 900 + "c" * 600)]
    got = pfair.schedule(frame(spark, data), weights=weights, block_docs=1, period=32).collect()  # 94 periods
    assert len({r.slot for r in got}) == len(data) and drift(got, weights) < 1
    data = [(i, "x", f"s{i % 20}") for i in range(6000)]
    got = pfair.schedule(frame(spark, data), block_docs=1, period=170).collect()  # 8.5 slots each, 35 periods
    assert len({r.slot for r in got}) == len(data) and drift(got, {f"s{k}": 1 for k in range(20)}) < 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0.01, 10), min_size=1, max_size=8), st.integers(0, 3))
def test_exact_weights(weights, without):
    named = dict(enumerate([*weights, *[0.0] * without]))
    exact = pfair.exact_weights(named, 100)
    total = sum(exact.values())
    assert all(exact[n] * 100 == total for n, w in named.items() if not w)
    if not without:
        assert all(exact[0] * pfair.Fraction(w) == exact[n] * pfair.Fraction(weights[0]) for n, w in named.items())
    got = Counter()
    for n, j, t in pfair.in_slots(exact, dict.fromkeys(exact, 50)):
        assert got[n] == j and j * total // exact[n] <= t < -(-(j + 1) * total // exact[n])
        got[n] += 1
    assert got == dict.fromkeys(exact, 50)


def test_more_sources_than_a_hundred_thousand(spark):
    docs = spark.range(100_050).selectExpr("id as doc_id", "concat('t', id) as text", "concat('s', id) as source")
    got = pfair.schedule(docs.unionByName(docs.limit(40)))
    assert got.count() == 100_090 and got.select("slot", "position").distinct().count() == 100_090
