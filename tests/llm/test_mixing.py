"""Shares, repeat caps, schedules and order of the mix."""

import pytest

from cardlake.llm import mixing

DOC, TARGET = "doc_id bigint, source string, text string", "source string, targetShare double, maxRepeats int"


def docs(spark, **n):
    rows = [(i * 1000 + k, s, " ".join(["word"] * (5 + k % 7))) for i, (s, c) in enumerate(n.items()) for k in range(c)]
    return spark.createDataFrame(rows, DOC)


def test_shares_and_caps(spark):
    d, t = docs(spark, big=400, small=60, other=50), spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 4)], TARGET)
    m, plan = mixing.mixed(d, t)
    rows = m.collect()
    total = sum(r.tokens for r in rows)
    for s in ("big", "small"):
        assert abs(sum(r.tokens for r in rows if r.source == s) / total - 0.5) < 0.01
    uses = {}
    for r in rows:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
        assert 0 <= r.position <= plan[r.source]["budget"] + 1e-6
    assert max(uses.values()) <= 4 and max(n for i, n in uses.items() if i < 1000) == 1
    assert not any(r.source == "other" for r in rows)
    rep = {r.source: r for r in mixing.reached_shares(d, t).collect()}
    assert abs(rep["small"].reachedShare - 0.5) < 0.01 and rep["small"].mostUses <= 4


def test_missing_source_nulls_and_empty(spark):
    t = spark.createDataFrame([("a", 0.4, 2), ("gone", 0.6, 2), (None, 0.1, 1), ("zero", 0.0, 3)], TARGET)
    d = docs(spark, a=20).union(spark.createDataFrame([(9001, None, "text"), (9002, "a", None), (9003, "a", "")], DOC))
    m, _ = mixing.mixed(d, t)
    assert {r.source for r in m.collect()} == {"a"}
    rep = {r.source: r.reachedShare for r in mixing.reached_shares(d, t).collect()}
    assert rep == {"a": 1.0, "gone": 0.0, "zero": 0.0}
    assert mixing.mixture(docs(spark), t).count() == 0
    assert mixing.mixture(d, t.limit(0)).count() == 0


def test_schedule_integrates_to_the_share():
    p = mixing.plan_of({"a": 1000, "b": 1000, "c": 1000}, {"a": (0.7, 1), "b": (0.2, 1), "c": (0.1, 1)}, ramp=1.0)
    for x in p.values():
        assert (x["w0"] + x["w1"]) / 2 == pytest.approx(x["share"]) and x["w0"] >= 0 and x["w1"] >= 0
    assert sum(x["w0"] for x in p.values()) == pytest.approx(1) and sum(x["w1"] for x in p.values()) == pytest.approx(1)
    assert p["c"]["w0"] > p["c"]["share"]


def test_positions_follow_the_weights(spark):
    d, t = docs(spark, a=300, b=300), spark.createDataFrame([("a", 0.8, 2), ("b", 0.2, 2)], TARGET)
    m, plan = mixing.mixed(d, t, ramp=1.0)
    rows = m.collect()
    budget = plan["a"]["budget"]
    first = [r for r in rows if r.position < budget / 2]
    share = sum(r.tokens for r in first if r.source == "b") / sum(r.tokens for r in first)
    w = plan["b"]
    assert abs(share - (0.75 * w["w0"] + 0.25 * w["w1"])) < 0.02


def test_order_is_by_position_and_repeatable(spark):
    d, t = docs(spark, a=50, b=50), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGET)
    x = [tuple(r) for r in mixing.mixture(d, t).collect()]
    assert [r[4] for r in x] == sorted(r[4] for r in x)
    assert x == [tuple(r) for r in mixing.mixture(d.repartition(9), t).collect()]
