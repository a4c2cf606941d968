"""Segmentation against exhaustive search; runs of sessions against direct loops."""

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as hs

from cardlake.llm import runs


def cost(labels, cuts, penalty, weights):
    total, at = 0.0, 0
    for end in [*cuts, len(labels)]:
        part = labels[at:end]
        total += penalty + min(sum(runs.dissimilarity(x, r, weights) for x in part) for r in part)
        at = end
    return total


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.sampled_from(["move:a:1:2", "move:a:1:3", "move:b:1:2", "draw"]), min_size=1, max_size=9), hs.sampled_from([0.2, 0.5, 0.9, 1.7]), hs.sampled_from([(1.0, 1.0, 1.0, 1.0), (1.0, 0.4, 0.3, 0.3)]))
def test_pruned_search_is_optimal(labels, penalty, weights):
    best = min(cost(labels, c, penalty, weights) for k in range(len(labels)) for c in itertools.combinations(range(1, len(labels)), k))
    seg = runs.segments(labels, [1] * len(labels), penalty, weights)
    assert seg[0][0] == 0 and seg[-1][1] == len(labels) and all(a[1] == b[0] for a, b in zip(seg, seg[1:]))
    assert abs(cost(labels, [s[0] for s in seg[1:]], penalty, weights) - best) < 1e-9


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.sampled_from("abc"), min_size=1, max_size=30))
def test_small_penalty_gives_the_equal_runs(labels):
    got = [(a, b) for a, b, _ in runs.segments(labels, [1] * len(labels), runs.EXACT_PENALTY)]
    exp, at = [], 0
    for _, g in itertools.groupby(labels):
        n = len(list(g))
        exp.append((at, at + n))
        at += n
    assert got == exp


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity string, turn int, time bigint, label string")


def direct(rows):
    out, block = set(), []
    for e, t, _, label in sorted((r for r in rows if r[0] and r[1] is not None and r[3]), key=lambda r: (r[0], r[1])):
        if block and (block[-1][0] != e or block[-1][2] != label or t - block[-1][1] > 1):
            out.add((block[0][0], block[0][1], block[-1][1], len(block)))
            block = []
        block.append((e, t, label))
    if block:
        out.add((block[0][0], block[0][1], block[-1][1], len(block)))
    return out


def test_sessions_in_chunks(spark):
    r = random.Random(7)
    rows = [(e, t, 1000 * t, r.choice(["a", "a", "a", "b", None])) for e in ("x", "y") for t in range(-5, 120) if r.random() > 0.1]
    for chunk in (1, 7, 4096):
        got = {(q.entity, q.firstTurn, q.lastTurn, q.events) for q in runs.collapse_runs(frame(spark, rows), chunk=chunk).collect()}
        assert got == direct(rows)


def test_duration_nulls_and_empty(spark):
    rows = [("e", 0, 500, "a"), ("e", 1, None, "a"), ("e", 2, 900, "a"), (None, 1, 1, "a"), ("e", None, 1, "a"), ("e", 4, None, "a")]
    got = {(q.firstTurn, q.lastTurn): q.duration_ms for q in runs.collapse_runs(frame(spark, rows)).collect()}
    assert got == {(0, 2): 400, (4, 4): None}
    assert runs.collapse_runs(frame(spark, [])).count() == 0


def test_near_identical_events_collapse(spark):
    rows = [("e", t, t, x) for t, x in enumerate(["move:7s:1:2", "move:7s:1:3", "move:7s:1:2", "draw", "draw"])]
    got = sorted((q.firstTurn, q.lastTurn, q.label) for q in runs.collapse_runs(frame(spark, rows), 0.6, (1.0, 0.4, 0.3, 0.3)).collect())
    assert got == [(0, 2, "move:7s:1:2"), (3, 4, "draw")]


def test_decisions_to_events(spark):
    d = lambda x: '{"chosenDescribe": "%s"}' % x
    rows = [
        (1, "s", "i1", 0, 5, d("Draw from stock")),
        (2, "s", "I1 ", 0, 5, d("Draw from stock")),
        (3, "s", "i2", 1, 6, d("stock → waste")),
        (4, "s", "i3", 2, 7, '{"chosenDescribe": ""}'),
        (5, "s", "i4", 3, 8, "[1]"),
        (6, "s", None, 4, None, d("RECYCLE")),
        (7, "", "i5", 5, 9, d("RECYCLE")),
        (8, "s", "i6", None, 9, d("RECYCLE")),
        (9, "s", "i7", 6, 9, None),
        (10, "s", "i8", 7, 9, '{"chosenDescribe": "Draw'),
    ]
    df = spark.createDataFrame(rows, "rowId bigint, sessionId string, id string, turnIndex int, timestamp bigint, decision string")
    got = sorted((r.turn, r.label) for r in runs.decision_events(df).collect() if r.label)
    assert got == [(0, "draw"), (1, "draw"), (4, "recycle")]


def test_the_program_decides(spark):
    """Ablation: over the same events another penalty or other weights give other runs, so runs are what the cheapest
    segmentation makes of the raw events."""
    rows = [("e", t, t, x) for t, x in enumerate(["move:7s:1:2", "move:7s:1:3", "move:7s:1:2", "draw", "draw", "recycle", "draw"])]
    cuts = lambda *a: [q[0] for q in sorted((q.firstTurn, q.lastTurn) for q in runs.collapse_runs(frame(spark, rows), *a).collect())]
    assert cuts() == [0, 1, 2, 3, 5, 6]
    assert cuts(0.6) == [0, 3]
    assert cuts(0.25, (1.0, 0.4, 0.3, 0.1)) == [0, 3, 5, 6]


def test_a_long_run_costs_its_length():
    c = runs.Cuts(runs.EXACT_PENALTY)
    for i in range(50_000):
        c.push("draw", 1)
        assert len(c.live) <= 2
    assert c.rest() == [(0, 50_000, "draw")]


GRADED = (0.6, (1.0, 0.4, 0.3, 0.3))


def test_graded_runs_do_not_depend_on_chunks(spark, monkeypatch):
    monkeypatch.setattr(runs, "SETTLE", 5)
    rows = [("x", t, t, "move:7s:1:2" if t < 4 else "move:7s:1:3") for t in range(5)]
    rows += [("long", t, t, random.Random(t).choice(["move:a:1:2", "move:a:1:3", "move:a:2:3", "move:b:1:2", "draw"])) for t in range(300) if t % 97]
    for chunk in (4, 4096):
        got = {(q.entity, q.firstTurn, q.lastTurn, q.events, q.label, q.duration_ms) for q in runs.collapse_runs(frame(spark, rows), *GRADED, chunk=chunk).collect()}
        exp = {("x", 0, 4, 5, "move:7s:1:2", 4)}
        for lo, hi in ((1, 97), (98, 194), (195, 291), (292, 300)):
            labels = [r[3] for r in rows if r[0] == "long" and lo <= r[1] < hi]
            exp |= {("long", lo + a, lo + b - 1, b - a, x, b - 1 - a) for a, b, x in runs.segments(labels, [1] * len(labels), *GRADED)}
        assert got == exp


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.sampled_from(["move:a:1:2", "move:a:1:3", "move:a:2:3", "draw"]), min_size=1, max_size=60), hs.integers(1, 7))
def test_settled_runs_are_final(labels, every):
    c, got = runs.Cuts(*GRADED), []
    for i, x in enumerate(labels):
        c.push(x, 1)
        if i % every == 0:
            got += c.settled()
    got += c.rest()
    best = runs.segments(labels, [1] * len(labels), *GRADED)
    assert got[0][0] == 0 and got[-1][1] == len(labels) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert abs(cost(labels, [g[0] for g in got[1:]], *GRADED) - cost(labels, [g[0] for g in best[1:]], *GRADED)) < 1e-9
