"""Sequential searches against the direct engine, and documents."""

import random

from pyspark.sql import functions as F

from cardlake.functions import board as bd
from cardlake.operators import documents as doc
from cardlake.operators import solver
from cardlake.plans import boards as plans
from cardlake.plans import more
from tests import engine as en
from tests.test_boards import blank, boards, custom, full


def number(c):
    return c[0] * 8 + en.SUITS.index(c[1]) * 2 + c[2]


def state(b):
    t = lambda p: tuple(number(c) for c in p)
    return tuple(map(t, b["tab"])), tuple(map(t, b["fnd"])), t(b["stock"]), t(b["waste"])


def test_text_form_and_children_agree_with_the_engine(spark):
    for r in boards(spark).select("game", solver.as_text(F.col("board")).alias("t")).collect():
        b = en.deal(r.game)
        s = solver.from_text(r.t)
        assert s == state(b)
        exp = [state(en.apply(b, m)) for m in en.moves(b) if m[0] != "stock_to_waste"]
        assert [t for m, t in solver.children(s) if m[0] not in ("draw", "recycle")] == exp


def test_solves_the_last_kings(spark):
    b = blank(fnd=full(12))
    for i, s in enumerate(en.SUITS):
        b["tab"][i] = [(13, s, True)]
    r = solver.solve_boards(custom(spark, b, blank()), cap=500).collect()
    got = {x.game: (x.verdict, x.length) for x in r}
    assert got == {0: ("SOLVED", 4), 1: ("UNSOLVABLE", 0)}
    assert solver.solve(state(en.deal(3)), 1)[0] == "UNKNOWN"


def test_tree_is_preorder_and_may_pass_its_budget(spark):
    nodes = solver.tree(state(en.deal(17)), 3, 5)
    assert [n[0] for n in nodes] == list(range(len(nodes))) and all(n[1] is None or n[1] < n[0] for n in nodes)
    s = {x.game: x for x in solver.tree_statistics(solver.trees(boards(spark), 2, 100)).collect()}
    for g, x in s.items():
        ns = solver.tree(state(en.deal(g)), 2, 100)
        assert x.nodes == len(ns) and x.leaves == len({n[0] for n in ns} - {n[1] for n in ns})


def test_board_documents(spark):
    j = '{"tableau": [[{"rank": 5, "suit": "clubs"}]], "foundations": [[{"rank": 1, "suit": "clubs", "face_up": false}]], "stock": [{"rank": 2, "suit": "hearts"}], "waste": []}'
    b = spark.createDataFrame([(j,)], "j string").select(doc.board_from_json(F.col("j")).alias("b")).first().b
    assert b.tableau[0][0].face_up and b.foundations[0][0].face_up and not b.stock[0].face_up and b.score == 0
    same = boards(spark).select((bd.state_key(F.col("board")) == bd.state_key(doc.board_from_json(doc.board_to_json(F.col("board"))))).alias("x")).collect()
    assert all(r.x for r in same)


def test_records_and_logs(spark):
    df = spark.createDataFrame([({"moveIndex": "1", "a": "x"}, {"thinkingText": "t", "moveIndex": "2"})], "d map<string,string>, m map<string,string>")
    d, t = doc.decision_record(F.col("d"), F.col("m"))
    r = df.select(d.alias("d"), t.alias("t")).first()
    assert r.d == {"moveIndex": "2", "a": "x"} and r.t == "t"
    logs = spark.createDataFrame([('{"enabled": false}',), ('{"enabled": true, "moves": [{"timestamp": 0.5, "move": "draw"}]}',)], "j string")
    assert [x.p.move_count for x in logs.select(doc.play_log(F.col("j")).alias("p")).collect()] == [None, 1]


def _unpacked(key):
    p = key.split(b"\0")
    return tuple(map(tuple, p[:7])), tuple(tuple(c | 1 for c in f) for f in p[7:11]), tuple(p[11]), tuple(p[12])


def test_packed_steps_are_the_children_with_their_scores():
    r = random.Random(3)
    for seed in (3, 17, 40):
        s = state(en.deal(seed))
        for _ in range(150):
            exp = [(m, -solver.badness(t), t) for m, t in solver.children(s)]
            assert [(m, v, _unpacked(k)) for m, v, k in solver.steps(solver.packed(s))] == exp
            if not exp:
                break
            s = r.choice(exp)[2]


def _direct_beam(b, depth, width):
    key = lambda b: (str(b["tab"]), str([[c[:2] for c in f] for f in b["fnd"]]), str(b["stock"]), str([c[:2] for c in b["waste"]]))
    queue, seen, n = [b], {key(b)}, 0
    for level in range(1, depth + 1):
        new = []
        for s in queue:
            for m in en.moves(s):
                t = en.apply(s, m)
                if t is None:
                    continue
                n += 1
                if all(len(f) == 13 for f in t["fnd"]):
                    return True, n, level
                if key(t) not in seen:
                    seen.add(key(t))
                    new.append(t)
        if len(new) > width:
            new = sorted(new, key=solver_score, reverse=True)[:width]
        if not (queue := new):
            break
    return False, n, None


def solver_score(b):
    return -solver.badness(state(b))


def test_beam_is_the_reference_search():
    for seed in (3, 17, 40):
        for depth, width in ((6, 5), (60, 12)):
            assert solver.beam(state(en.deal(seed)), depth, width) == _direct_beam(en.deal(seed), depth, width)


def test_beam_solve_runs_the_reference_job(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(plans.search, "beam", lambda boards, depth, width: asked.update(depth=depth, width=width))
    plans.beam_solve(spark, "/root/testdata/sf0.001")
    assert asked == {"depth": 100, "width": 1000}


def test_best_first_runs_the_reference_job(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(more.solver, "solve_boards", lambda boards, cap: asked.append(cap))
    more.best_first(spark, "/root/testdata/sf0.001")
    assert asked == [200_000]
    assert [solver.solve(state(en.deal(1)), n)[0] for n in (300, 200_000)] == ["UNKNOWN", "SOLVED"]


def test_tree_statistics_run_the_reference_job(spark, monkeypatch):
    for depth, most in ((2, 100), (10, 500)):
        g = boards(spark)
        a, b = (sorted(tuple(r[c] for c in ("game", "nodes", "deepest", "leaves", "winning")) for r in d.collect()) for d in (solver.tree_sizes(g, depth, most), solver.tree_statistics(solver.trees(g, depth, most))))
        assert a == b and a
    asked = {}
    monkeypatch.setattr(more.solver, "tree_sizes", lambda boards, depth, max_nodes: asked.update(depth=depth, max_nodes=max_nodes))
    more.tree_statistics(spark, "/root/testdata/sf0.001")
    assert asked == {"depth": 10, "max_nodes": 10_000}
