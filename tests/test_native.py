"""Searches in the JVM against the Python definitions of the same searches, board by board."""

import random

from pyspark.sql import functions as F

from cardlake.operators import search, solver
from tests import engine as en
from tests.test_boards import blank, custom, full
from tests.test_solver import state


def midgame(seed, moves):
    """A deal after some random moves."""
    r, b = random.Random(seed), en.deal(seed)
    for _ in range(moves):
        b = r.choice([t for m in en.moves(b) if (t := en.apply(b, m)) is not None] or [b])
    return b


def cases():
    won, last = blank(fnd=full(13)), blank(fnd=full(12))
    for i, s in enumerate(en.SUITS):
        last["tab"][i] = [(13, s, True)]
    return [blank(), won, last, *(midgame(seed, n) for seed in (1, 3, 17, 40, 95) for n in (0, 12, 45))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_beam_in_the_jvm_is_the_beam(spark):
    bs = cases()
    for depth, width in ((0, 5), (4, 1), (40, 60), (100, 400)):
        d = search.beam(custom(spark, *bs), depth, width)
        got = {r.game: (r.solved, r.explored, r.length, r.level) for r in d.collect()}
        exp = {i: (ok, n, level or 0, level) for i, b in enumerate(bs) for ok, n, level in [solver.beam(state(b), depth, width)]}
        assert got == exp
    assert got[2] == (True, got[2][1], 4, 4) and not got[1][0]
    assert "InPandas" not in plan(d)


def test_best_first_in_the_jvm_is_the_solver(spark):
    bs = cases()
    for cap in (0, 1, 700, 9_000):
        d = solver.solve_boards(custom(spark, *bs), cap)
        got = {r.game: (r.verdict, r.nodes, r.length) for r in d.collect()}
        exp = {i: (v, n, len(p)) for i, b in enumerate(bs) for v, n, p in [solver.solve(state(b), cap)]}
        assert got == exp
    assert {v[0] for v in got.values()} == {"SOLVED", "UNSOLVABLE", "UNKNOWN"}
    assert "InPandas" not in plan(d)


def test_a_search_runs_once_a_board_and_in_any_session(spark):
    other = spark.newSession()
    for s in (other, spark):
        d = solver.solve_boards(custom(s, en.deal(1)), 50)
        assert d.filter("verdict = 'UNKNOWN' AND nodes = 50").select((F.col("nodes") + F.length("verdict")).alias("n")).first().n == 57
    assert plan(d.filter("nodes = 50 AND length = 0")).count("cardlake_solve") == plan(d).count("cardlake_solve")
