"""Rules, moves, scores and search against a direct engine; pinned oddities of the rules."""

import random

from pyspark.sql import functions as F

from cardlake.functions import board as bd
from cardlake.operators import search
from cardlake.operators import strategies as st
from tests import engine as en

SEEDS = [3, 17, 20260, 111565622]


def boards(spark):
    return spark.createDataFrame([(s,) for s in SEEDS], "game bigint").select("game", bd.deal(F.col("game")).alias("board"))


def as_row(b):
    c = lambda p: [{"rank": x[0], "suit": x[1], "face_up": x[2]} for x in p]
    return {"tableau": [c(p) for p in b["tab"]], "foundations": [c(p) for p in b["fnd"]], "stock": c(b["stock"]), "waste": c(b["waste"]), "move_count": b["n"], "score": b["score"]}


def custom(spark, *bs):
    return spark.createDataFrame([(i, as_row(b)) for i, b in enumerate(bs)], f"game bigint, board {bd.BOARD}")


def blank(**k):
    return {"tab": [[] for _ in range(7)], "fnd": [[] for _ in range(4)], "stock": [], "waste": [], "n": 0, "score": 0, **k}


def full(upto=13):
    return [[(r, s, True) for r in range(1, upto + 1)] for s in en.SUITS]


def test_deal(spark):
    got = {r.game: en.of_row(r.board) for r in boards(spark).collect()}
    assert got == {s: en.deal(s) for s in SEEDS}
    b = got[3]
    assert len({c[:2] for p in b["tab"] + [b["stock"]] for c in p}) == 52


def test_random_walks_agree_move_by_move(spark):
    r = random.Random(5)
    states = []
    for s in SEEDS:
        b = en.deal(s)
        for _ in range(25):
            states.append(b)
            ms = en.moves(b)
            if not ms:
                break
            b = next(x for x in (en.apply(b, m) for m in r.sample(ms, len(ms))) if x)
    df = custom(spark, *states)
    kinds = ["move_type", "source_pile", "dest_pile", "num_cards", "score_delta"]
    rows = df.select("game", bd.legal_moves(F.col("board")).alias("m"), F.transform(bd.legal_moves(F.col("board")), lambda m: bd.apply_move(F.col("board"), m)).alias("after")).collect()
    assert len(rows) == len(states)
    for x in rows:
        exp = en.moves(states[x.game])
        assert [tuple(m[k] for k in kinds) for m in x.m] == exp
        assert [en.of_row(a) for a in x.after] == [en.apply(states[x.game], m) for m in exp]


def test_invalid_moves_give_null(spark):
    df = custom(spark, en.deal(3))
    bad = [("tableau_to_tableau", 0, 0, 1), ("tableau_to_tableau", 0, 1, 0), ("tableau_to_tableau", 9, 1, 1), ("waste_to_tableau", None, 0, 1), ("waste_to_foundation", None, 9, 1), ("nonsense", None, None, 1), ("flip_tableau_card", 0, None, 1)]
    m = lambda k, s, d, n: F.struct(F.lit(k).alias("move_type"), F.lit(s).cast("int").alias("source_pile"), F.lit(d).cast("int").alias("dest_pile"), F.lit(n).alias("num_cards"), F.lit(0).alias("score_delta"))
    r = df.select(*[bd.apply_move(F.col("board"), m(*b)).isNull().alias(f"b{i}") for i, b in enumerate(bad)]).first()
    assert all(r)


def test_flip_scores_and_run_order_is_not_checked(spark):
    b = blank()
    b["tab"][0] = [(5, "hearts", False)]
    b["tab"][1] = [(9, "clubs", True), (9, "clubs", True)]
    b["tab"][2] = [(10, "hearts", True)]
    df = custom(spark, b)
    flip = F.struct(F.lit("flip_tableau_card").alias("move_type"), F.lit(0).alias("source_pile"), F.lit(None).cast("int").alias("dest_pile"), F.lit(1).alias("num_cards"), F.lit(0).alias("score_delta"))
    r = df.select(bd.apply_move(F.col("board"), flip).alias("a"), bd.legal_moves(F.col("board")).alias("m")).first()
    assert r.a.score == 5 and r.a.tableau[0][0].face_up
    assert ("tableau_to_tableau", 1, 2, 2) in {(m.move_type, m.source_pile, m.dest_pile, m.num_cards) for m in r.m}


def test_scores(spark):
    won, start, empty = blank(fnd=full()), en.deal(17), blank()
    r = {x.game: x for x in custom(spark, won, start, empty).select("game", bd.progression(F.col("board")).alias("p"), bd.heuristic(F.col("board")).alias("h"), bd.is_won(F.col("board")).alias("w"), bd.sequence_score(F.col("board"), F.lit(3)).alias("s")).collect()}
    assert r[0].p == 1.0 and r[0].w and r[0].s == 10000.0
    assert abs(r[1].p - 0.2 * (1 - 21 / 28)) < 1e-12 and r[1].h == 70 - 120
    assert 0.3 <= r[2].p <= 0.5


def test_dead_ends(spark):
    king = blank(fnd=full(12))
    king["tab"][0] = [(13, "hearts", True)]
    blocked = blank(stock=[(2, "clubs", False)])
    blocked["tab"][0] = [(2, "hearts", False), (9, "clubs", True), (3, "spades", True)]
    r = {x.game: x.d for x in custom(spark, king, blocked, blank(), blank(fnd=full())).select("game", bd.dead_end(F.col("board")).alias("d")).collect()}
    assert r[0].is_dead_end and r[0].no_moves  # one winning move and no stock still counts as none
    assert r[1].has_blocking_cards and r[1].is_dead_end
    assert r[2].risk_score == 1.0
    assert not r[3].is_dead_end


def test_session_draw_and_recycle(spark):
    b = blank(stock=[(1, "clubs", False), (2, "clubs", False)])
    r = custom(spark, b).select(bd.session_draw(F.col("board"), F.lit(3)).alias("d"), bd.session_recycle(F.col("board")).alias("no")).first()
    assert [(c.rank, c.face_up) for c in r.d.waste] == [(2, True), (1, True)] and r.d.stock == [] and r.no is None
    back = custom(spark, en.of_row(r.d)).select(bd.session_recycle(F.col("board")).alias("b")).first().b
    assert [(c.rank, c.face_up) for c in back.stock] == [(1, False), (2, False)] and back.waste == []


def test_state_key_ignores_counters_and_sides_of_foundations(spark):
    a, b, c = blank(n=1, score=9), blank(), blank()
    b["waste"], a["waste"] = [(3, "clubs", True)], [(3, "clubs", False)]
    c["stock"] = [(3, "clubs", False)]
    k = [r[0] for r in custom(spark, a, b, c).orderBy("game").select(bd.state_key(F.col("board"))).collect()]
    assert k[0] == k[1] != k[2]


def test_beam_finds_the_last_moves_and_skips_a_won_board(spark):
    kings = blank(fnd=full(12))
    for i, s in enumerate(en.SUITS):
        kings["tab"][i] = [(13, s, True)]
    r = {x.game: x for x in search.beam(custom(spark, kings, blank(fnd=full())), depth=5, width=10).collect()}
    assert r[0].solved and r[0].length == 4 and r[0].level == 4 and r[0].explored > 4
    assert not r[1].solved


def test_best_sequences_and_replay(spark):
    g = boards(spark)
    best = search.best_sequences(g, depth=2, keep=1, with_path=True)
    rows = search.replay(g.join(best.select("game", F.col("path").alias("moves")), "game")).collect()
    assert rows and all(r.ok and r.applied == 2 for r in rows)
    drift = g.select("game", "board", F.array(F.lit(None).cast(bd.MOVE)).alias("moves"))
    assert not any(r.ok for r in search.replay(drift).collect())


def test_greedy_game_folds_first_moves(spark):
    exp = {}
    for s in SEEDS:
        b = en.deal(s)
        for _ in range(6):
            b = en.apply(b, en.moves(b)[0])
        exp[s] = b
    assert {r.game: en.of_row(r.board) for r in search.greedy_game(boards(spark), 6).collect()} == exp


def test_views(spark):
    r = boards(spark).filter("game = 3").select(bd.render(F.col("board")).alias("t"), bd.observation(F.col("board")).alias("o"), bd.observation(F.col("board"), "revealed", "revealed", "full").alias("all"), bd.observation(F.col("board"), stock="hidden").alias("h")).first()
    assert r.t.count("??") == 21 and r.t.endswith("STOCK: 24")
    assert "faceDown\":" not in r.o and "stockCount" in r.o and "stockCount" not in r.h and len(r.all) > len(r.o)


def test_strategies_by_name(spark):
    assert st.names() == ["llm", "lookahead", "simple", "weighted"]
    got = {r.game: r.move.move_type for r in st.choose(boards(spark), "SIMPLE").collect()}
    pr = st.PRIORITY
    for s in SEEDS:
        ms = en.moves(en.deal(s))
        assert got[s] == max(ms, key=lambda m: (pr[m[0]], -ms.index(m)))[0]
    st.register("Mine", st.simple)
    assert st.get("mine") is st.simple
    st.unregister("MINE")
    assert st.get("mine") is None
