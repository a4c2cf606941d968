"""Game sessions against the Python engine, and sessions as the state of a stream over several batches."""

import json
import random


import pytest
from pyspark.sql import functions as F

from cardlake.functions import board as bd
from cardlake.operators import gamesession as gs
from cardlake.operators import runs
from cardlake.operators import strategies as st
from tests import engine as en


def actions(b, d):
    out = [("draw", f"Draw {min(d, len(b['stock']))} card(s) from stock") if m[0] == "stock_to_waste" else ("move", m) for m in en.moves(b)]
    return out + ([("recycle", None)] if not b["stock"] and b["waste"] else [])


def act(b, a, d):
    if a[0] == "move":
        return en.apply(b, a[1])
    b = {**b, "tab": [list(p) for p in b["tab"]], "stock": list(b["stock"]), "waste": list(b["waste"]), "n": b["n"] + 1}
    if a[0] == "draw":
        for _ in range(min(d, len(b["stock"]))):
            c = b["stock"].pop()
            b["waste"].append((c[0], c[1], True))
    else:
        b["stock"], b["waste"] = [(c[0], c[1], False) for c in reversed(b["waste"])], []
    return b


@pytest.mark.parametrize("draw", [1, 3])
def test_played_by_index_as_the_engine_plays(spark, draw):
    r = random.Random(draw)
    games = []
    for seed in range(6):
        b, idx = en.deal(seed), []
        for _ in range(45):
            a = actions(b, draw)
            if not a:
                break
            i = r.randrange(len(a))
            idx.append(i)
            b = act(b, a[i], draw)
        games.append((seed, idx, b, len(actions(b, draw))))
    df = spark.createDataFrame([(s, i) for s, i, _, _ in games], "seed bigint, idx array<int>")
    df = df.select("seed", gs.play(gs.session(bd.deal(F.col("seed")), F.lit(draw)), F.col("idx")).alias("r"))
    got = {x.seed: x for x in df.select("seed", "r", F.size(gs.legal_actions(F.col("r.session.board"), F.lit(draw))).alias("n")).collect()}
    for seed, idx, b, n in games:
        assert en.of_row(got[seed].r.session.board) == b and got[seed].n == n
        assert [x.seq for x in got[seed].r.log] == list(range(1, len(idx) + 1)) and all(x.ok for x in got[seed].r.log)


def test_wrong_index_changes_nothing(spark):
    df = spark.range(1).select(gs.play(gs.session(bd.deal(F.col("id")), F.lit(1)), F.array(F.lit(99), F.lit(-2), F.lit(-1))).alias("r"))
    r = df.first().r
    assert [x.ok for x in r.log] == [False, False, True] and r.session.board.move_count == 1


def test_document(spark):
    b = bd.deal(F.col("id"))
    p = gs.play(gs.session(b, F.lit(3)), F.array(F.lit(-1)))
    doc = json.loads(spark.range(1).select("id", b.alias("b"), p.alias("p")).select(gs.session_document(F.col("id"), F.col("p.session"), F.col("p.log"), F.col("b"))).first()[0])
    assert doc["result"] == {"won": False, "stuck": False, "score": 0, "move_count": 1, "redeal_count": 0, "total_actions": 1}
    assert len(doc["initial_state"]["stock"]) == 24 and doc["actions"][0]["description"] == "Draw 3 card(s) from stock"


def test_stream_of_commands(spark, tmp_path):
    rows = [
        [("a", 1, "new_game", 5, 1, None), ("b", 2, "play_move", None, None, 0), ("a", 3, "new_game", 6, 1, None)],
        [("a", 4, "play_move", None, None, 0), ("a", 5, "play_move", None, None, 10**6), ("c", 6, "new_game", 7, 3, None)],
        [("a", 7, "end_session", None, None, None), ("a", 8, "play_move", None, None, 0), ("c", 9, "sing", None, None, None)],
    ]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, gs.COMMAND).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(gs.COMMAND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    state, events = gs.run_sessions(stream, str(tmp_path / "out"))
    got = {r.seq: (r.event, r.move_count) for r in events.collect()}
    assert got == {1: ("game_started", None), 2: ("error", None), 3: ("error", None), 4: ("move", 1), 5: ("error", None), 6: ("game_started", None), 7: ("game_abandoned", 1), 8: ("error", None), 9: ("error", None)}
    assert [(r.session_id, r.draw_count, r.move_count) for r in gs.list_sessions(state).collect()] == [("c", 3, 0)]


def test_registry_is_full(spark):
    c = spark.createDataFrame([(s, i, "new_game", i, 1, None) for i, s in enumerate("abc")], gs.COMMAND)
    none = spark.createDataFrame([], gs.STATE)
    got = gs.step_sessions(none, c, spark.createDataFrame([("a",), ("b",)], "session_id string")).select("session_id", F.explode("events").alias("e")).collect()
    assert {r.session_id: r.e.event for r in got} == {"a": "game_started", "b": "game_started", "c": "error"}


def test_suggestion(spark):
    df = spark.range(8).select("id", bd.deal(F.col("id")).alias("b")).select("id", gs.suggest(F.col("b")).alias("s"))
    prio = gs.STEP_PRIORITY
    for r in df.collect():
        m = en.moves(en.deal(r.id))
        assert r.s["index"] == max(range(len(m)), key=lambda i: (prio[m[i][0]], -i)) and r.s.reason == "Greedy strategy pick."


def test_weighted_strategy_as_computed_directly(spark):
    def score(b, m):
        w = st.WEIGHTS
        s = w[m[0]] + m[4]
        a = en.apply(b, m)
        if a is None:
            return s
        down = lambda x: sum(not c[2] for p in x["tab"] for c in p)
        cards = lambda x: sum(map(len, x["fnd"]))
        return s + (25 if down(a) < down(b) else 0) + 10 * (cards(a) - cards(b)) + 2 * len(en.moves(a))

    got = {r.game: (r.idx, r.score) for r in st.choose(spark.range(10).select(F.col("id").alias("game"), bd.deal(F.col("id")).alias("board")), "weighted").collect()}
    for seed in range(10):
        b = en.deal(seed)
        s = [score(b, m) for m in en.moves(b)]
        assert got[seed] == (s.index(max(s)), max(s))


def test_outcome_rules(spark):
    cases = [("won", 52, 0, 100, False, "WIN"), ("won", 52, 0, 251, False, "WIN_LONG"), ("parse_failure", 0, 99, 9, True, "PARSE_FAILURE"), ("engine_violation", 0, 99, 9, True, "ENGINE_VIOLATION"), ("max_turns", 50, 15, 9, True, "MIDGAME_STALL_DOOMLOOP"), ("illegal_move", 9, 0, 9, True, "MIDGAME_STALL_DOOMLOOP"), ("illegal_move", 9, 99, 9, False, "MOVE_INDEX_FIXATION"), ("max_turns", 45, 99, 9, False, "HIT_MAX_TURNS_NEAR_WIN"), ("max_turns", 30, 0, 9, True, "CLOSEOUT_FAIL"), ("max_turns", 10, 0, 9, False, "MIDGAME_STALL"), ("max_turns", None, None, None, False, "EARLY_FAIL"), ("stalled", 3, 0, 9, False, "STALLED_NO_LEGAL"), ("resigned", 3, 0, 9, False, "UNCLASSIFIED"), (None, None, None, None, False, "UNCLASSIFIED")]
    df = spark.createDataFrame(cases, "outcome string, final_foundation_cards int, plateau_at_end_turns int, turns_played int, swings boolean, want string")
    assert df.filter(runs.outcome_class(F.col("swings")) != F.col("want")).collect() == []


def test_gates_and_verdicts(spark):
    g = runs.gates(spark.createDataFrame([(2.0, 1), (None, 1), (3.0, 2)], "m double, x int"), {"m": (">=", 2), "x": ("<", 2)})
    assert [r.passed for r in g.collect()] == [True, False, False]
    good = [(c, True, 0, 0.8) for c in (True, False) for _ in range(4)]
    verdict = lambda rows: runs.guardrail(spark.createDataFrame(rows, "changed boolean, ok boolean, idx int, conf double"), "changed", F.lit(0)).first().verdict
    assert verdict(good) == "SHIP" and verdict([*good, (True, False, None, None)]) == "REVISE" and verdict([(c, o, 1 if c else 0, f) for c, o, _, f in good]) == "REVISE"
    assert verdict([(c, o, i, 0.7 if c else f) for c, o, i, f in good]) == "REVISE" and verdict([(c, o, i, None) for c, o, i, _ in good]) == "SHIP"
