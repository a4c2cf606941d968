"""The playing harness against the Python engine and direct computation."""

import json
import random

from pyspark.sql import functions as F

from cardlake.functions import board as bd
from cardlake.operators import harness as hn
from cardlake.operators import reports
from cardlake.operators import turnwindows as tw
from tests import engine as en


def test_mersenne_deals(spark):
    got = {r.seed: en.of_row(r.board) for r in hn.mersenne_deals(spark.createDataFrame([(1,), (42,), (None,)], "seed bigint")).collect()}
    assert set(got) == {1, 42}
    for seed, b in got.items():
        deck = [(r, s, False) for s in en.SUITS for r in range(1, 14)]
        random.Random(seed).shuffle(deck)
        assert [c for p in b["tab"] for c in p] == [(c[0], c[1], k in {0, 2, 5, 9, 14, 20, 27}) for k, c in enumerate(deck[:28])] and b["stock"] == deck[28:]


def test_best_of_play_against_the_engine(spark):
    def heuristic(b):
        up = sum(c[2] for p in b["tab"] for c in p)
        return 100 * sum(map(len, b["fnd"])) + 10 * up + 20 * sum(not p for p in b["tab"]) - 2 * len(b["waste"]) - 5 * len(b["stock"])

    got = {r.game: r for r in hn.play_best_of(spark.range(6).select(F.col("id").alias("game"), bd.deal(F.col("id")).alias("board")), "exhaustive", 0, 12).collect()}
    for seed in range(6):
        b, n = en.deal(seed), 0
        for _ in range(12):
            m = en.moves(b)
            if not m:
                break
            after = [en.apply(b, x) for x in m]
            best = max(range(len(m)), key=lambda i: (float("-inf") if after[i] is None else heuristic(after[i]), -i))
            n += 1
            if after[best] is None:
                break
            b = after[best]
        assert (got[seed].turns_played, got[seed].foundation, got[seed].hidden) == (n, sum(map(len, b["fnd"])), sum(not c[2] for p in b["tab"] for c in p))


def test_proposers(spark):
    b = bd.deal(F.col("id"))
    r = spark.range(4).select(bd.legal_moves(b).alias("all"), hn.PROPOSERS["first_legal"](b, 3, F.lit(1)).alias("first"), hn.PROPOSERS["random_n"](b, 3, F.lit(1)).alias("random"), hn.PROPOSERS["exhaustive"](b, 3, F.lit(1)).alias("every")).collect()
    for x in r:
        assert x.first == x["all"][:1] and len(x.random) == 3 and all(m in x["all"] for m in x.random) and x.every == x["all"]


def test_deck_records(spark):
    card = "struct<rank:string,suit:string,faceUp:boolean>"
    df = spark.createDataFrame([(True, [[("A", "hearts", True)]] * 7, [("10", "spades", None)] * 23 + [("K", "clubs", None)]), (False, [[]] * 7, [("2", "spades", None)] * 24), (True, [[]] * 6, [("2", "spades", None)] * 24), (True, None, None)], f"won boolean, tableau array<array<{card}>>, drawPile array<{card}>")
    d = df.select(hn.deck_record(F.col("won"), F.struct("tableau", "drawPile"), F.lit(5)).alias("d")).select(F.when(F.col("d").isNotNull(), hn.deck_to_board(F.col("d"))).alias("b"))
    got = [r.b for r in d.collect()]
    assert got[1:] == [None, None, None]
    assert (got[0].stock[0].rank, got[0].stock[-1].rank, got[0].stock[0].face_up) == (13, 10, True)


def test_find_deck_fails_without_one(spark):
    import pytest

    decks = spark.createDataFrame([(1, "b"), (1, "a")], "seed bigint, source string")
    assert [r.deck.source for r in hn.find_deck(decks, spark.createDataFrame([(1,)], "seed bigint"), "seed", "source").collect()] == ["a"]
    with pytest.raises(Exception, match="no deck for seed 2"):
        hn.find_deck(decks, spark.createDataFrame([(2,)], "seed bigint"), "seed", "source").collect()


def test_report_document(spark):
    doc = json.loads(spark.range(1).select(hn.move_report(bd.deal(F.col("id")))).first()[0])
    assert doc["current_state"]["face_down_cards"] == 21 and len(doc["all_moves"]) == len(en.moves(en.deal(0)))


def test_cleaning():
    assert reports.cleaned({"a": None, "b": {"c": {}, "d": []}, "e": [None, {}, {"f": None}], "g": 0, "h": ""}) == {"e": [None, {}, {}], "g": 0, "h": ""}


def test_walks_against_direct_loops(spark):
    r = random.Random(6)
    rows = [(s, t, r.choice(["a", "b", "c", None]), r.randint(0, 9)) for s in ("x", "y", "z") for t in sorted(r.sample(range(300), 120))]
    df = spark.createDataFrame(rows, "sessionId string, turn int, key string, fc int")
    loops, gaps, paths = set(), set(), set()
    for s in ("x", "y", "z"):
        mine = [x for x in rows if x[0] == s]
        last = {k: i for i, (_, _, k, _) in enumerate(mine) if k is not None}
        i = 0
        while i < len(mine):
            j = last[mine[i][2]] if mine[i][2] is not None else i
            loops.add((s, mine[j][1]))
            i = j + 1
        at = None
        for _, t, _, _ in mine:
            if at is None or t - at >= 7:
                gaps.add((s, t))
                at = t
        at = -25
        for _, t, _, fc in mine:
            if t - at >= 25:
                paths.add((s, t, fc))
                at = t
        paths.add((s, mine[-1][1], mine[-1][3]))
    assert {(x.sessionId, x.turn) for x in tw.collapse_loops(df, ["turn"], "key", "turn").collect()} == loops
    assert {(x.sessionId, x.turn) for x in tw.spaced(df, ["turn"], "turn", 7).collect()} == gaps
    assert {(x.sessionId, x.turn, x.fc) for x in tw.trajectory(df, ["turn"], "turn", "fc", 25).collect()} == paths
    assert tw.collapse_loops(df.limit(0), ["turn"], "key", "turn").count() == 0


def test_strategy_sequences(spark):
    from cardlake.operators import strategies as st

    got = {r.game: r for r in st.sequence(spark.range(5).select(F.col("id").alias("game"), bd.deal(F.col("id")).alias("board")), "simple", 4).collect()}
    for seed in range(5):
        b, n = en.deal(seed), 0
        for _ in range(4):
            m = en.moves(b)
            if not m:
                break
            after = en.apply(b, max(m, key=lambda x: st.PRIORITY[x[0]]))
            if after is None:
                continue
            b, n = after, n + 1
        assert en.of_row(got[seed].board) == b and len(got[seed].moves) == n
