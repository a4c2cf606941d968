"""Prompts and answers: the forms of the log, hand-written, and what must come out of them."""

import json

import pytest
from pyspark.sql import functions as F

from cardlake.functions import prompts as pr

TEXT = """You are an expert. FOUNDATIONS, STOCK and TABLEAU are shown.

CURRENT GAME:
FOUNDATIONS:   H: AH   D: --   C: 3C   S: TS
STOCK: 12 cards   WASTE top: KD   recycle stock: no

TABLEAU:
  col1: ?? ?? 7H
  col2: <empty>
  col3: 9S 8D

RECENT MOVES (oldest -> newest; review before picking):
   1. draw 5C
   2. move 7H col 2 -> col 1
   3. 4D waste -> col 3

LEGAL MOVES (respond with the index of your chosen move):
  [0] tableau_to_tableau        Move 7H from column 1 to column 2 (reveals a hidden card)
  [1] draw_card                 Draw the next card from the stock onto the waste

PROGRESS: foundation=14/52, face-down remaining=2, completion=27%

Now choose the best move and reply with only the JSON object."""
BLOB = {"foundations": {"hearts": "4H", "spades": "", "clubs": None}, "tableau": [{"column": 1, "faceDownCount": 2, "faceUp": ["7H"]}, {"column": 2}], "legalMoves": [{"index": 0, "type": "draw_card", "describe": "Draw {x}"}], "recentMoves": ["move 7H col 1 -> col 2"], "metrics": {"completionProgress": 7}}
LEGACY = "Rules.\nCURRENT GAME (JSON):\n" + json.dumps(BLOB, indent=1) + "\nNow choose {one}."


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text,nested,flat",
    [
        ('{"final_decision": {"move_index": 3}}', 3, 3),
        ('{"move_index": 3} then {"note": "x"}', 3, 3),
        ('{"move_index": 1} {"move_index": 2}', 2, 2),
        ('{"move_index": 1, "final_decision": {"move_index": 2}}', 2, 1),
        ('{"move_index": "3"}', None, None),
        ('{"move_index": 3.5}', None, None),
        ('{"final_decision": 4, "move_index": 5}', 5, 5),
        ('[{"move_index": 6}]', 6, 6),
        ('{"a": {"b": {"move_index": 7}}}', None, None),
        ('{"move_index": ', None, None),
        ("none", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_move_index(spark, text, nested, flat):
    assert one(spark, text, pr.move_index) == nested
    assert one(spark, text, pr.move_index_flat_first) == flat


def test_decision_tiers(spark):
    t = lambda x: (lambda r: (r.idx, r.via, r.ok))(one(spark, x, pr.decision))
    assert t('{"board_analysis": "b", "final_decision": {"move_index": 2, "confidence": 0.4}}') == (2, "strict", True)
    assert t('{\n  "board_analysis": "a "(reveals a hidden card)" move",\n  "final_decision": {"move_index": 4}\n}') == (4, "repair", True)
    assert t('{"final_decision": {"move_index": -1}}') == (-1, "strict", True)
    assert t('"move_index": 1 or "move_index": -1, cut') == (-1, "field", True)
    assert t('{"move_index": 2}') == (2, "field", True)
    assert t("{'move_index': 2}") == (None, None, False)
    assert t(None) == (None, None, False)
    r = one(spark, '{"strategicPlan": "p", "final_decision": {"move_index": 1, "confidence": "high"}}', pr.decision)
    assert (r.strategic_plan, r.confidence) == ("p", None)


def test_fenced_and_evaluated(spark):
    assert one(spark, '```json\n{"move_index": "12"}\n```', pr.fenced_move_index) == 12
    assert one(spark, 'so {"final_decision": {"move_index": 3}} it is', pr.fenced_move_index) == 3
    assert one(spark, '{"move_index": 1} {"move_index": 2}', pr.fenced_move_index) is None
    full = '{"board_analysis": 1, "strategic_plan": 2, "final_decision": {"move_index": 3}}'
    assert tuple(one(spark, full, pr.evaluated)) == (3, True)
    assert tuple(one(spark, "Well: " + full + ".", pr.evaluated)) == (3, True)
    assert tuple(one(spark, '{"final_decision": {"move_index": 3}}', pr.evaluated)) == (3, False)
    assert tuple(one(spark, "no", pr.evaluated)) == (None, False)


def test_confidence_stands_beside_the_index(spark):
    assert tuple(one(spark, '{"confidence": 0.9, "final_decision": {"move_index": 3}}', pr.move_and_confidence)) == (3, None, True)
    assert tuple(one(spark, '{"confidence": 1, "move_index": 3}', pr.move_and_confidence)) == (3, 1.0, True)
    assert tuple(one(spark, "x", pr.move_and_confidence)) == (None, None, False)


def test_text_prompt(spark):
    g = one(spark, TEXT, pr.game)
    assert (g.foundations, [c.faceDownCount for c in g.tableau], g.completion) == ({"H": "AH", "C": "3C", "S": "TS"}, [2, 0, 0], 27)
    assert [(m.type, m.describe) for m in g.legalMoves] == [("tableau_to_tableau", "Move 7H from column 1 to column 2 (reveals a hidden card)"), ("draw_card", "Draw the next card from the stock onto the waste")]
    assert tuple(one(spark, TEXT, lambda x: pr.progress_components(pr.game(x)))) == (14, 2)
    s = one(spark, TEXT, pr.state)
    assert s.recent == ["draw 5C", "move 7H col 2 -> col 1", "4D waste -> col 3"] and len(s.legal) == 2
    assert [m.type for m in one(spark, TEXT, pr.listed_moves)] == ["tableau_to_tableau", "draw_card"]
    assert one(spark, TEXT, lambda x: pr.is_reversal(pr.state(x), F.lit(0))) is True
    assert one(spark, TEXT, lambda x: pr.is_reversal(pr.state(x), F.lit(1))) is False
    assert one(spark, TEXT, lambda x: pr.looks_like_oscillation(pr.state(x))) is True
    b = one(spark, TEXT, pr.board)
    assert (b.discardTop, b.drawPileCount, b.canRecycleStock, [c.faceUp for c in b.tableau]) == ("KD", 12, False, [["7H"], [], ["9S", "8D"]])


def test_json_prompt(spark):
    g = one(spark, LEGACY, pr.game)
    assert (g.completion, len(g.tableau), g.legalMoves[0].describe) == (7, 2, "Draw {x}")
    assert tuple(one(spark, LEGACY, lambda x: pr.progress_components(pr.game(x)))) == (4, 2)
    s = one(spark, LEGACY, pr.state)
    assert s.recent == ["move 7H col 1 -> col 2"] and s.legal[0].type == "draw_card"
    assert one(spark, LEGACY, pr.legal_move_count) == 1
    ten = LEGACY.replace("4H", "10H")
    assert tuple(one(spark, ten, lambda x: pr.progress_components(pr.game(x)))) == (None, 2)
    assert one(spark, LEGACY.replace('"4H"', '"4H'), pr.state) is None
    assert one(spark, "CURRENT GAME (JSON): {broken\n" + TEXT, lambda x: pr.game(x)["completion"]) == 27


def test_prompts_that_show_nothing(spark):
    for t in (None, "", "hello", "FOUNDATIONS: none", "CURRENT GAME (JSON): []"):
        assert one(spark, t, pr.state) is None and one(spark, t, pr.text_game) is None and one(spark, t, lambda x: pr.progress_components(pr.text_game(x))) is None
    assert one(spark, TEXT * 200, lambda x: pr.game(x)["completion"]) == 27


def test_keys_forget_history(spark):
    other = TEXT.replace("draw 5C", "draw 6C").replace("completion=27", "completion=28")
    moved = TEXT.replace("9S 8D", "9S")
    key = lambda t: one(spark, t, pr.board_key)
    assert key(TEXT) == key(other) != key(moved)
    h = lambda t: one(spark, t, pr.state_hash)
    assert len(h(TEXT)) == 12 and h(TEXT) == h(other) != h(TEXT.replace("[1] draw_card", "[1] draw_card  x"))


def test_arms(spark):
    p = "Expert.\nKLONDIKE SOLITAIRE RULES\nRESPONSE FORMAT:\nA. Produce the keys in the order above: b, then decide.\n" + LEGACY.replace('"metrics"', '"notation": "n", "reasoningTrail": ["a", "b"], "metrics"')
    arm = lambda a: one(spark, p, lambda x: pr.render_arm(a, x, "SHORT", "FIRST\n"))
    assert arm("C0") == p and "reasoningTrail" not in arm("A1") and "SHORT" in arm("A2") and "order above" not in arm("A2")
    assert "SHORT" in arm("A3") and "reasoningTrail" not in arm("A3")
    assert "FIRST\nKLONDIKE" in arm("A4") and '"notation"' not in arm("A4")
    with pytest.raises(ValueError):
        pr.render_arm("B", F.lit(""))
    with pytest.raises(Exception, match="RESPONSE FORMAT"):
        one(spark, "nothing", lambda x: pr.render_arm("A2", x, "S"))
