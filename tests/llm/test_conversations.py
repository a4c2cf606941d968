"""Order, verdicts and reply links against direct loops."""

import math
import random
import re
from datetime import datetime

import pytest

from cardlake.llm import conversations as cv

SCHEMA = "messageId string, sessionId string, turnIndex int, timestamp bigint, role string, text string, receivedAt timestamp"
BASE = 1_772_000_000_000


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def talk(*messages, sid="s", numbered=True):
    return [(f"{sid}{i}", sid, i if numbered else None, BASE + i * 1000, role, text, datetime(2026, 1, 1)) for i, (role, text) in enumerate(messages)]


def broken(spark, rows):
    return {r.sessionId for r in cv.unusable_conversations(frame(spark, rows)).collect()}


GOOD = [("system", "be brief"), ("player", "what now?"), ("bot", "draw")]


@pytest.mark.parametrize(
    "messages,bad",
    [
        (GOOD, False),
        (GOOD[1:], False),
        ([*GOOD, ("user", "and then?")], True),
        ([*GOOD, ("USER ", "and?"), ("Assistant", " ​")], True),
        ([("assistant", "hello"), *GOOD[1:]], True),
        ([("system", "x")], True),
        ([("user", ""), ("assistant", "fine")], False),
        ([("user", " "), ("assistant", "﻿")], True),
        ([*GOOD, (None, "x")], True),
        ([*GOOD, ("?", "x")], True),
        ([*GOOD, ("assistant", "and one more")], False),
        ([("user", "a"), ("system", "note"), ("assistant", "b")], True),
    ],
)
def test_reasons(spark, messages, bad):
    assert broken(spark, talk(*messages)) == ({"s"} if bad else set())
    assert broken(spark, talk(*messages, numbered=False)) == ({"s"} if bad else set())


def test_numbers(spark):
    a = talk(*GOOD[1:], *GOOD[1:])
    hole = [r for r in a if r[2] != 1]
    assert broken(spark, hole) == {"s"}
    two = a + [("other", "s", 1, BASE + 1500, "assistant", "b", datetime(2026, 1, 1))]
    assert broken(spark, two) == {"s"}
    loose = [(*r[:2], None if r[2] == 1 else r[2], *r[3:]) for r in a]
    assert broken(spark, loose) == set()
    start = [(*r[:2], r[2] + 5, *r[3:]) for r in a]
    assert broken(spark, start) == set()
    seconds = [(*r[:3], r[3] // 1000, *r[4:]) for r in loose]
    assert broken(spark, seconds) == set()


def test_repeated_deliveries_count_once(spark):
    a = talk(*GOOD)
    assert broken(spark, a + [(*r[:6], datetime(2026, 2, 1)) for r in a]) == set()


def test_empty_and_blank_sessions(spark):
    assert broken(spark, []) == set()
    assert broken(spark, [(*r[:1], None, *r[2:]) for r in talk(("x", "y"))] + [(*r[:1], "", *r[2:]) for r in talk(("x", "y"))]) == set()


def test_order_of_loose_messages(spark):
    rows = talk(*GOOD)
    r = random.Random(0)
    mixed = [(*x[:2], None if r.random() < 0.5 else x[2], *x[3:]) for x in rows]
    o = cv.ordered_messages(cv.messages_once(frame(spark, r.sample(mixed, len(mixed)))))
    assert [x.messageId for x in o.orderBy("pos").collect()] == ["s0", "s1", "s2"]


def test_long_session_is_one_chain(spark, monkeypatch):
    monkeypatch.setattr(cv, "CHUNK", 16)
    rows = talk(*[("user" if i % 2 == 0 else "assistant", f"message {i}") for i in range(100)])
    t = cv.rebuilt_conversations(frame(spark, rows)).collect()
    assert len(t) == 100 and {x.tree for x in t} == {0}
    assert all(x.parent == (f"s{x.pos - 1}" if x.pos else None) for x in t)


def test_interleaved_channels(spark):
    a = [("user", "should the queen of hearts leave column four"), ("user", "explain recycling cost please"), ("assistant", "queen hearts column four should leave"), ("assistant", "recycling cost explain: one pass")]
    t = {x.messageId: x for x in cv.disentangled(frame(spark, talk(*a))).collect()}
    assert t["s2"].parent == "s0" and t["s3"].parent == "s1"


def test_extra_columns_may_clash(spark):
    df = frame(spark, talk(*GOOD)).selectExpr("*", "1 AS pos", "'x' AS anchor", "2 AS parent", "3 AS part")
    assert cv.unusable_conversations(df).count() == 0


def _direct_parents(rows, least):
    """Every earlier message as a candidate, scored one by one."""
    words = lambda t: {w for w in re.split(r"[^\w♥♦♣♠]+", t.lower()) if len(w) > 3}
    out, roles = {}, {"player": "user", "bot": "assistant"}
    for i, (mid, _, _, ms, role, text, _) in enumerate(rows):
        best = (0.0, -1)
        for j in range(i):
            _, _, _, ms2, role2, text2, _ = rows[j]
            w = words(text)
            s = math.exp(-abs(ms - ms2) / 120_000) + 2.0 * (len(w & words(text2)) / max(1, len(w))) + (1.0 if roles[role] != roles[role2] else 0.0) + (0.25 if i - j == 1 else 0.0)
            best = max(best, (s, j))
        out[mid] = rows[best[1]][0] if best[1] >= 0 and best[0] >= least else None
    return out


@pytest.mark.parametrize("chunk", [7, 4096])
def test_parents_from_any_distance(spark, monkeypatch, chunk):
    monkeypatch.setattr(cv, "CHUNK", chunk)
    r = random.Random(5)
    topics = [[f"topic{t}word{k}" for k in range(6)] for t in range(15)]
    asks = [("player", " ".join(t)) for t in topics]
    rows = talk(*asks, *[("bot", " ".join(r.sample(t, 5))) for t in r.sample(topics, 15)])
    got = {x.messageId: x.parent for x in cv.disentangled(frame(spark, rows)).collect()}
    assert got == _direct_parents(rows, 1.0)
    by = {x[0]: x for x in rows}
    answers = [m for m in got if by[m][4] == "bot"]
    assert all(set(by[m][5].split()) <= set(by[got[m]][5].split()) for m in answers)
    assert any(int(m[1:]) - int(got[m][1:]) > 8 for m in answers)


def test_links_decide_the_verdict(spark):
    """Ablation: the same messages under weights that do not know one channel link the answers elsewhere, and the
    conversation counts as unanswered."""
    a = [("user", "should the queen of hearts leave column four"), ("assistant", "recycling costs one pass"), ("user", "explain recycling cost please"), ("assistant", "queen hearts column four should leave")]
    df = frame(spark, talk(*a))
    verdict = lambda w: {r.sessionId for r in cv.conversation_verdicts(cv.threaded(df, w)).filter("broken").collect()}
    assert verdict(cv.SINGLE_CHANNEL) == set() and len(verdict(cv.INTERLEAVED)) == 1
    flat = {**cv.SINGLE_CHANNEL, "turn_taking": 0.0, "adjacent": 0.0}
    assert len(verdict(flat)) == 1


def test_no_weight_outweighs_the_others():
    w = cv.SINGLE_CHANNEL
    assert w["adjacent"] < sum(v for k, v in w.items() if k != "adjacent")
    assert w["adjacent"] + w["turn_taking"] > w["time"] + w["words"] + w["mention"] + w["turn_taking"]


def test_short_and_long_sessions_are_linked_alike():
    r = random.Random(3)
    words = [f"word{i}" for i in range(12)]
    for weights in (cv.SINGLE_CHANNEL, cv.INTERLEAVED):
        rows = [(i, r.choice(["user", "assistant", "system", None]), r.choice([None, BASE + r.randint(0, 10**6)]), r.sample(words, r.randint(0, 5)), r.sample(["7h", "8s"], r.randint(0, 2))) for i in range(60)]
        few = cv._best_of_few(rows, 0, weights)
        small, cv.SMALL = cv.SMALL, 0
        try:
            many = cv._best_before(rows, 0, weights)
        finally:
            cv.SMALL = small
        assert [(a, round(x, 9)) for a, x in few] == [(a, round(x, 9)) for a, x in many]


def test_second_message_of_a_speaker_goes_where_words_point(spark):
    a = [("user", "should the QH leave column four"), ("assistant", "yes"), ("user", "and then recycle"), ("assistant", "recycle then"), ("assistant", "leave column four with the QH, as said")]
    got = {x.messageId: x.parent for x in cv.threaded(frame(spark, talk(*a))).collect()}
    assert got["s3"] == "s2" and got["s4"] == "s0"
