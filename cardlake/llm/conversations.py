"""Conversations from message rows: order, reply links, link trees, and which conversations are unusable."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, squeezed
from ..operators.sequence import with_position, with_previous, with_running_max
from ..session import cut
from .runs import millis

#: Role names of several clients, fixed values.
ROLES = {
    "system": ("system", "developer", "instruction"),
    "user": ("user", "human", "player", "customer"),
    "assistant": ("assistant", "bot", "model", "agent", "ai"),
}
#: Positions per chunk and milliseconds per time chunk: what one task sorts of a session at once.
CHUNK, SPAN = 4096, 86_400_000
#: Messages up to which a session's links are found without arrays; the result is the same.
SMALL = 128
#: Weights of a candidate link: nearness in time, shared words, mention of the parent's cards or columns, change of
#: speaker, and being the message directly before. In a session that is one channel an answer that stands directly
#: behind another speaker's message outweighs any other parent (adjacency and change of speaker 6.1, all else 6 at most);
#: a second message of the same speaker goes where time, words and mentions point.
SINGLE_CHANNEL = {"time": 0.5, "words": 1.5, "mention": 1.5, "turn_taking": 2.5, "adjacent": 3.6}
INTERLEAVED = {"time": 1.0, "words": 2.0, "mention": 1.5, "turn_taking": 1.0, "adjacent": 0.25}


def role_of(c: Column) -> Column:
    """system, user or assistant; null when the role cannot be told."""
    plain = F.lower(squeezed(c))
    out = None
    for role, names in ROLES.items():
        out = F.when(plain.isin(*names), role) if out is None else out.when(plain.isin(*names), role)
    return out


def messages_once(messages: DataFrame) -> DataFrame:
    """Each (sessionId, messageId) once, the earliest delivery; rows with a blank messageId are told apart by their
    content. Rows with a blank sessionId belong to no conversation. Columns: sessionId, messageId, turn, ms, role,
    text, has_text."""
    m = messages.filter(~is_blank(F.col("sessionId")))
    text = F.coalesce("text", F.lit(""))
    own = F.when(is_blank(F.col("messageId")), F.concat(F.lit("row:"), F.sha2(F.concat_ws("\u0001", F.col("turnIndex").cast("string"), F.col("timestamp").cast("string"), "role", text), 256)))
    m = m.select("sessionId", F.coalesce(own, "messageId").alias("messageId"), "receivedAt", F.struct(F.col("turnIndex").cast("bigint").alias("turn"), millis(F.col("timestamp")).alias("ms"), "role", text.alias("text")).alias("m"))
    first = m.groupBy("sessionId", "messageId").agg(F.min_by("m", F.struct(F.col("receivedAt").isNull(), "receivedAt", "m")).alias("m"))
    return first.select("sessionId", "messageId", "m.turn", "m.ms", role_of(F.col("m.role")).alias("role"), "m.text", (~is_blank(F.col("m.text"))).alias("has_text"))


def ordered_messages(once: DataFrame) -> DataFrame:
    """Adds ``anchor`` (own turn, or of the last numbered message up to its time) and ``pos``, 0-based in the session.

    Numbered messages stand in turn order; a message without turn follows the numbered message it was sent after.
    Ties: time, then messageId. Null times come first.
    """
    span = F.floor(F.coalesce("ms", F.lit(-1)) / SPAN)
    a = with_running_max(once.withColumn("__t", F.coalesce("ms", F.lit(-1))), ["sessionId"], ["__t"], span, F.col("turn"), "__seen")
    a = a.withColumn("anchor", F.coalesce("turn", "__seen")).withColumn("loose", F.col("turn").isNull())
    chunk = F.when(F.col("anchor").isNull(), F.struct(F.lit(0), F.floor(F.col("__t") / SPAN))).otherwise(F.struct(F.lit(1), F.floor(F.col("anchor") / CHUNK)))
    a = a.withColumn("__a", F.coalesce("anchor", F.lit(-(2**62))))
    p = with_position(a, ["sessionId"], ["__a", "loose", "__t", "messageId"], chunk, "pos")
    return p.select(*once.columns, "anchor", "pos")


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}♥♦♣♠]+"), lambda w: F.length(w) > 3))


def _marks(c: Column) -> Column:
    """Cards and columns that a text mentions. Cards in letters are written in capitals, so "as" and "the" are none."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9])(?:(?:10|[2-9ATJQKatjqk])[♥♦♣♠]|(?:10|[2-9ATJQK])[HDCS](?![A-Za-z0-9])|(?i:column|col) \d+)"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.translate(F.lower(x), "♥♦♣♠", "hdcs")))


def _best_of_few(rows: list[tuple], first: int, weights: dict[str, float]) -> list[tuple[int, float]]:
    """The same for a short session, without arrays."""
    near, wide, mark, turn = weights["time"], weights["words"], weights["mention"], weights["turn_taking"]
    at: dict[tuple, list[int]] = {}
    out = []
    for q, (_, who, ms, words, marks) in enumerate(rows):
        words, marks = () if words is None else words, () if marks is None else marks
        if q >= first:
            shared, mentioned = [0] * q, set()
            for w in words:
                for p in at.get((0, w), ()):
                    shared[p] += 1
            for w in marks:
                mentioned.update(at.get((1, w), ()))
            best, score = -1, 0.0
            k = max(1, len(words))
            for p in range(q):
                _, role, then, _, _ = rows[p]
                gap = 0.0 if ms is None or then is None or ms != ms or then != then else abs(ms - then)
                s = math.exp(-gap / 120_000.0) * near
                if shared[p]:
                    s += shared[p] / k * wide
                if p in mentioned:
                    s += mark
                if isinstance(who, str) and isinstance(role, str) and role != who and role != "system":
                    s += turn
                if p == q - 1:
                    s += weights["adjacent"]
                if s >= score:
                    best, score = p, s
            out.append((best, score))
        for w in words:
            at.setdefault((0, w), []).append(q)
        for w in marks:
            at.setdefault((1, w), []).append(q)
    return out


def _best_before(rows: list[tuple], first: int, weights: dict[str, float]) -> list[tuple[int, float]]:
    """(index, score) of the best earlier row for each row from ``first`` on; -1 where there is none. rows: (pos, role, ms,
    words, marks) of one session from its start, in order."""
    if len(rows) <= SMALL:
        return _best_of_few(rows, first, weights)
    n = len(rows)
    ms = np.array([np.nan if r[2] is None or r[2] != r[2] else r[2] for r in rows], dtype="float64")
    names = {r: i for i, r in enumerate(sorted({r[1] for r in rows if isinstance(r[1], str)}))}
    role = np.array([names.get(r[1], -1) for r in rows])
    may = (role >= 0) & (role != names.get("system", -1))
    at: dict[tuple, list[int]] = {}
    out = []
    for q, (_, who, _, words, marks) in enumerate(rows):
        words, marks = [] if words is None else list(words), [] if marks is None else list(marks)
        if q >= first and q:
            score = np.exp(-np.nan_to_num(np.abs(ms[q] - ms[:q]), nan=0.0) / 120_000.0) * weights["time"]
            shared = np.zeros(q)
            for w in words:
                if (p := at.get((0, w))) is not None:
                    shared[p] += 1
            score += shared / max(1, len(words)) * weights["words"]
            mention = np.zeros(q)
            for w in marks:
                if (p := at.get((1, w))) is not None:
                    mention[p] = weights["mention"]
            score += mention
            if isinstance(who, str):
                score += np.where(may[:q] & (role[:q] != role[q]), weights["turn_taking"], 0.0)
            score[q - 1] += weights["adjacent"]
            best = q - 1 - int(np.argmax(score[::-1]))
            out.append((best, float(score[best])))
        elif q >= first:
            out.append((-1, 0.0))
        for w in words:
            at.setdefault((0, w), []).append(q)
        for w in marks:
            at.setdefault((1, w), []).append(q)
    return out


def reply_links(ordered: DataFrame, weights: dict[str, float] = SINGLE_CHANNEL, least: float = 0.5) -> DataFrame:
    """Adds the likeliest parent of each message: parent, parent_pos, parent_role, link_score.

    Candidates are all messages before it in its session, however far back. A system message and a message without any
    candidate of at least ``least`` start a tree. Ties fall to the nearer message. A task finds the parents of one chunk of a session and holds times, roles, words and marks of the session up to there,
    not the texts; the work of a session grows with the square of its messages and is spread by chunk.
    """
    ordered = cut(ordered)  # read three times below
    at = F.floor(F.col("pos") / CHUNK)
    last = ordered.groupBy("sessionId").agg(F.max(at).alias("last"))
    rows = ordered.select("sessionId", "messageId", "pos", "role", F.col("ms").cast("bigint").alias("ms"), _tokens(F.col("text")).alias("words"), _marks(F.col("text")).alias("marks"))
    rows = rows.join(last, "sessionId").withColumn("part", F.explode(F.sequence(at, F.col("last")))).drop("last")
    chunk, w = CHUNK, dict(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(key: tuple, group: list[tuple]) -> pd.DataFrame:
            first = next(i for i, r in enumerate(group) if r[0] >= key[1] * chunk)
            links = _best_before([r[:5] for r in group], first, w)
            got = [(key[0], group[first + i][0], group[b][0], group[b][5], group[b][1], s) for i, (b, s) in enumerate(links) if b >= 0 and group[first + i][1] != "system" and s >= least]
            return pd.DataFrame(got, columns=["sessionId", "pos", "parent_pos", "parent", "parent_role", "link_score"])

        key, group, done, held = None, [], [], 0
        for pdf in batches:
            for sid, mid, pos, role, ms, words, marks, part in zip(*(pdf[c].tolist() for c in ("sessionId", "messageId", "pos", "role", "ms", "words", "marks", "part"))):
                if (sid, part) != key:
                    if group:
                        done.append(found(key, group))
                        held += len(done[-1])
                    if held > 5000:
                        yield pd.concat(done)
                        done, held = [], 0
                    key, group = (sid, part), []
                group.append((pos, role, ms, words, marks, mid))
        if group:
            done.append(found(key, group))
        if done:
            yield pd.concat(done)

    links = rows.repartition("sessionId", "part").sortWithinPartitions("sessionId", "part", "pos").select("sessionId", "messageId", "pos", "role", "ms", "words", "marks", "part")
    links = links.mapInPandas(run, "sessionId string, pos bigint, parent_pos bigint, parent string, parent_role string, link_score double")
    return ordered.join(links, ["sessionId", "pos"], "left").select(*ordered.columns, "parent", "parent_pos", "parent_role", "link_score")


def link_trees(linked: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Adds ``root_pos``, the position of the message that starts the tree, by pointer doubling (log of the depth)."""
    p = cut(linked.select("sessionId", "pos", F.coalesce("parent_pos", "pos").alias("up")))
    for _ in range(max_rounds):
        q = p.select("sessionId", F.col("pos").alias("up"), F.col("up").alias("upper"))
        p = cut(p.join(q, ["sessionId", "up"]).select("sessionId", "pos", F.col("upper").alias("new"), (F.col("upper") != F.col("up")).alias("moved")))
        moved = not p.filter("moved").isEmpty()
        p = p.select("sessionId", "pos", F.col("new").alias("up"))
        if not moved:
            break
    return linked.join(p.select("sessionId", "pos", F.col("up").alias("root_pos")), ["sessionId", "pos"])


def conversation_verdicts(linked: DataFrame) -> DataFrame:
    """Per session: messages and a boolean for each reason to drop it; ``broken`` when any holds.

    Follows from the reply links, checked against the positions: a user message is answered when an assistant message with
    a text is linked to it and stands directly behind it.
    """
    says = F.col("role").isin("user", "assistant") & F.col("has_text")
    rest = F.coalesce(F.col("role") != "system", F.lit(True))
    answers = (F.col("role") == "assistant") & F.col("has_text") & (F.col("parent_role") == "user") & (F.col("pos") - F.col("parent_pos") == 1)
    count = lambda c: F.count(F.when(c, 1))
    per = linked.groupBy("sessionId").agg(
        F.count("*").alias("messages"),
        (count(says) == 0).alias("nothing_said"),
        (count(F.col("role").isNull()) > 0).alias("unknown_role"),
        F.coalesce(F.min_by(F.when(rest, F.coalesce("role", F.lit("?"))), F.when(rest, F.col("pos"))) != "user", F.lit(True)).alias("wrong_start"),
        (count(F.col("role") == "user") > count(answers)).alias("unanswered"),
    )
    turns = linked.filter("anchor IS NOT NULL").groupBy("sessionId", "anchor").agg(F.count("turn").alias("numbered"), count(F.col("turn").isNull()).alias("loose"))
    turns = with_previous(turns, ["sessionId"], ["anchor"], F.floor(F.col("anchor") / CHUNK), ["anchor", "loose"])
    gap = F.coalesce(F.col("anchor") - F.col("prev_anchor") - 1 > F.col("prev_loose"), F.lit(False))
    holes = turns.groupBy("sessionId").agg((F.max("numbered") > 1).alias("same_turn"), F.max(gap).alias("missing_turn"))
    v = per.join(holes, "sessionId", "left").select(*per.columns, F.coalesce("same_turn", F.lit(False)).alias("same_turn"), F.coalesce("missing_turn", F.lit(False)).alias("missing_turn"))
    why = ["nothing_said", "unknown_role", "wrong_start", "unanswered", "same_turn", "missing_turn"]
    broken = F.col(why[0])
    for w in why[1:]:
        broken = broken | F.col(w)
    return v.withColumn("broken", broken)


def threaded(messages: DataFrame, weights: dict[str, float] = SINGLE_CHANNEL) -> DataFrame:
    """Messages once, in order, with reply links. Written to the checkpoint folder, as several results read it."""
    return cut(reply_links(ordered_messages(messages_once(messages)), weights))


def unusable_conversations(messages: DataFrame) -> DataFrame:
    """(sessionId) of the conversations to drop. An empty table gives an empty result."""
    return conversation_verdicts(threaded(messages)).filter("broken").select("sessionId")


def rebuilt_conversations(messages: DataFrame) -> DataFrame:
    """The usable conversations' messages in order: sessionId, pos, role, text, messageId, parent, tree (its root's
    position)."""
    t = threaded(messages)
    good = conversation_verdicts(t).filter("NOT broken").select("sessionId")
    return link_trees(t.join(good, "sessionId", "left_semi")).select("sessionId", "pos", "role", "text", "messageId", "parent", F.col("root_pos").alias("tree"))


def disentangled(messages: DataFrame, least: float = 1.0) -> DataFrame:
    """Sessions whose messages may belong to several interleaved exchanges: each message's likeliest parent and tree.

    (sessionId, messageId, pos, role, parent, link_score, tree); a message without a parent of at least ``least``
    starts a tree of its own.
    """
    t = cut(reply_links(ordered_messages(messages_once(messages)), INTERLEAVED, least))
    return link_trees(t).select("sessionId", "messageId", "pos", "role", "parent", "link_score", F.col("root_pos").alias("tree"))
