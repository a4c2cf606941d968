"""Runs of identical or near-identical consecutive events, by optimal segmentation.

Within an entity a segmentation costs the dissimilarity of each event to its run's best representative plus a
penalty per run; pruned dynamic programming finds a cheapest one. A gap in the turn numbers always ends a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.actions import action_key
from ..functions.text import is_blank
from ..operators.dedup import deduplicate, message_ident
from ..session import cut

#: Turns per chunk. A chunk is what one Python call holds, however long the session.
CHUNK = 4096
#: Undecided events after which the settled runs of a stream are given out.
SETTLE = 512
#: With weights of 1 every difference costs 1; a change can be isolated with two more runs, so a penalty below a half
#: makes each maximal run of equal actions one optimal segment, and no other segmentation is as cheap.
EXACT_PENALTY = 0.25
#: Weights of kind, card, source and target of an action for runs of equal actions.
EXACT_WEIGHTS = (1.0, 1.0, 1.0, 1.0)


def dissimilarity(a: str, b: str, weights: tuple[float, ...] = EXACT_WEIGHTS) -> float:
    """Weighted share of differing parts of two ``:``-separated labels, 1 at most."""
    if a == b:
        return 0.0
    x, y = a.split(":"), b.split(":")
    n = max(len(x), len(y), len(weights))
    x, y = x + [""] * (n - len(x)), y + [""] * (n - len(y))
    w = [*weights, *[1.0] * n][:n]
    return min(1.0, sum(wi for wi, p, q in zip(w, x, y) if p != q))


class Cuts:
    """The dynamic program over a growing sequence: ``push`` takes the next labels, ``settled`` gives the segments that no
    later label can change, ``rest`` the others. Only live starts and undecided positions are held.

    Pruned exact linear time: a start that is no cheaper than the best total even without a penalty can never win again,
    because splitting a segment never raises its dissimilarity and a new start here costs as little. Within a run of
    equal events only its first one stays alive, so the work of a run grows with its length. Ties keep the earliest live
    start and the first-seen representative.
    """

    def __init__(self, penalty: float, weights: tuple[float, ...] = EXACT_WEIGHTS):
        self.penalty, self.weights = penalty, weights
        self.memo: dict[tuple[str, str], float] = {}
        self.base, self.total, self.back, self.rep = 0, [-penalty], [0], [""]
        self.live: list[tuple[int, dict[str, int], dict[str, float]]] = []

    def _d(self, a: str, b: str) -> float:
        k = (a, b)
        if k not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[k] = self.memo[(b, a)] = dissimilarity(a, b, self.weights)
        return self.memo[k]

    def push(self, x: str, w: int) -> None:
        t, d, penalty = self.base + len(self.total) - 1, self._d, self.penalty
        self.live.append((t, {}, {}))
        best, at, who = float("inf"), t, x
        costs = []
        for s, have, cost in self.live:
            for r in cost:
                cost[r] += w * d(x, r)
            if x not in cost:
                cost[x] = sum(n * d(y, x) for y, n in have.items())
            have[x] = have.get(x, 0) + w
            r = min(cost, key=cost.get)
            c = self.total[s - self.base] + cost[r]
            costs.append(c)
            if c + penalty < best - 1e-12:
                best, at, who = c + penalty, s, r
        self.total.append(best)
        self.back.append(at)
        self.rep.append(who)
        self.live = [x for x, c in zip(self.live, costs) if c < best - 1e-12]

    def _chain(self, t: int) -> list[tuple[int, int, str]]:
        out = []
        while t > self.base:
            out.append((self.back[t - self.base], t, self.rep[t - self.base]))
            t = out[-1][0]
        return out[::-1]

    def settled(self) -> list[tuple[int, int, str]]:
        """Every later segmentation goes through a live start or the end; all are one up to where their ways meet."""
        ways = {s for s, _, _ in self.live} | {self.base + len(self.total) - 1}
        while len(ways) > 1:
            t = max(ways)
            ways.remove(t)
            ways.add(self.back[t - self.base])
        out, k = self._chain(t := ways.pop()), t - self.base
        # totals are only compared with each other, so they can start anew at the meeting point
        low = self.total[k] + self.penalty
        self.base, self.total, self.back, self.rep = t, [x - low for x in self.total[k:]], self.back[k:], self.rep[k:]
        return out

    def rest(self) -> list[tuple[int, int, str]]:
        return self._chain(self.base + len(self.total) - 1)


def segments(labels: list[str], counts: list[int], penalty: float, weights: tuple[float, ...] = EXACT_WEIGHTS) -> list[tuple[int, int, str]]:
    """Cheapest segmentation of ``labels`` (each standing for ``counts`` equal events): (start, end, representative)."""
    c = Cuts(penalty, weights)
    for x, w in zip(labels, counts):
        c.push(x, w)
    return c.rest()


class _Stretch:
    """Segments of one entity or chunk, whose (turn, time, label) come in order. Every event goes into the program."""

    def __init__(self, key: str, penalty: float, weights: tuple[float, ...], out: list[tuple]):
        self.key, self.penalty, self.weights, self.out = key, penalty, weights, out
        self.cuts, self.events = Cuts(penalty, weights), []

    def _emit(self, found: list[tuple[int, int, str]], base: int) -> None:
        for a, b, r in found:
            part = self.events[a - base : b - base]
            times = [t for _, t in part if t is not None]
            self.out.append((self.key, part[0][0], part[-1][0], len(part), r, min(times, default=None), max(times, default=None)))
        if found:
            del self.events[: found[-1][1] - base]

    def close(self) -> None:
        self._emit(self.cuts.rest(), self.cuts.base)
        self.cuts = Cuts(self.penalty, self.weights)

    def add(self, turn: int, time: int | None, label: str) -> None:
        if self.events and turn - self.events[-1][0] > 1:
            self.close()
        self.events.append((turn, time))
        self.cuts.push(label, 1)
        if len(self.events) % SETTLE == 0:
            base = self.cuts.base
            self._emit(self.cuts.settled(), base)


_COLUMNS = ["entity", "firstTurn", "lastTurn", "events", "label", "t0", "t1"]
_SCHEMA = "entity string, firstTurn bigint, lastTurn bigint, events bigint, label string, t0 bigint, t1 bigint"


def _segmenter(penalty: float, weights: tuple[float, ...], chunk: int | None):
    """Segments chunk by chunk, or with no ``chunk`` over a whole entity, whose rows are read as a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, out = None, None, []
        for pdf in batches:
            for e, turn, time, label in zip(pdf["entity"].tolist(), pdf["turn"].tolist(), pdf["time"].tolist(), pdf["label"].tolist()):
                if (k := (e, turn // chunk if chunk else 0)) != key:
                    if now is not None:
                        now.close()
                    key, now = k, _Stretch(e, penalty, weights, out)
                now.add(turn, None if time != time or time is None else int(time), label)
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS).astype({"t0": "Int64", "t1": "Int64"})
                out.clear()
        if now is not None:
            now.close()
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"t0": "Int64", "t1": "Int64"})

    return run


def collapse_runs(events: DataFrame, penalty: float = EXACT_PENALTY, weights: tuple[float, ...] = EXACT_WEIGHTS, chunk: int = CHUNK) -> DataFrame:
    """One row per run: entity, firstTurn, lastTurn, events, label (the representative) and duration_ms.

    ``events`` has entity, turn, time (ms, may be null) and label; rows with a null entity, turn or label are left
    out, so an event without a label leaves a gap that ends the run. Several events of one turn count as consecutive.
    An empty table gives an empty result.

    Where the penalty is below half of the least difference, the runs are those of equal labels: sessions are split into
    chunks of ``chunk`` turns, and runs that touch a chunk's edge with equal labels and consecutive turns are joined again.
    With graded weights a cut can depend on labels far away, so a session is one sorted stream (the sort spills) that carries
    the live starts and undecided turns along; it need not fit into memory, but it is one task.
    """
    rows = events.select(F.col("entity").cast("string").alias("entity"), F.col("turn").cast("bigint").alias("turn"), F.col("time").cast("bigint").alias("time"), F.col("label").cast("string").alias("label"))
    rows = rows.filter("entity IS NOT NULL AND turn IS NOT NULL AND label IS NOT NULL")
    if penalty * 2 >= min(1.0, *weights):
        seg = rows.repartition("entity").sortWithinPartitions("entity", "turn", "time", "label").mapInPandas(_segmenter(penalty, tuple(weights), None), _SCHEMA)
        return seg.select("entity", "firstTurn", "lastTurn", "events", "label", (F.col("t1") - F.col("t0")).alias("duration_ms"))
    part = F.floor(F.col("turn") / chunk)
    seg = rows.repartition(F.col("entity"), part).sortWithinPartitions("entity", "turn", "time", "label").mapInPandas(_segmenter(penalty, tuple(weights), chunk), _SCHEMA)
    edge = ((F.col("firstTurn") != 0) & (F.pmod("firstTurn", F.lit(chunk)) == 0)) | (F.pmod("lastTurn", F.lit(chunk)) == chunk - 1)
    w = W.partitionBy("entity").orderBy("firstTurn", "lastTurn")
    # only segments at an edge (two a chunk at most) are compared with each other; all others stay as they are. Both
    # branches read the written segments, so the program runs once
    seg = cut(seg.withColumn("edge", edge))
    joined = seg.filter("edge").withColumn("new", F.when((F.lag("label").over(w) == F.col("label")) & (F.col("firstTurn") - F.lag("lastTurn").over(w) == 1), 0).otherwise(1))
    joined = joined.withColumn("island", F.sum("new").over(w)).groupBy("entity", "island").agg(
        F.min("firstTurn").alias("firstTurn"), F.max("lastTurn").alias("lastTurn"), F.sum("events").alias("events"), F.first("label").alias("label"), F.min("t0").alias("t0"), F.max("t1").alias("t1")
    )
    all_runs = seg.filter("NOT edge").select(*_COLUMNS).unionByName(joined.select(*_COLUMNS))
    return all_runs.select("entity", "firstTurn", "lastTurn", "events", "label", (F.col("t1") - F.col("t0")).alias("duration_ms"))


def millis(c: Column) -> Column:
    """Epoch times given in seconds or milliseconds as milliseconds."""
    return F.when(F.abs(c) < 100_000_000_000, c * 1000).otherwise(c)


def decision_events(decisions: DataFrame) -> DataFrame:
    """Events of decision rows, further deliveries removed: entity, turn, time and the action's label.

    A decision that is no JSON object, or whose chosenDescribe is missing or blank, has no label.
    """
    named = F.try_variant_get(F.try_parse_json("decision"), "$.chosenDescribe", "string")
    d = decisions.select("rowId", "sessionId", "id", "turnIndex", millis(F.col("timestamp")).alias("time"), action_key(named).alias("label"))
    d = deduplicate(d, message_ident(), "rowId", "rowId")
    return d.filter(F.col("turnIndex").isNotNull() & ~is_blank(F.col("sessionId"))).select(F.col("sessionId").alias("entity"), F.col("turnIndex").alias("turn"), "time", "label")
