"""Window operators over the turns of a session: stalls, plateaus, loops, recent moves, greedy samplings.

All take rows with a session, an order and plain value columns. Sessions are sorted by Spark's windows, which spill;
walks that depend on their own past read a session as a sorted stream and hold nothing of it but their state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def session_window(order: list[str], session: str = "sessionId"):
    return W.partitionBy(session).orderBy(*order)


def stalls(df: DataFrame, order: list[str], limit: int, session: str = "sessionId") -> DataFrame:
    """Adds flat (turns since foundation or hidden cards changed) and stalled.

    A row without parsed progress gets nulls, is never stalled and does not reset the run; the first parsed row of a
    session has flat 0.
    """
    w = session_window(order, session)
    ok = df.filter("fc IS NOT NULL AND fd IS NOT NULL")
    changed = F.coalesce((F.col("fc") != F.lag("fc").over(w)) | (F.col("fd") != F.lag("fd").over(w)), F.lit(True))
    ok = ok.withColumn("__c", changed.cast("int")).withColumn("__i", F.sum("__c").over(w))
    ok = ok.withColumn("flat", F.row_number().over(W.partitionBy(session, "__i").orderBy(*order)) - 1).drop("__c", "__i")
    ok = ok.withColumn("stalled", F.col("flat") >= limit)
    rest = df.filter("fc IS NULL OR fd IS NULL").withColumn("flat", F.lit(None).cast("int")).withColumn("stalled", F.lit(False))
    return ok.unionByName(rest)


def since_reset(df: DataFrame, order: list[str], reset: Column, name: str, session: str = "sessionId") -> DataFrame:
    """Adds the number of rows since the last row where ``reset`` held (0 there; counts from 1 before the first)."""
    w = session_window(order, session)
    d = df.withColumn("__r", F.coalesce(reset, F.lit(False)).cast("int")).withColumn("__i", F.sum("__r").over(w))
    n = F.row_number().over(W.partitionBy(session, "__i").orderBy(*order))
    return d.withColumn(name, n - F.when(F.col("__i") > 0, 1).otherwise(0)).drop("__r", "__i")


def repeats(df: DataFrame, order: list[str], signature: Column, name: str = "seen_before", session: str = "sessionId") -> DataFrame:
    """Adds how often the same position stood earlier in the session."""
    d = df.withColumn("__s", signature)
    return d.withColumn(name, F.row_number().over(W.partitionBy(session, "__s").orderBy(*order)) - 1).drop("__s")


def next_delta(df: DataFrame, order: list[str], columns: list[str], session: str = "sessionId") -> DataFrame:
    """Adds next minus current per column, nulls as 0 on both sides; the last row of a session has no pair."""
    w = session_window(order, session)
    d = df.withColumn("__n", F.lead(F.lit(1)).over(w))
    for c in columns:
        d = d.withColumn(f"d_{c}", F.lead(F.coalesce(c, F.lit(0))).over(w) - F.coalesce(c, F.lit(0)))
    return d.filter("__n IS NOT NULL").drop("__n")


def recent(df: DataFrame, order: list[str], value: str, n: int, name: str, session: str = "sessionId") -> DataFrame:
    """Adds the last ``n`` values before the row, oldest first."""
    return df.withColumn(name, F.collect_list(value).over(session_window(order, session).rowsBetween(-n, -1)))


def plateaus(df: DataFrame, order: list[str], value: str, least: int, session: str = "sessionId") -> DataFrame:
    """(session, value, start, end, length) of stretches of ``least`` turns or more with a constant value.

    An inner stretch is as long as the distance to the next stretch's start; the last one counts one turn more than
    the distance to its last row, as the reference figures do.
    """
    w = session_window(order, session)
    d = df.filter(F.col(value).isNotNull())
    d = d.withColumn("__c", F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True)).cast("int")).withColumn("__i", F.sum("__c").over(w))
    t = order[0]
    g = d.groupBy(session, "__i").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.first(value).alias(value))
    nxt = F.lead("start").over(W.partitionBy(session).orderBy("__i"))
    g = g.withColumn("length", F.coalesce(nxt - F.col("start"), F.col("end") - F.col("start") + 1))
    return g.filter(F.col("length") >= least).select(session, value, "start", "end", "length")


def loop_onset(df: DataFrame, order: list[str], value: str, session: str = "sessionId") -> DataFrame:
    """(session, onset): 0-based index at which the trailing constant stretch starts."""
    w = session_window(order, session)
    whole = W.partitionBy(session)
    d = df.filter(F.col(value).isNotNull()).withColumn("__x", F.row_number().over(w) - 1)
    d = d.withColumn("__last", F.max_by(value, "__x").over(whole))
    return d.groupBy(session).agg(F.coalesce(F.max(F.when(F.col(value) != F.col("__last"), F.col("__x"))) + 1, F.lit(0)).alias("onset"))


def oscillation(df: DataFrame, order: list[str], signature: str, last: int = 15, least_rows: int = 6, least_pairs: int = 4, session: str = "sessionId") -> DataFrame:
    """(session, pair, times): the most common order-free pair of neighbouring signatures in the last rows of a session
    (a row without a signature parts its neighbours), ties to the one seen first; only when it comes often enough."""
    w = session_window(order, session)
    down = W.partitionBy(session).orderBy(*[F.col(o).desc() for o in order])
    d = df.withColumn("__n", F.count("*").over(W.partitionBy(session))).withColumn("__r", F.row_number().over(down))
    d = d.filter((F.col("__n") >= least_rows) & (F.col("__r") <= last))
    d = d.withColumn("__next", F.lead(signature).over(w)).withColumn("__x", F.row_number().over(w))
    pair = F.concat_ws(" / ", F.least(signature, "__next"), F.greatest(signature, "__next"))
    p = d.filter(F.col(signature).isNotNull() & F.col("__next").isNotNull())
    p = p.groupBy(session, pair.alias("pair")).agg(F.count("*").alias("times"), F.min("__x").alias("__first"))
    best = p.groupBy(session).agg(F.min(F.struct((-F.col("times")).alias("n"), "__first", "pair")).alias("b"))
    return best.select(session, F.col("b.pair").alias("pair"), (-F.col("b.n")).alias("times")).filter(F.col("times") >= least_pairs)


def _walk(df: DataFrame, session: str, order: list[str], fields: list[str], out: str, make) -> DataFrame:
    """Rows chosen by a walk over each session in order. A session is read as a sorted stream (the sort spills), of which
    only the walk's own state is held: ``make()`` gives a function of one row's fields that yields the rows to give out."""
    d = df.select(session, *order, *[f for f in fields if f not in order])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step, found = None, None, []
        for pdf in batches:
            for key, *values in zip(pdf[session].tolist(), *(pdf[f].tolist() for f in fields)):
                if step is None or key != now:
                    if step is not None:
                        found += [(now, *x) for x in step(None)]
                    now, step = key, make()
                found += [(key, *x) for x in step(values)]
            if found:
                yield pd.DataFrame(found, columns=names)
                found = []
        if step is not None and (rest := [(now, *x) for x in step(None)]):
            yield pd.DataFrame(rest, columns=names)

    schema = f"{session} string, {out}"
    names = [x.split()[0] for x in schema.split(", ")]
    return d.repartition(session).sortWithinPartitions(session, *order).mapInPandas(run, schema)


def spaced(df: DataFrame, order: list[str], turn: str, gap: int, session: str = "sessionId") -> DataFrame:
    """Greedy choice per session: a row is taken when it is at least ``gap`` turns after the last one taken."""

    def make():
        last = None

        def step(row):
            nonlocal last
            if row is not None and (last is None or row[0] - last >= gap):
                last = row[0]
                yield (int(last),)

        return step

    return _walk(df, session, order, [turn], f"{turn} bigint", make)


def trajectory(df: DataFrame, order: list[str], turn: str, value: str, every: int, session: str = "sessionId") -> DataFrame:
    """(session, turn, value) at least ``every`` turns apart, from turn 0 on or the first one after, and the last row."""

    def make():
        last, end = -every, None

        def step(row):
            nonlocal last, end
            if row is None:
                if end is not None and end[0] != last:
                    yield end
                return
            end = (int(row[0]), int(row[1]))
            if end[0] - last >= every:
                last = end[0]
                yield end

        return step

    return _walk(df, session, order, [turn, value], f"{turn} bigint, {value} bigint", make)


def collapse_loops(df: DataFrame, order: list[str], key: str, turn: str, session: str = "sessionId") -> DataFrame:
    """Rows that remain when a walk jumps from each position to just after that position's last occurrence.

    A row without a key keeps itself and leads to the next row. The last occurrences come from one aggregate by key.
    """
    w = session_window(order, session)
    d = df.select(session, *order, *[c for c in (key, turn) if c not in order]).withColumn("__k", F.row_number().over(w))
    last = d.filter(F.col(key).isNotNull()).groupBy(session, key).agg(F.max("__k").alias("__last"))
    d = d.join(last, [session, key], "left").withColumn("__last", F.coalesce("__last", "__k"))

    def make():
        goal, free = None, True

        def step(row):
            nonlocal goal, free
            if row is None:
                return
            if free:
                goal, free = row[1], False
            if row[0] == goal:
                free = True
                yield (int(row[2]),)

        return step

    return _walk(d, session, ["__k"], ["__k", "__last", turn], f"{turn} bigint", make)


def seen_so_far(df: DataFrame, order: list[str], value: str, name: str, session: str = "sessionId") -> DataFrame:
    """Adds how many different values a session has shown up to each row: first occurrences, summed up."""
    first = F.when(F.col(value).isNotNull() & (F.row_number().over(W.partitionBy(session, value).orderBy(*order)) == 1), 1).otherwise(0)
    return df.withColumn("__f", first).withColumn(name, F.sum("__f").over(session_window(order, session))).drop("__f")


def within_budget(groups: DataFrame, group: str, size: str, target: int, order: Column) -> DataFrame:
    """Whole groups in the given order until their rows reach the target; the last one may overshoot."""
    h = order
    g = groups.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 3))
    sums = g.groupBy("__b").agg(F.sum(size).alias("__s"))
    before = sums.select("__b", (F.sum("__s").over(W.orderBy("__b")) - F.col("__s")).alias("__before"))  # 4096 hash buckets at most
    here = F.coalesce(F.sum(size).over(W.partitionBy("__b").orderBy("__h", group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("__here", here).join(before, "__b").filter(F.col("__before") + F.col("__here") < target).select(group, size)
