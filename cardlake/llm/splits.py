"""Splits that keep related records together: random-mate contraction, then a cut of cumulative weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import cut, written

#: Hash buckets of the cumulative weight: a fixed number, so their totals are a table of bounded size.
BUCKETS = 4096


def components(edges: DataFrame, seed: int = 0, max_rounds: int = 400) -> DataFrame:
    """(vertex, component) of every vertex with an edge; component is the smallest vertex of its component.

    ``edges`` has bigint columns u and v; loops, repeated edges and nulls are ignored. Each round tosses a coin per
    vertex; a tails vertex with heads neighbours collapses into the smallest of them. Edges are renamed, loops and
    repeats vanish, and the round's map is kept until the labels are unwound. Every round works on what is left.
    """
    e = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = written(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    spark, maps, r = edges.sparkSession, [], 0
    while not e.isEmpty():
        if r >= max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        heads = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed), F.lit(r)), F.lit(2)) == 1  # noqa: B023, E731
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = written(both.filter(~heads("u") & heads("v")).groupBy(F.col("u").alias("from")).agg(F.min("v").alias("to")), "round")
        maps.append(step)
        a = e.join(step.select(F.col("from").alias("u"), F.col("to").alias("tu")), "u", "left")
        a = a.select(F.coalesce("tu", "u").alias("u"), "v")
        b = a.join(step.select(F.col("from").alias("v"), F.col("to").alias("tv")), "v", "left").select("u", F.coalesce("tv", "v").alias("v"))
        e = written(b.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        r += 1
    # unwind: the last round's roots are final; each earlier round looks its targets up in what is unwound already.
    # Every part is written once, so the plan of a round never holds the plans of the rounds before it.
    label = spark.createDataFrame([], "vertex bigint, root bigint")
    for step in reversed(maps):
        later = label.select(F.col("vertex").alias("to"), F.col("root"))
        here = step.join(later, "to", "left").select(F.col("from").alias("vertex"), F.coalesce("root", "to").alias("root"))
        label = label.unionByName(written(here, "labels"))
    every = label.unionByName(label.select(F.col("root").alias("vertex"), "root").distinct())
    least = every.groupBy("root").agg(F.min("vertex").alias("component"))
    return every.join(least, "root").select("vertex", "component")


def session_groups(decisions: DataFrame, seed: int = 0) -> DataFrame:
    """(sessionId, groupSeed, rows) of every session with a seed.

    Sessions are related through common seeds, directly or through other sessions; groupSeed is the smallest seed of
    the group. Seeds null or 0 and a blank sessionId relate nothing. An empty table gives an empty result.
    """
    pairs = decisions.select("sessionId", "seed").filter(F.col("seed").isNotNull() & (F.col("seed") != 0) & ~is_blank(F.col("sessionId")))
    pairs = cut(pairs.groupBy("sessionId", "seed").agg(F.count("*").alias("rows")))
    per = pairs.groupBy("sessionId").agg(F.min("seed").alias("first"), F.max("seed").alias("last"), F.sum("rows").alias("rows"))
    several = per.filter("first < last").select("sessionId", "first")
    edges = pairs.join(several, "sessionId").filter("seed <> first").select(F.col("first").alias("u"), F.col("seed").alias("v"))
    comp = components(edges, seed)
    out = per.join(comp.select(F.col("vertex").alias("first"), "component"), "first", "left")
    return out.select("sessionId", F.coalesce("component", "first").alias("groupSeed"), "rows")


def bound_sessions(decisions: DataFrame) -> DataFrame:
    """(sessionId, groupSeed) of the sessions that share their split with at least one other session."""
    g = cut(session_groups(decisions).select("sessionId", "groupSeed"))
    several = g.groupBy("groupSeed").agg(F.count("*").alias("n")).filter("n > 1").select("groupSeed")
    return g.join(several, "groupSeed", "left_semi").select("sessionId", "groupSeed")


def split_groups(groups: DataFrame, group: str, weight: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(group, weight, split): whole groups cut at the cumulative weight shares.

    Groups come in hash order, groups heavier than the smallest share first, so a giant lands in the first split.
    A group belongs to the split that holds its middle. Cumulative sums are taken inside hash buckets; only the bucket
    totals (``BUCKETS`` rows at most twice) meet in one task.
    """
    total_share = sum(shares.values())
    g = groups.groupBy(F.col(group).alias("g")).agg(F.sum(weight).cast("double").alias("w"))
    total = g.agg(F.sum("w")).first()[0] or 0.0  # one number
    least = min(shares.values()) / total_share
    h = F.xxhash64("g", F.lit(seed))
    g = g.select("g", "w", h.alias("h"), (F.when(F.col("w") > total * least, 0).otherwise(1) * BUCKETS + F.pmod(h, F.lit(BUCKETS))).alias("bucket"))
    sums = g.groupBy("bucket").agg(F.sum("w").alias("s"))
    before = sums.select("bucket", (F.sum("s").over(W.orderBy("bucket")) - F.col("s")).alias("before"))
    at = g.join(F.broadcast(before), "bucket")  # at most 2 * BUCKETS rows
    mid = (F.col("before") + F.sum("w").over(W.partitionBy("bucket").orderBy("h", "g").rowsBetween(W.unboundedPreceding, 0)) - F.col("w") / 2) / F.lit(total)
    split, upto = None, 0.0
    names = list(shares)
    for n in names[:-1]:
        upto += shares[n] / total_share
        split = F.when(mid < upto, n) if split is None else split.when(mid < upto, n)
    split = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return at.select(F.col("g").alias(group), F.col("w").alias(weight), split.alias("split"))


def assign_splits(decisions: DataFrame, shares: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """(sessionId, groupSeed, split) of every session; a session without a seed is a group of its own (groupSeed null).

    Blank sessionIds are no session and get no split. A session's weight is its number of rows.
    """
    shares = shares or {"train": 0.8, "valid": 0.1, "test": 0.1}
    named = decisions.select("sessionId", "seed").filter(~is_blank(F.col("sessionId")))
    size = named.groupBy("sessionId").agg(F.count("*").alias("rows"))
    g = size.join(session_groups(decisions, seed).select("sessionId", "groupSeed"), "sessionId", "left")
    g = cut(g.withColumn("grp", F.coalesce(F.concat(F.lit("g"), F.col("groupSeed").cast("string")), F.concat(F.lit("s"), F.col("sessionId")))))
    s = split_groups(g, "grp", "rows", shares, seed).select("grp", "split")
    return g.join(s, "grp").select("sessionId", "groupSeed", "rows", "split")
