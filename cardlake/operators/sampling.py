"""Deterministic samples and splits in hash order. A hash of seed and key stands for a shuffled order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def uniform(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, all when there are fewer: a distributed top-n."""
    return df.withColumn("__h", hash_order(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def quota(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0, salts: int = 32) -> DataFrame:
    """At most ``n`` rows per stratum. Each stratum is cut to ``n`` in ``salts`` parts first, so a hot one is neither
    sorted nor held in one task."""
    d = df.withColumn("__h", hash_order(key, seed)).withColumn("__s", F.pmod(F.xxhash64(key), F.lit(salts)))
    part = F.row_number().over(W.partitionBy(stratum, "__s").orderBy("__h", key))
    d = d.withColumn("__k", part).filter(F.col("__k") <= n)
    return d.withColumn("__k", F.row_number().over(W.partitionBy(stratum).orderBy("__h", key))).filter(F.col("__k") <= n).drop("__h", "__s", "__k")


def split_groups(groups: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(key, split): whole groups, cut at floor(n * share) in hash order; the last split takes the rest.

    Positions are counted inside 4096 hash buckets plus the sizes of earlier buckets.
    """
    from .decisions import ordinal

    g = groups.select(key).withColumn("__h", hash_order(key, seed))
    n = g.count()
    o = ordinal(g, ["__h", key], F.substring("__h", 1, 3), "__k")
    names, upto, split = list(shares), 0, None
    for s in names[:-1]:
        upto += int(n * shares[s])
        split = F.when(F.col("__k") < upto, s) if split is None else split.when(F.col("__k") < upto, s)
    return o.select(key, (F.lit(names[-1]) if split is None else split.otherwise(names[-1])).alias("split"))


def valid_groups(groups: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """(key, split): whole groups; the first ``share`` of them in hash order, one at least, are valid, the others train."""
    from .decisions import ordinal

    n = max(1, int(groups.count() * share))
    g = groups.select(key, F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256).alias("__h"))
    o = ordinal(g, ["__h", key], F.substring("__h", 1, 3), "__k")
    return o.select(key, F.when(F.col("__k") < n, "valid").otherwise("train").alias("split"))
