"""Window operators over long sequences, split so that one hot key never sits in one task.

``chunk`` must not decrease along ``order`` within a key (e.g. ``turn div 4096``). Rows are sorted within (key, chunk)
only; what a chunk needs from earlier ones comes from a table with one row per chunk, reduced by a map-side aggregate
first. Key and chunk form one struct column, null-safe in itself, so window, aggregate and join share one partitioning
and the rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _parted(df: DataFrame, key: list[str], chunk: Column) -> DataFrame:
    return df.withColumn("__p", F.struct(F.struct(*key).alias("k"), chunk.alias("c")))


def _by_chunk(d: DataFrame, agg: Column, over: Column, rows: bool) -> DataFrame:
    """Per part, ``over`` the aggregates of the key's chunks in order; parts without any are left out."""
    w = W.partitionBy("__p.k").orderBy("__p.c")
    w = w.rowsBetween(W.unboundedPreceding, -1) if rows else w
    return d.groupBy("__p").agg(agg.alias("__part")).select("__p", over.over(w).alias("__before")).filter("__before IS NOT NULL")


def with_previous(df: DataFrame, key: list[str], order: list[str], chunk: Column, values: list[str], prefix: str = "prev_") -> DataFrame:
    """Adds the values of the preceding row of the same key; the first row of a chunk takes them from the last row of
    the key's preceding chunk."""
    d = _parted(df, key, chunk)
    here = F.struct(F.lit(True).alias("known"), *values)
    edges = _by_chunk(d, F.max_by(here, F.struct(*order)), F.lag("__part"), rows=False)
    d = d.withColumn("__lag", F.lag(here).over(W.partitionBy("__p").orderBy(*order)))
    prev = F.coalesce("__lag", "__before")
    return d.join(edges, "__p", "left").select(*df.columns, *[prev[v].alias(f"{prefix}{v}") for v in values])


def with_running_max(df: DataFrame, key: list[str], order: list[str], chunk: Column, value: Column, name: str) -> DataFrame:
    """Adds the largest ``value`` so far (rows of equal order included) within the key."""
    d = _parted(df.withColumn("__v", value), key, chunk)
    pre = _by_chunk(d, F.max("__v"), F.max("__part"), rows=True)
    d = d.withColumn("__m", F.max("__v").over(W.partitionBy("__p").orderBy(*order).rangeBetween(W.unboundedPreceding, 0)))
    return d.join(pre, "__p", "left").select(*df.columns, F.greatest("__m", "__before").alias(name))


def with_position(df: DataFrame, key: list[str], order: list[str], chunk: Column, name: str = "pos") -> DataFrame:
    """Adds the 0-based position within the key."""
    d = _parted(df, key, chunk)
    pre = _by_chunk(d, F.count("*"), F.sum("__part"), rows=True)
    d = d.withColumn("__n", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    return d.join(pre, "__p", "left").select(*df.columns, (F.col("__n") - 1 + F.coalesce("__before", F.lit(0))).cast("bigint").alias(name))
