"""Sharded publishing, its ledger, and file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .decisions import ordinal

#: Folder of the ledger beside the shards; a leading underscore hides it from readers of the shards.
LEDGER = "_ledger"


def append_plan(published: DataFrame, incoming: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """(key, shard) of keys not published yet, numbered on from the published count, so an under-full tail is filled."""
    have = published.select(key).distinct()
    n = have.count()
    new = incoming.groupBy(key).agg(F.min(order).alias("__o")).join(have, key, "left_anti")
    o = ordinal(new, ["__o"], F.floor(F.col("__o") / 65536), "__k")
    return o.select(key, F.floor((F.col("__k") + n) / cap).alias("shard"))


def manifest(lines: DataFrame) -> DataFrame:
    """Per file: rows (not blank), usable (valid JSON), ids first seen in it by export time, distinct tiers and the
    content hash of its lines."""
    v = F.try_parse_json("body")
    x = lines.filter(F.trim("body") != "").select(F.col("fileName").alias("file"), "exportedAt", "body", v.isNotNull().alias("ok"), F.try_variant_get(v, "$.schemaTier", "string").alias("tier"), F.try_variant_get(v, "$.id", "string").alias("rid"))
    files = x.groupBy("file").agg(F.count("*").alias("rows"), F.count_if("ok").alias("usable"), F.count_distinct("tier").alias("tiers"), F.sum(F.xxhash64("body").cast("decimal(38,0)")).alias("content"))
    first = x.filter("rid IS NOT NULL").groupBy("rid").agg(F.min(F.struct("exportedAt", "file")).alias("f")).groupBy(F.col("f.file").alias("file")).agg(F.count("*").alias("new_ids"))
    return files.join(first, "file", "left").fillna(0, ["new_ids"])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    """(shard, rows) of what is published; empty where nothing is."""
    if not _exists(spark, f"{path}/{LEDGER}"):
        return spark.createDataFrame([], "shard bigint, rows bigint")
    return spark.read.parquet(f"{path}/{LEDGER}").groupBy("shard").agg(F.sum("rows").alias("rows"))


def publish(rows: DataFrame, path: str, key: str, order: list[str], bucket, cap: int = 2000, rebuild: bool = False) -> DataFrame:
    """Write rows not yet published as zstd Parquet shards and return the ledger (shard, rows).

    Keys in the directory already are left out by an anti-join, so a run that is repeated adds nothing; the schema of the
    first publication is kept (new fields are dropped); an under-full tail shard is filled first. With ``rebuild``, or when
    the ledger's first shard is missing, everything is packed anew. The ledger is a table beside the shards, on whatever
    file system these are; only the published number of rows comes to the driver.
    """
    spark = rows.sparkSession
    lost = _exists(spark, f"{path}/{LEDGER}") and not _exists(spark, f"{path}/shard=0")
    old = 0
    if not rebuild and not lost and _exists(spark, f"{path}/{LEDGER}"):
        had = spark.read.parquet(path)
        old = ledger_of(spark, path).agg(F.sum("rows")).first()[0] or 0
        rows = rows.select(*[c for c in rows.columns if c in had.columns]).join(had.select(key), key, "left_anti")
    o = cut(ordinal(rows, order, bucket, "__k").withColumn("shard", F.floor((F.col("__k") + old) / cap)).drop("__k"))
    mode = "append" if old else "overwrite"
    o.repartition("shard").write.mode(mode).partitionBy("shard").option("compression", "zstd").parquet(path)
    o.groupBy("shard").agg(F.count("*").alias("rows")).write.mode(mode).parquet(f"{path}/{LEDGER}")
    return ledger_of(spark, path)
