"""Harvested decisions: parsing of the open JSON columns, schema tiers, selection reasons, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Shape of a harvested prompt; unknown keys are ignored, missing ones are null.
PROMPT = (
    "instruction string, legalMoves array<struct<index:int,kind:string,description:string>>, "
    "observation struct<foundations:struct<H:int,D:int,C:int,S:int>, tableau:array<struct<faceDownCount:int,faceUp:string>>, waste:string, stock:int>"
)
#: Face-down cards of a fresh deal and cards of a deck.
HIDDEN, DECK = 21, 52


def foundation_cards(board: Column) -> Column:
    """Cards on the foundations; null when any of the four is missing."""
    f = board["foundations"]
    return f["H"] + f["D"] + f["C"] + f["S"]


def hidden_cards(board: Column) -> Column:
    return F.when(board["tableau"].isNotNull(), F.aggregate(board["tableau"], F.lit(0), lambda a, c: a + F.coalesce(c["faceDownCount"], F.lit(0))))


def progress_score(found: Column, hidden: Column) -> Column:
    """0..100: 65 % foundation share, 35 % revealed share. Unrounded; null if either is null."""
    return (F.lit(0.65) * found / DECK + F.lit(0.35) * (HIDDEN - hidden) / HIDDEN) * 100


def turns(decisions: DataFrame) -> DataFrame:
    """Narrow per-decision rows with the board's progress parsed from the prompt.

    Broken JSON gives nulls, never a failure. moveIndex and confidence come from the decision whatever type they have.
    """
    board = F.col("p.observation")
    v = F.try_parse_json("decision")
    d = decisions.select("*", F.from_json("prompt", PROMPT).alias("p"), v.alias("v"))
    return d.select(
        "rowId",
        "id",
        "sessionId",
        F.col("turnIndex").alias("turn"),
        F.col("timestamp").alias("ts"),
        "outcome",
        "model",
        "agentId",
        "seed",
        "schemaTier",
        "appCommit",
        "drawCount",
        foundation_cards(board).alias("fc"),
        hidden_cards(board).alias("fd"),
        board["stock"].alias("stock"),
        F.size(F.col("p.legalMoves")).alias("legal"),
        F.try_variant_get("v", "$.moveIndex", "int").alias("moveIndex"),
        F.try_variant_get("v", "$.chosenKind", "string").alias("kind"),
        F.try_variant_get("v", "$.chosenDescribe", "string").alias("chosen"),
        F.get(F.col("p.legalMoves"), F.when(F.try_variant_get("v", "$.moveIndex", "int") >= 0, F.try_variant_get("v", "$.moveIndex", "int"))).alias("listed"),
    )


def schema_tier() -> Column:
    """current iff id, sessionId, turnIndex and appCommit are all present (turn 0 counts as present), else legacy."""
    full = F.lit(True)
    for c in ("id", "sessionId", "appCommit"):
        full = full & F.coalesce(F.col(c) != "", F.lit(False))
    return F.when(full & F.col("turnIndex").isNotNull(), "current").otherwise("legacy")


def exclude_reasons(tier: Column, model: Column, teacher: str, stalled: Column) -> Column:
    """Ordered list of reasons against a row; empty when it may be used."""
    return F.array_compact(
        F.array(
            F.when(tier != "current", F.lit("legacy-schema")),
            F.when(F.coalesce(model, F.lit("")) != teacher, F.concat(F.lit("non-teacher-model:"), F.coalesce(model, F.lit("(unknown)")))),
            F.when(F.coalesce(stalled, F.lit(False)), F.lit("stalled-game")),
        )
    )


def confidence_number(v: Column) -> Column:
    """Confidence of a decision variant where it is a JSON number; texts are none."""
    kind = F.schema_of_variant(F.try_variant_get(v, "$.confidence", "variant"))
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$.confidence", "double"))


def game_key() -> Column:
    """First of seed and sessionId that is present, else a key of the row's own; 0 and '' count as missing."""
    return F.coalesce(F.when(F.col("seed") != 0, F.concat(F.lit("seed:"), F.col("seed").cast("string"))), F.when(F.col("sessionId") != "", F.concat(F.lit("session:"), F.col("sessionId"))), F.concat(F.lit("row:"), F.col("rowId").cast("string")))


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key with the number of further rows and how many of them differ in content (``conflicts``).

    Rows without a key are skipped. Content is compared by a hash of all other columns; rows are reduced to (key,
    order, hash) before the shuffle, and the winner's columns are fetched by a join on the unique order columns.
    """
    rest = [c for c in df.columns if c not in (*order, key)]
    slim = df.filter(F.col(key).isNotNull()).select(key, *order, F.xxhash64(*rest).alias("__h"))
    first = slim.groupBy(key).agg(F.min_by(F.struct(*order, "__h"), F.struct(*order)).alias("w"), F.count("*").alias("copies"))
    bad = slim.join(first, key).filter(F.col("__h") != F.col("w.__h")).groupBy(key).agg(F.count("*").alias("conflicts"))
    win = first.join(bad, key, "left").select(F.col(key), *[F.col(f"w.{o}").alias(o) for o in order], (F.col("copies") - 1).alias("further"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))
    return df.join(win, [key, *order])


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key."""
    last = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order)).alias("w"))
    return df.join(last.select(F.col(key), *[F.col(f"w.{o}").alias(o) for o in order]), [key, *order]).select(*df.columns)


def ordinal(df: DataFrame, order: list[str], bucket: Column, name: str = "ord") -> DataFrame:
    """0-based global position in ``order`` without one task sorting everything: positions inside buckets that do not
    decrease along the order, plus the sizes of earlier buckets."""
    from .sequence import with_position

    return with_position(df.withColumn("__all", F.lit(0)), ["__all"], order, bucket, name).drop("__all")


def sharded(df: DataFrame, order: list[str], bucket: Column, cap: int) -> DataFrame:
    """Adds ``shard``: consecutive chunks of ``cap`` rows in the canonical order."""
    d = ordinal(df, order, bucket, "__ord")
    return d.withColumn("shard", F.floor(F.col("__ord") / cap)).drop("__ord")


def named(c: str) -> Column:
    """Null and blank as (none)."""
    return F.when(is_blank(F.col(c)), "(none)").otherwise(F.col(c))


def share_of(df: DataFrame, by: str) -> DataFrame:
    """Count per value and its share of all counted rows; nulls are left out."""
    g = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    return g.select(by, "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))
