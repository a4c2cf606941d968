"""Queries of this subpackage's operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import conversations, mixing, overlap, pairs, residue, runs, splits, tokens


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.bound_sessions(table(spark, sf, "decision_recs", "sessionId", "seed"))


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every session's split: 80 % train, 10 % valid, 10 % test of the rows."""
    return splits.assign_splits(table(spark, sf, "decision_recs", "sessionId", "seed"))


_MESSAGES = ("messageId", "sessionId", "turnIndex", "timestamp", "role", "text", "receivedAt")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.unusable_conversations(table(spark, sf, "session_messages", *_MESSAGES))


def p3_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of the usable conversations in order, with parent and tree."""
    return conversations.rebuilt_conversations(table(spark, sf, "session_messages", *_MESSAGES))


def p3_trees(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions read as interleaved channels: each message's likeliest parent and tree."""
    return conversations.disentangled(table(spark, sf, "session_messages", *_MESSAGES))


_DECISIONS = ("rowId", "sessionId", "id", "turnIndex", "timestamp", "decision")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    r = runs.collapse_runs(runs.decision_events(table(spark, sf, "decision_recs", *_DECISIONS)))
    r = r.filter("lastTurn > firstTurn")
    return r.select(F.col("entity").alias("sessionId"), F.col("firstTurn").cast("int").alias("firstTurn"), F.col("lastTurn").cast("int").alias("lastTurn"))


def p5_events(spark: SparkSession, sf: str) -> DataFrame:
    """Near-identical successive decisions as one event each: a differing card or column costs less than another kind."""
    r = runs.collapse_runs(runs.decision_events(table(spark, sf, "decision_recs", *_DECISIONS)), penalty=0.6, weights=(1.0, 0.4, 0.3, 0.3))
    return r.select(F.col("entity").alias("sessionId"), "firstTurn", "lastTurn", "events", "label", "duration_ms")


_ANSWERS = ("rowId", "prompt", "decision", "thinkingText")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, sf, "decision_recs", *_ANSWERS))


def p6_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every defect of every row whose posterior reaches its cutoff."""
    return pairs.defect_labels(table(spark, sf, "decision_recs", *_ANSWERS))


_EXAMPLES = ("exampleId", "split", "origin", "seed", "prompt")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, sf, "sft_examples", *_EXAMPLES)).select("exampleIdA", "exampleIdB")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf, "sft_examples", *_EXAMPLES))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encoded(table(spark, sf, "documents", "doc_id", "text"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixture(table(spark, sf, "documents", "doc_id", "source", "text"), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.reached_shares(table(spark, sf, "documents", "doc_id", "source", "text"), table(spark, sf, "mix_targets"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue_documents(table(spark, sf, "documents", "doc_id", "source", "text")).select("doc_id")


def p10_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The residue messages with the documents and sources they recur in."""
    r = residue.residue_segments(table(spark, sf, "documents", "doc_id", "source", "text"))
    return r.groupBy("kind", "plain").agg(F.max("docs").alias("docs"), F.max("sources").alias("sources"))


def p10_kept(spark: SparkSession, sf: str) -> DataFrame:
    return residue.without_residue(table(spark, sf, "documents", "doc_id", "source", "text", "lang")).select("doc_id", "source", "lang")


QUERIES = {f.__name__: f for f in (p2_found, p2_splits, p3_found, p3_conversations, p3_trees, p5_found, p5_events, p6_found, p6_labels, p7_found, p7_report, p8_ids, p9_mix, p9_shares, p10_found, p10_messages, p10_kept)}
