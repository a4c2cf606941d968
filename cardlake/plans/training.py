"""Queries of the general training-data operators: schema drift (p1) and repeated deliveries (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import deduplicate, message_ident, repeated_deliveries
from ..operators.drift import fused_records, schema_changes
from ..session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(table(spark, sf, "raw_lines", "exporter", "exportedAt", "fileName", "body")).select("fileName", "field", "change")


def p1_table(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent table as JSON text per record, with the decision record's leading fields as columns."""
    t = fused_records(table(spark, sf, "raw_lines", "exporter", "exportedAt", "fileName", "lineNo", "body"))
    pick = lambda k: F.try_element_at("fields", F.lit(k))["canonical"]
    return t.select(
        "exporter", "fileName", "lineNo", pick("id").alias("id"), pick("sessionId").alias("sessionId"), pick("turnIndex").alias("turnIndex"), pick("schemaTier").alias("schemaTier"), pick("appCommit").alias("appCommit"),
        F.to_json("fields").alias("fields"),
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows stand in order of arrival, so the earliest delivery is also the smallest rowId."""
    return repeated_deliveries(table(spark, sf, "decision_recs", "rowId", "sessionId", "id", "receivedAt"), message_ident(), "rowId", "receivedAt")


def p4_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Every message once: the whole rows, by delivery time and then arrival."""
    d = table(spark, sf, "decision_recs")
    return deduplicate(d, message_ident(), "rowId", "receivedAt").select("rowId", "batchId", "id", "sessionId", "turnIndex", "timestamp", "schemaTier", "outcome", "agentId", "model", "appCommit", "seed")


#: Identifier however it is written; blank is null. The same rule as the operator's, for DuckDB.
SQL_ID = r"""nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(id, '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g')),
 '^(urn:)?uuid:', ''), '^\{(.*)\}$', '\1'), '^([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})$', '\1\2\3\4\5'), '')"""
SQL_SESSION = r"CASE WHEN regexp_replace(sessionId, '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g') <> '' THEN sessionId END"
SQL_NAMED = f"SELECT *, {SQL_SESSION} AS ses, {SQL_ID} AS cid FROM decision_recs"

QUERIES = {"p1_found": p1_found, "p1_table": p1_table, "p4_found": p4_found, "p4_messages": p4_messages}

SQL = {
    "p4_found": f"""WITH n AS ({SQL_NAMED}), f AS (SELECT ses, cid, min(rowId) AS first FROM n WHERE ses IS NOT NULL AND cid IS NOT NULL GROUP BY ses, cid)
SELECT n.rowId FROM n JOIN f ON n.ses = f.ses AND n.cid = f.cid WHERE n.rowId > f.first""",
    "p4_messages": f"""WITH n AS ({SQL_NAMED}), r AS (SELECT *, row_number() OVER (PARTITION BY ses, cid ORDER BY receivedAt NULLS LAST, rowId) AS k FROM n)
SELECT rowId, batchId, id, sessionId, turnIndex, "timestamp", schemaTier, outcome, agentId, model, appCommit, seed FROM r WHERE k = 1 OR ses IS NULL OR cid IS NULL""",
}
