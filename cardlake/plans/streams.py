"""Queries that run a table through Structured Streaming to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..streaming import logs
from .relational import T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT count(*) FILTER (WHERE event = 'game_started') AS started, count(*) FILTER (WHERE event = 'game_ended') AS ended, count(*) FILTER (WHERE event = 'game_abandoned') AS abandoned, count(*) FILTER (WHERE event = 'move_played') AS moves,
count(*) FILTER (WHERE event = 'game_ended' AND won) AS won, count(*) FILTER (WHERE event = 'game_ended' AND stuck) AS stuck, coalesce(count(*) FILTER (WHERE event = 'game_ended' AND won) / nullif(count(*) FILTER (WHERE event = 'game_ended'), 0), 0.0) AS win_rate,
coalesce(CAST(sum(move_count) FILTER (WHERE event = 'game_ended') AS DOUBLE) / nullif(count(move_count) FILTER (WHERE event = 'game_ended'), 0), 0.0) AS avg_moves FROM server_log""")
def stream_summary(spark, sf):
    return logs.running_summary(logs.stream_table(spark, f"{sf}/server_log.parquet"))


@query("SELECT DISTINCT id FROM decision_recs WHERE id IS NOT NULL")
def stream_once(spark, sf):
    s = logs.stream_table(spark, f"{sf}/decision_recs.parquet").select("id").filter("id IS NOT NULL")
    return logs.once_only(s, ["id"])


@query(f"""WITH {T}, ok AS (SELECT * FROM u WHERE fc IS NOT NULL AND fd IS NOT NULL), c AS (SELECT *, CASE WHEN fc = lag(fc) OVER w AND fd = lag(fd) OVER w THEN 0 ELSE 1 END AS chg FROM ok WINDOW w AS (PARTITION BY sessionId ORDER BY turn, rowId)),
i AS (SELECT *, sum(chg) OVER (PARTITION BY sessionId ORDER BY turn, rowId) AS isl FROM c) SELECT sessionId, turn, rowId, CAST(row_number() OVER (PARTITION BY sessionId, isl ORDER BY turn, rowId) - 1 AS INT) AS flat FROM i""")
def stream_stalls(spark, sf):
    s = logs.stream_table(spark, f"{sf}/decision_recs.parquet", files_per_trigger=1000)
    return logs.stalls_on_stream(dec.turns(s).filter("sessionId <> '' AND turn IS NOT NULL"))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS "start", event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def daily_events(spark, sf):
    """Event-time windows, the batch form of the streaming extension."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


