"""Aggregates over the server's event stream; used by batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(events: DataFrame) -> DataFrame:
    """One row: games started, ended, abandoned, moves, won, stuck, win rate and mean moves of ended games (0 if none)."""
    ended = F.col("event") == "game_ended"
    is_ = lambda e: F.count_if(F.col("event") == e)
    g = events.agg(
        is_("game_started").alias("started"),
        is_("game_ended").alias("ended"),
        is_("game_abandoned").alias("abandoned"),
        is_("move_played").alias("moves"),
        F.count_if(ended & F.col("won")).alias("won"),
        F.count_if(ended & F.col("stuck")).alias("stuck"),
        F.sum(F.when(ended, F.col("move_count"))).alias("__s"),
        F.count(F.when(ended, F.col("move_count"))).alias("__n"),
    )
    rate = F.coalesce(F.try_divide(F.col("won").cast("double"), F.col("ended")), F.lit(0.0))
    return g.select("started", "ended", "abandoned", "moves", "won", "stuck", rate.alias("win_rate"), F.coalesce(F.try_divide(F.col("__s").cast("double"), F.col("__n")), F.lit(0.0)).alias("avg_moves"))
