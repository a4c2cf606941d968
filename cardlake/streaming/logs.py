"""The two append-only logs as streams: running summary, deduplication that never forgets, stall detection, ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import summary
from ..session import shared_place


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A growing Parquet table as a stream; the schema is that of what lies there. The path is given as a pattern that
    matches itself, since a stream takes a single file only by pattern."""
    schema = spark.read.parquet(path).schema
    path = path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A growing directory of JSON lines as a stream; the schema is explicit, times stay text."""
    return spark.readStream.schema(schema).json(path)


def drain(df: DataFrame, mode: str, what: str) -> DataFrame:
    """Run a stream over everything available and return the result as a table.

    Append results go to Parquet in the shared folder (exactly once by the file sink's log); complete results, which
    are aggregates of bounded size, are overwritten there batch by batch.
    """
    spark, out, log = df.sparkSession, shared_place(df.sparkSession, what), shared_place(df.sparkSession, f"{what}-log")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def running_summary(events: DataFrame) -> DataFrame:
    """Summary recomputed over the full history with every batch (complete mode)."""
    return drain(summary(events), "complete", "summary")


def once_only(stream: DataFrame, key: list[str]) -> DataFrame:
    """First delivery of every key. No watermark on purpose: membership is by identifier, late data is never dropped;
    the state holds one key per message and is partitioned by it."""
    return drain(stream.dropDuplicates(key), "append", "once")


_STALL_OUT = "sessionId string, turn int, rowId bigint, flat int"


def _stall(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    fc, fd, flat = state.get if state.exists else (None, None, -1)
    rows = pd.concat(list(batches)).sort_values(["turn", "rowId"])
    out = []
    for turn, rid, a, b in zip(rows["turn"], rows["rowId"], rows["fc"], rows["fd"]):
        if pd.isna(a) or pd.isna(b):
            out.append((key[0], int(turn), int(rid), None))
            continue
        flat = flat + 1 if (fc, fd) == (int(a), int(b)) else 0
        fc, fd = int(a), int(b)
        out.append((key[0], int(turn), int(rid), flat))
    state.update((fc, fd, flat))
    yield pd.DataFrame(out, columns=["sessionId", "turn", "rowId", "flat"]).astype({"flat": "Int64"})


def stalls_on_stream(turns: DataFrame) -> DataFrame:
    """flat per decision as it arrives: state per session is (foundation, hidden, flat), three numbers. Rows of one batch
    are put in turn order; a row that arrives after its successors counts where it arrives."""
    t = turns.select("sessionId", "turn", "rowId", "fc", "fd").filter("sessionId IS NOT NULL AND turn IS NOT NULL")
    s = t.groupBy("sessionId").applyInPandasWithState(_stall, _STALL_OUT, "fc int, fd int, flat int", "append", GroupStateTimeout.NoTimeout)
    return drain(s, "append", "stalls")


def ingest_batches(stream: DataFrame, store: str, key: str) -> None:
    """Append rows whose key is not in the store yet; a batch that is run again adds nothing."""

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            new = new.join(spark.read.parquet(store).select(key), key, "left_anti").select(*batch.columns)
        except Exception as e:  # the store does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(store)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", shared_place(stream.sparkSession, "ingest")).trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per event-time window with a watermark. An extension: the logs themselves are never cut by time."""
    e = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n")
