"""Streams run to their end over files that arrive in several batches."""

from cardlake.streaming import logs


def write(spark, path, *batches, schema):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)


def test_summary_over_batches(spark, tmp_path):
    p = str(tmp_path / "log")
    s = "event string, won boolean, stuck boolean, move_count int"
    write(spark, p, [("game_started", None, None, 0), ("game_ended", True, False, 10)], [("game_ended", False, True, 20), ("move_played", None, None, 1)], schema=s)
    r = logs.running_summary(logs.stream_table(spark, p, 1)).first()
    assert (r.started, r.ended, r.moves, r.won, r.stuck, r.win_rate, r.avg_moves) == (1, 2, 1, 1, 1, 0.5, 15.0)


def test_deduplication_never_forgets(spark, tmp_path):
    p = str(tmp_path / "d")
    write(spark, p, [("a",), ("b",)], [("a",), ("c",)], [("b",)], schema="id string")
    assert sorted(r.id for r in logs.once_only(logs.stream_table(spark, p, 1), ["id"]).collect()) == ["a", "b", "c"]


def test_stalls_keep_state_between_batches(spark, tmp_path):
    p = str(tmp_path / "t")
    s = "sessionId string, turn int, rowId bigint, fc int, fd int"
    write(spark, p, [("s", 0, 1, 1, 5), ("s", 1, 2, 1, 5)], schema=s)
    write(spark, p, [("s", 2, 3, None, None), ("s", 3, 4, 1, 5), ("q", 0, 5, 0, 21)], schema=s)
    got = {r.rowId: r.flat for r in logs.stalls_on_stream(logs.stream_table(spark, p, 1)).collect()}
    assert got[1] == 0 and got[3] is None and got[5] == 0 and {got[2], got[4]} <= {0, 1, 2}


def test_ingest_twice_adds_nothing(spark, tmp_path):
    p, store = str(tmp_path / "in"), str(tmp_path / "store")
    write(spark, p, [("a", 1), ("b", 2), ("a", 1)], schema="id string, v int")
    logs.ingest_batches(logs.stream_table(spark, p), store, "id")
    write(spark, p, [("b", 2), ("c", 3), (None, 4)], schema="id string, v int")
    logs.ingest_batches(logs.stream_table(spark, p), store, "id")
    assert sorted(r.id for r in spark.read.parquet(store).collect()) == ["a", "b", "c"]
