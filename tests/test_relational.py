"""Window folds, dedup, sampling, publishing and statistics on small tables, against direct loops."""

import shutil
import random

from pyspark.sql import functions as F

from cardlake.operators import decisions as dec
from cardlake.operators import publish, runs, sampling
from cardlake.operators import turnwindows as tw
from cardlake.operators.sequence import with_position, with_previous, with_running_max


def turns(spark, *sessions):
    return spark.createDataFrame([(f"s{i}", t, t, k) for i, s in enumerate(sessions) for t, k in enumerate(s)], "sessionId string, turn int, rowId int, key string")


def walk(keys):
    last = {k: i for i, k in enumerate(keys) if k is not None}
    i, kept = 0, []
    while i < len(keys):
        if keys[i] is None:
            kept.append(i)
            i += 1
        else:
            kept.append(last[keys[i]])
            i = last[keys[i]] + 1
    return kept


def test_loop_collapse(spark):
    r = random.Random(1)
    cases = [list("ABAB"), list("ABCD"), ["A"], [None, "A", None, "A", "B"], [r.choice(["A", "B", "C", None, "D", "E"]) for _ in range(40)]]
    got = {}
    for x in tw.collapse_loops(turns(spark, *cases), ["turn", "rowId"], "key", "turn").collect():
        got.setdefault(x.sessionId, []).append(x.turn)
    for i, c in enumerate(cases):
        assert sorted(got[f"s{i}"]) == walk(c)


def test_long_sequence_windows_split_over_chunks(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), t, r.choice([None, *range(9)])) for t in r.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    chunk = F.floor(F.col("t") / 16)
    prev = {(x.k, x.t): (x.prev_t, x.prev_v) for x in with_previous(df, ["k"], ["t"], chunk, ["t", "v"]).collect()}
    pos = {(x.k, x.t): x.pos for x in with_position(df, ["k"], ["t"], chunk).collect()}
    top = {(x.k, x.t): x.top for x in with_running_max(df, ["k"], ["t"], chunk, F.col("v"), "top").collect()}
    for k in "ab":
        mine = sorted(x for x in rows if x[0] == k)
        best = None
        for i, (_, t, v) in enumerate(mine):
            assert pos[k, t] == i
            assert prev[k, t] == ((mine[i - 1][1], mine[i - 1][2]) if i else (None, None))
            best = v if best is None else best if v is None else max(best, v)
            assert top[k, t] == best


def test_stalls_skip_unparsed_rows(spark):
    df = spark.createDataFrame([("s", i, i, fc, fd) for i, (fc, fd) in enumerate([(1, 5), (1, 5), (None, None), (1, 5), (2, 5), (2, 5)])], "sessionId string, turn int, rowId int, fc int, fd int")
    got = {r.turn: (r.flat, r.stalled) for r in tw.stalls(df, ["turn"], 2).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (None, False), 3: (2, True), 4: (0, False), 5: (1, False)}


def test_plateau_tail_counts_one_more(spark):
    df = spark.createDataFrame([("s", t, v) for t, v in enumerate([1, 1, 1, 2, 2, 2])], "sessionId string, turn int, fc int")
    got = sorted((r.start, r.length) for r in tw.plateaus(df, ["turn"], "fc", 1).collect())
    assert got == [(0, 3), (3, 3)]


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, None, "z"), (5, "b", "q")], "rowId bigint, id string, v string")
    got = {r.id: (r.rowId, r.further, r.conflicts, r.v) for r in dec.first_wins(df, "id", ["rowId"]).collect()}
    assert got == {"a": (1, 2, 1, "x"), "b": (5, 0, 0, "q")}
    assert sorted((r.id, r.rowId) for r in dec.last_wins(df, "id", ["rowId"]).collect()) == [("a", 3), ("b", 5)]


def test_quota_takes_the_same_rows_whatever_the_salt(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(300)], "id bigint, g string")
    a = sorted(tuple(r) for r in sampling.quota(df, "g", "id", 7, seed=1).collect())
    b = sorted(tuple(r) for r in sampling.quota(df, "g", "id", 7, seed=1, salts=1).collect())
    assert a == b and len(a) == 14
    assert len(sampling.uniform(df, "id", 1000).collect()) == 300


def test_split_sizes(spark):
    g = spark.createDataFrame([(f"g{i}",) for i in range(103)], "g string")
    n = {r.split: r["count"] for r in sampling.split_groups(g, "g", {"train": 0.8, "valid": 0.1, "test": 0.1}).groupBy("split").count().collect()}
    assert n == {"train": 82, "valid": 10, "test": 11}


def test_publish_is_idempotent_and_fills_the_tail(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(50)], "id bigint, v string")
    path = str(tmp_path / "shards")
    shards = lambda d, **k: {r.shard: r.rows for r in publish.publish(d, path, "id", ["id"], F.floor(F.col("id") / 10), cap=10, **k).collect()}
    assert shards(df.filter("id < 25")) == {0: 10, 1: 10, 2: 5}
    assert shards(df.withColumn("new_field", F.lit(1))) == {0: 10, 1: 10, 2: 10, 3: 10, 4: 10}
    assert sum(shards(df).values()) == 50
    back = spark.read.parquet(path)
    assert back.count() == 50 and "new_field" not in back.columns
    assert shards(df.filter("id < 20"), rebuild=True) == {0: 10, 1: 10} and spark.read.parquet(path).count() == 20
    shutil.rmtree(f"{path}/shard=0")
    assert shards(df) == {0: 10, 1: 10, 2: 10, 3: 10, 4: 10} and spark.read.parquet(path).count() == 50


def test_bootstrap_is_repeatable_and_covers_the_mean(spark):
    rows = [(d, m, 20 + (3 if m == "better" else 0) + d % 3) for d in range(30) for m in ("base", "better")]
    df = spark.createDataFrame(rows, "deck bigint, arm string, fc int")
    a = runs.paired_bootstrap(df, "deck", "arm", "fc", "base", 200).collect()
    assert a == runs.paired_bootstrap(df.repartition(7), "deck", "arm", "fc", "base", 200).collect()
    assert a[0].delta == 3.0 and a[0].low == a[0].high == 3.0


def test_broken_json_gives_nulls(spark):
    cols = "rowId bigint, id string, sessionId string, turnIndex int, timestamp bigint, outcome string, model string, agentId string, seed bigint, schemaTier string, appCommit string, drawCount int, prompt string, decision string"
    df = spark.createDataFrame([(1, "a", "s", 0, 1, "success", "m", None, 1, None, "c", 1, "{broken", '{"moveIndex": 9'), (2, None, None, None, None, None, None, None, None, None, None, None, None, None)], cols)
    r = dec.turns(df).collect()
    assert all(x.fc is None and x.moveIndex is None for x in r)


def test_bootstrap_ci_draws_the_reference_replicates(spark, monkeypatch):
    from cardlake.operators import runs as ops
    from cardlake.plans import relational

    asked = []
    monkeypatch.setattr(ops, "paired_bootstrap", lambda *a, replicates, seed: asked.append(replicates))
    relational.bootstrap_ci(spark, "/root/testdata/sf0.001")
    assert asked == [5000]
