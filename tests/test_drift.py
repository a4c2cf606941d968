"""Drifting schemas: every kind of change, and the consistent table."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cardlake.operators.drift import canonical_names, fused_records, schema_changes, tagged_values

SCHEMA = "exporter string, exportedAt timestamp, fileName string, lineNo int, body string"


def files(spark, *contents, exporter="e"):
    rows = []
    for i, recs in enumerate(contents):
        for n, r in enumerate(recs):
            rows.append((exporter, datetime(2026, 1, 1) + timedelta(days=i), f"f{i}", n, r if r is None or isinstance(r, str) else json.dumps(r)))
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    return sorted((r.fileName, r.field, r.change) for r in schema_changes(df).collect())


def rec(i, **more):
    return {"id": f"{i:08x}", "turn": i, "model": ["a-model", "b-model"][i % 2], "decision": {"idx": i % 5}, **more}


def test_added_removed_retyped_renamed(spark):
    a = [rec(i, seed=100000 + i) for i in range(12)]
    b = [{("deal" if k == "seed" else k): v for k, v in rec(i, seed=100020 + i).items() if k != "model"} for i in range(12)]
    c = [{**x, "turn": str(x["turn"]), "fresh": True} for x in b]
    d = [{**x, "decision": {"moveIndex": x["decision"]["idx"]}} for x in c]
    assert changes(files(spark, a, b, c, d)) == [("f1", "model", "removed"), ("f1", "seed", "renamed"), ("f2", "fresh", "added"), ("f2", "turn", "retyped"), ("f3", "decision.idx", "renamed")]


def test_no_rename_between_unlike_values(spark):
    a = [rec(i, note=f"a longer remark number {i} about the board") for i in range(10)]
    b = [rec(i, version=f"3.{i}.1") for i in range(10)]
    assert changes(files(spark, a, b)) == [("f1", "note", "removed"), ("f1", "version", "added")]


def test_mixed_types_and_null_values(spark):
    a = [rec(i, x=i) for i in range(6)]
    b = [rec(i, x=i if i % 2 else str(i)) for i in range(6)]
    c = [rec(i, x=None) for i in range(6)]
    assert changes(files(spark, a, b, c)) == [("f1", "x", "retyped")]


def test_bad_lines_and_order_do_not_matter(spark):
    a = [rec(i) for i in range(5)]
    b = ['{"id": "x", "tu', "", None, "[1]", "3", *[json.dumps(rec(i)) for i in range(5)]]
    assert changes(files(spark, a, b)) == []
    assert changes(files(spark)) == []
    assert changes(files(spark, a)) == []


def test_exporters_are_apart(spark):
    one = files(spark, [rec(1)], exporter="one")
    two = files(spark, [rec(1, extra=1)], exporter="two")
    assert changes(one.union(two)) == []


def test_tagged_union_table(spark):
    a = [rec(i, seed=100000 + i) for i in range(8)]
    b = [{("deal" if k == "seed" else k): (str(v) if k == "seed" else v) for k, v in rec(i, seed=100000 + i).items()} for i in range(8)]
    c = [{("deal" if k == "seed" else k): v for k, v in rec(i, seed=100000 + i).items()} for i in range(8)]
    df = files(spark, a, c, b)
    assert canonical_names(df)["seed"] == "deal"
    t = {(r.fileName, r.lineNo): r.fields for r in fused_records(df).collect()}
    assert len(t) == 24
    assert t["f0", 3]["deal"].number == 100003 and t["f2", 3]["deal"].text == "100003"
    assert t["f0", 3]["deal"].canonical == t["f2", 3]["deal"].canonical == "100003"


def test_tagged_values_kinds(spark):
    df = files(spark, [{"s": "x", "n": 1.5, "b": True, "o": {"q": 1}, "a": [1], "z": None, "decision": {"k": None}}])
    assert {r.path: r.kind for r in tagged_values(df).collect()} == {"s": "string", "n": "number", "b": "boolean", "o": "object", "a": "array", "z": None, "decision.k": None}


def by_record(df, names=None):
    return {(r.exporter, r.fileName, r.lineNo): {k: v.canonical for k, v in r.fields.items()} for r in fused_records(df, names).collect()}


def test_renames_hold_for_their_exporter_and_files(spark):
    old, new = [rec(i, seed=100000 + i) for i in range(12)], [rec(i, deal=100000 + i) for i in range(12)]
    one = files(spark, old, new, new, exporter="one")
    other = files(spark, [rec(i, seed=100000 + i) for i in range(4)], exporter="two")
    t = by_record(one.union(other))
    assert t["one", "f0", 3]["deal"] == "100003" and "seed" not in t["one", "f0", 3]
    assert t["two", "f0", 3]["seed"] == "100003" and "deal" not in t["two", "f0", 3]


def test_names_of_one_record_are_two_fields(spark):
    old, new = [rec(i, seed=100000 + i) for i in range(12)], [rec(i, deal=100000 + i) for i in range(12)]
    both = files(spark, [rec(i, seed=i, deal=100 + i) for i in range(6)], exporter="two")
    t = by_record(files(spark, old, new, exporter="one").union(both))
    assert t["two", "f0", 3]["seed"] == "3" and t["two", "f0", 3]["deal"] == "103"
    assert t["one", "f0", 3]["seed"] == "100003" and t["one", "f1", 3]["deal"] == "100003"


def test_no_filled_value_is_dropped(spark):
    recs = [{"n": None, "a": 1}, {"n": 5, "a": 1, "b": 2}, {"a": 1, "b": 2}, {"n": None, "a": None}, {"a": None, "b": 2}]
    t = by_record(files(spark, recs), {"a": "n", "b": "n"})
    got = [t["e", "f0", i] for i in range(5)]
    assert got == [{"n": "1"}, {"n": "5", "a": "1", "b": "2"}, {"n": "1", "b": "2"}, {"n": None}, {"n": "2"}]
    dotted = by_record(files(spark, [{"decision": {"k": 1}, "decision.k": None}, {"decision": {"k": None}, "decision.k": 2}]))
    assert [dotted["e", "f0", i] for i in range(2)] == [{"decision.k": "1"}, {"decision.k": "2"}]


def test_names_that_exporters_agree_on_hold_for_all(spark):
    old, new = [rec(i, seed=100000 + i) for i in range(12)], [rec(i, deal=100000 + i) for i in range(12)]
    df = files(spark, old, exporter="three")
    for e in ("one", "two"):
        df = df.union(files(spark, old, new, new, exporter=e).withColumn("fileName", F.concat(F.lit(e), "fileName")))
    t = by_record(df)
    assert t["three", "f0", 3]["deal"] == "100003" and "seed" not in t["three", "f0", 3]
