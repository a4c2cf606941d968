"""Repeated deliveries: every spelling, every kind of missing value, hot identifiers."""

import random

from pyspark.sql import functions as F

from cardlake.functions.text import canonical_id, is_blank
from cardlake.operators.dedup import deduplicate, message_ident, repeated_deliveries

SCHEMA = "rowId bigint, receivedAt timestamp, sessionId string, id string, extra string"


def rows(spark, data):
    return spark.createDataFrame([(i + 1, None, s, d, "x") for i, (s, d) in enumerate(data)], SCHEMA)


def found(spark, data):
    return sorted(r.rowId for r in repeated_deliveries(rows(spark, data), message_ident(), "rowId", "rowId").collect())


def test_spellings_are_one_identifier(spark):
    h = "0123456789abcdef0123456789abcdef"
    forms = [h, h.upper(), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", f" {h}\t", f"urn:uuid:{h}", "{" + h + "}", f"﻿{h}​"]
    assert found(spark, [("s", f) for f in forms]) == list(range(2, len(forms) + 1))


def test_same_id_in_another_session_is_another_message(spark):
    assert found(spark, [("a", "m-1"), ("b", "m-1"), ("a", "M-1 ")]) == [3]


def test_blank_parts_are_never_cases(spark):
    data = [("a", None), ("a", None), ("a", ""), ("a", " ​"), (None, "m"), (None, "m"), ("", "m"), (" ", "m"), ("a", "m"), ("a", "m")]
    assert found(spark, data) == [10]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_kept_and_dropped_are_the_table_and_delivery_time_decides(spark):
    df = spark.createDataFrame([(1, "2026-01-02", "s", "m", "late"), (2, "2026-01-01", "s", "M", "early"), (3, None, "s", "m", "never"), (4, "2026-01-01", "s", None, "own")], "rowId bigint, at string, sessionId string, id string, rowId_ string").selectExpr("rowId", "CAST(at AS TIMESTAMP) AS at", "sessionId", "id", "rowId_")
    kept = deduplicate(df, message_ident(), "rowId", "at")
    assert kept.columns == df.columns
    assert sorted(r.rowId for r in kept.collect()) == [2, 4]


def test_hot_identifier_against_brute_force(spark):
    r = random.Random(3)
    data = [("hot", "m-1") if r.random() < 0.4 else (r.choice("abc"), f"m-{r.randint(0, 60)}") for _ in range(800)]
    seen, exp = set(), []
    for i, k in enumerate(data):
        if k in seen:
            exp.append(i + 1)
        seen.add(k)
    assert found(spark, data) == exp


def test_plan_aggregates_map_side_by_hash(spark, capsys):
    repeated_deliveries(rows(spark, [("a", "m")]), message_ident(), "rowId", "receivedAt").explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and "partial_min_by" in plan and "SortAggregate" not in plan


def test_any_row_key_keeps_the_earliest_delivery(spark):
    """Keys of 18 digits and more, negative ones, ties and times before 1970 against a direct loop."""
    r = random.Random(8)
    keys = r.sample([3 * 10**18, 5, -7, 2**63 - 1, -(2**63), 0, 10**18, 10**18 + 1, -(10**18)], 9)
    times = ["1950-01-01", "2026-01-01 00:00:00.000001", "2026-01-01", None, "2026-01-01"]
    data = [(k, times[i % 5], "s", f"m{i % 3}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, "rowId bigint, at string, sessionId string, id string").selectExpr("rowId", "CAST(at AS TIMESTAMP) AS at", "sessionId", "id")
    exp = {min((x for x in data if x[3] == m), key=lambda x: (x[1] is None, x[1] or "", x[0]))[0] for m in ("m0", "m1", "m2")}
    assert {x.rowId for x in deduplicate(df, message_ident(), "rowId", "at").collect()} == exp
    longs = df.select("rowId", (F.lit(2**63 - 1) - F.abs(F.pmod("rowId", F.lit(5)))).alias("at"), "sessionId", "id")
    assert deduplicate(longs, message_ident(), "rowId", "at").count() == 3


def test_text_helpers(spark):
    df = spark.createDataFrame([(None,), ("",), ("​ ﻿",), ("a",)], "x string")
    assert [r[0] for r in df.select(is_blank(df.x)).collect()] == [True, True, True, False]
    assert [r[0] for r in df.select(canonical_id(df.x)).collect()] == [None, None, None, "a"]
