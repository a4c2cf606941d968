"""Parsing of actions, answers and files."""

import json

import pytest
from pyspark.sql import functions as F

from cardlake.functions import actions, parsing
from cardlake.sources import files


def one(spark, value, col, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text,key",
    [
        ("Move 7S from col 3 to col 2", "move:7s:3:2"),
        ("MOVE 7♠ col3 -> col2.", "move:7s:3:2"),
        ("tableau 3 to tableau 2: 7s", "move:7s:3:2"),
        ("move the seven of spades from pile 3 onto pile 2", "move:7s:3:2"),
        ("move the 7 of spades from pile 3 onto pile 2", "move:7s:3:2"),
        ("  7S: column 3 → column 2 ", "move:7s:3:2"),
        ("Shift  TH (column 1) to column 4", "move:10h:1:4"),
        ("10♥: column 1 → column 4", "move:10h:1:4"),
        ("Place waste card QD on column 1", "move:qd:waste:1"),
        ("play the queen of diamonds off the waste onto pile 1", "move:qd:waste:1"),
        ("Send waste card AC up to foundation", "move:ac:waste:foundation"),
        ("Lift ac (column 5) to foundation", "move:ac:5:foundation"),
        ("Draw 3 card (stock)", "draw"),
        ("stock → waste", "draw"),
        ("TAKE NEXT STOCK CARD", "draw"),
        ("Waste back to stock (recycle)", "recycle"),
        ("turn the waste over into the stock", "recycle"),
        ("sing a song", "other:sing a song"),
        ("", None),
        (" ​", None),
        (None, None),
    ],
)
def test_action_keys(spark, text, key):
    assert one(spark, text, actions.action_key) == key


def test_log1mexp_is_stable(spark):
    import math

    for a in (-1e-9, -0.1, -0.7, -5.0, -700.0):
        assert one(spark, a, parsing.log1mexp, "double") == pytest.approx(math.log(-math.expm1(a)) if a > -math.log(2) else math.log1p(-math.exp(a)), rel=1e-9)


def test_sections(spark):
    text = "HEAD\nRECENT MOVES:\n  - a\n  - b\nLEGAL MOVES (x):\n  [0] c\n"
    assert one(spark, text, lambda c: parsing.without_section(c, "RECENT MOVES")) == "HEAD\nLEGAL MOVES (x):\n  [0] c\n"


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"interactions": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps({"interactions": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "c.json").write_text(json.dumps({"moveHistory": []}))
    (tmp_path / "d.json").write_text("{broken")
    d = files.scan_documents(spark, str(tmp_path / "*.json"))
    assert sorted(r.kind for r in d.collect()) == ["ai_log", "unknown", "win_record"]
    assert files.interactions(d).count() == 2
    assert files.not_listed(d, d.filter("kind = 'unknown'")).count() == 2
    assert files.load_interactions(spark, str(tmp_path / "a.json")).count() == 2
    out = str(tmp_path / "out")
    files.write_jsonl(spark.createDataFrame([(1, None, "é"), (2, "2026-01-01T00:00:00Z", "x")], "id int, t string, s string"), out)
    back = files.read_jsonl(spark, out, "id int, t string, s string")
    assert sorted((r.id, r.t, r.s) for r in back.collect()) == [(1, None, "é"), (2, "2026-01-01T00:00:00Z", "x")]
    assert files.read_jsonl(spark, str(tmp_path / "missing"), "id int").count() == 0
    assert dict(files.read_jsonl_union(spark, out).dtypes)["t"] == "string"
    assert [r.field for r in files.new_fields(spark, out, files.T.StructType([files.T.StructField("id", files.T.IntegerType()), files.T.StructField("t", files.T.StringType())])).collect()] == ["s"]
    assert sum(r.lines for r in files.count_lines(spark, out).collect()) == 2


def test_malformed_lines_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id int").collect()
