"""Trees of small files: one file a row in, arm, state and run from the paths out."""

from pathlib import Path

from pyspark.sql import functions as F

from cardlake.sources import files


def test_small_files_are_written_and_read_in_a_few_tasks(spark, tmp_path):
    n = 1_500
    d = spark.range(n).select(F.concat(F.lit("A"), F.col("id") % 2, F.lit("/"), "id", F.lit("/run1.scored.json")).alias("path"), F.concat(F.lit('{"tier_score": '), F.col("id") % 7, F.lit("}")).alias("value"))
    files.write_texts(d, str(tmp_path))
    files.write_texts(d, str(tmp_path))
    assert sum(p.is_file() for p in tmp_path.rglob("*")) == n
    r = files.load_scored(spark, str(tmp_path))
    assert r.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    got = {(x.arm, x.state, x.run, x.t) for x in r.select("arm", "state", "run", F.try_variant_get("doc", "$.tier_score", "int").alias("t")).collect()}
    assert got == {(f"A{i % 2}", str(i), "run1", i % 7) for i in range(n)}


def test_odd_names_and_contents(spark, tmp_path):
    def put(path, text):
        p = Path(tmp_path, path)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")

    put("an arm/ß 1/r.2.response.txt", "two\nlines ♠\n")
    put("an arm/ß 1/r.2.scored.json", "no json")
    put("an arm/ß 1/.r.response.txt", "hidden")
    put("an arm/ß 1/r.response.txt.crc", "sum")
    put("an arm/ß 1/deeper/r.response.txt", "too deep")
    put("_tmp/s/r.response.txt", "hidden")
    put("b/s/r.response.txt", "")
    put("top.response.txt", "not in an arm")
    assert {tuple(r) for r in files.scan_responses(spark, str(tmp_path)).collect()} == {("two\nlines ♠\n", "an arm", "ß 1", "r.2"), ("", "b", "s", "r")}
    assert [tuple(r) for r in files.load_scored(spark, f"file:{tmp_path}").collect()] == [(None, "an arm", "ß 1", "r.2")]
    files.write_texts(spark.createDataFrame([("c d/e/f.response.txt", None)], "path string, value string"), f"{tmp_path}/out")
    assert [tuple(r) for r in files.scan_responses(spark, f"{tmp_path}/out").collect()] == [("", "c d", "e", "f")]
