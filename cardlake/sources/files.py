"""Files in and out: JSON lines, whole JSON documents, path-derived columns, schema-faithful shards."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder fits the path or pattern, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines with an explicit schema: no inference, strings stay strings, blank lines skipped, a malformed line
    fails the read. A missing path is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_union(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the schema inferred over all rows, so sparse nested fields keep their type; times stay text."""
    return spark.read.option("samplingRatio", 1.0).option("inferTimestamp", False).json(path)


def new_fields(spark: SparkSession, path: str, frozen: T.StructType) -> DataFrame:
    """Top-level fields of JSON lines that a frozen schema does not have, with the number of records that use them."""
    keys = F.explode(F.json_object_keys("value")).alias("field")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(keys).filter(~F.col("field").isin(*frozen.fieldNames())).groupBy("field").agg(F.count("*").alias("records"))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines per file."""
    return spark.read.text(path).filter(F.trim("value") != "").groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("lines"))


def scan_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole JSON files: path, sha256, kind (ai_log, win_record, unknown) and the document as a variant. Invalid JSON is
    kind unknown with a null document, not a failure. Equal contents appear once (the first path)."""
    if not _exists(spark, pattern):
        return spark.createDataFrame([], "path string, sha256 string, kind string, doc variant")
    f = spark.read.format("binaryFile").load(pattern).select(F.col("path"), F.sha2("content", 256).alias("sha256"), F.try_parse_json(F.decode("content", "UTF-8")).alias("doc"))
    first = f.groupBy("sha256").agg(F.min("path").alias("path"))
    return f.join(first, ["sha256", "path"], "left_semi").select("path", "sha256", classify("doc").alias("kind"), "doc")


def classify(doc: str) -> Column:
    has = lambda k: F.try_variant_get(doc, f"$.{k}", "variant").isNotNull()
    return F.when(has("interactions"), "ai_log").when(has("moveHistory"), "win_record").otherwise("unknown")


def interactions(docs: DataFrame) -> DataFrame:
    """One row per interaction of the ai_log documents, in order."""
    logs = docs.filter("kind = 'ai_log'").select("path", "sha256", F.try_variant_get("doc", "$.interactions", "array<variant>").alias("a"))
    return logs.select("path", "sha256", F.posexplode("a").alias("pos", "item"))


def load_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Interactions from a document with an ``interactions`` list, a plain array, or JSON lines: (path, pos, item)."""
    f = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"), F.try_parse_json("value").alias("v"))
    inside = F.try_variant_get("v", "$.interactions", "array<variant>")
    whole = F.try_variant_get("v", "$", "array<variant>")
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.try_parse_json(x)), lambda x: x.isNotNull())
    return f.select("path", F.posexplode(F.coalesce(inside, whole, lines)).alias("pos", "item"))


def with_path_parts(df: DataFrame, pattern: str, *names: str) -> DataFrame:
    """Columns taken from the input file's path by the groups of a pattern."""
    p = F.input_file_name()
    return df.select("*", *[F.regexp_extract(p, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def not_listed(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose content is not in the manifest yet."""
    return docs.join(manifest.select("sha256").distinct(), "sha256", "left_anti")


def write_jsonl(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Full overwrite as JSON lines; nulls are written, non-ASCII is kept, one directory per value of ``partition``."""
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    (w.partitionBy(partition) if partition else w).json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", True).json(path)


def last_part_wins(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Parquet shards keyed by id; of a repeated key the row of the last part stays."""
    d = spark.read.parquet(path)
    last = d.select(key, F.input_file_name().alias("__f"), F.col("_metadata.row_index").alias("__r")).groupBy(key).agg(F.max(F.struct("__f", "__r")).alias("w"))
    at = d.select("*", F.input_file_name().alias("__f"), F.col("_metadata.row_index").alias("__r"))
    return at.join(last.select(key, F.col("w.__f").alias("__f"), F.col("w.__r").alias("__r")), [key, "__f", "__r"]).select(*d.columns)


def _uri(spark: SparkSession, path: str) -> str:
    """The path with its file system, as tasks need it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def write_texts(df: DataFrame, root: str) -> None:
    """One file a row of (path, value) under ``root``, written where the row is. A file gets its name when it is whole, so a
    repeated task does no harm. For file systems that Arrow knows."""
    uri = _uri(df.sparkSession, root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = FileSystem.from_uri(uri)
        for pdf in batches:
            for path, value in zip(pdf["path"], pdf["value"]):
                folder = f"{base}/{path}".rpartition("/")[0]
                fs.create_dir(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write((value or "").encode())
                fs.move(part, f"{base}/{path}")
            yield pdf[["path"]]

    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    df.select("path", "value").repartition(tasks).mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


#: Files that a reading task hands on at once, and their bytes.
_FILES, _BYTES = 1_000, 8 << 20


def _texts(spark: SparkSession, root: str, end: str) -> DataFrame:
    """(arm, state, run, value) of the files ``root/arm/state/run`` + ``end``. Folders are listed and files read in tasks,
    many to a task: Spark's own scan lists every folder on the driver and plans each small file as megabytes."""
    uri = _uri(spark, root)
    tasks = 4 * spark.sparkContext.defaultParallelism

    def folders(*names: str) -> list[str]:
        fs, base = FileSystem.from_uri(uri)
        found = fs.get_file_info(FileSelector("/".join((base, *names))))
        return [x.base_name for x in found if x.type == FileType.Directory and not x.base_name.startswith((".", "_"))]

    def arms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield pd.DataFrame({"arm": folders()}, dtype=object)

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for arm in pdf["arm"]:
                yield pd.DataFrame([(arm, x) for x in folders(arm)], columns=["arm", "state"], dtype=object)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = FileSystem.from_uri(uri)
        rows: list[tuple] = []
        held = 0
        for pdf in batches:
            for arm, state in zip(pdf["arm"], pdf["state"]):
                for x in fs.get_file_info(FileSelector(f"{base}/{arm}/{state}")):
                    name = x.base_name
                    if x.type != FileType.File or not name.endswith(end) or name == end or name.startswith((".", "_")):
                        continue
                    with fs.open_input_stream(x.path) as f:
                        rows.append((arm, state, name[: -len(end)], f.read().decode(errors="replace")))
                    held += x.size or 0
                    if len(rows) >= _FILES or held >= _BYTES:
                        yield pd.DataFrame(rows, columns=["arm", "state", "run", "value"])
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["arm", "state", "run", "value"])

    d = spark.range(1, numPartitions=1).mapInPandas(arms, "arm string").repartition(tasks)
    d = d.mapInPandas(states, "arm string, state string").repartition(tasks)
    return d.mapInPandas(read, "arm string, state string, run string, value string")


def load_scored(spark: SparkSession, root: str) -> DataFrame:
    """Scored answers in ``root/arm/state/run.scored.json``: arm, state and run from the path, the document as a variant.
    A file that is no JSON has a null document."""
    return _texts(spark, root, ".scored.json").select(F.try_parse_json("value").alias("doc"), "arm", "state", "run")


def scan_responses(spark: SparkSession, root: str) -> DataFrame:
    """Raw answers in ``root/arm/state/run.response.txt``: arm, state and run from the path, the whole text."""
    return _texts(spark, root, ".response.txt").select(F.col("value").alias("response"), "arm", "state", "run")
