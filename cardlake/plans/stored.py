"""Queries that write tables as files and read them back through the sources: lines, documents, shards, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import publish
from ..session import shared_place, table
from ..sources import files
from ..streaming import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query('SELECT DISTINCT session_id, "timestamp", event, kind, score, won FROM server_log')
def json_lines(spark, sf):
    """Events written as JSON lines and read with their schema; times stay text, nulls stay."""
    d = table(spark, sf, "server_log", "session_id", "timestamp", "event", "kind", "score", "won").distinct()
    out = shared_place(spark, "lines")
    files.write_jsonl(d, out)
    return files.read_jsonl(spark, out, d.schema)


@query("SELECT split, count(*) AS n, count(DISTINCT exampleId) AS ids FROM sft_examples GROUP BY split")
def split_files(spark, sf):
    """Examples written as one directory of JSON lines a split, and read by split from the paths."""
    out = shared_place(spark, "splits")
    files.write_jsonl(table(spark, sf, "sft_examples", "exampleId", "split", "completion"), out, partition="split")
    d = files.with_path_parts(files.read_jsonl(spark, f"{out}/*/*.json", "exampleId bigint, completion string"), r"split=([^/]+)/", "split")
    return d.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("exampleId").alias("ids"))


@query(r"SELECT fileName, count(*) FILTER (WHERE regexp_replace(body, '\s+', '', 'g') <> '') AS lines FROM raw_lines GROUP BY fileName HAVING count(*) FILTER (WHERE regexp_replace(body, '\s+', '', 'g') <> '') > 0")
def line_counts(spark, sf):
    """Lines of the raw files that are not blank, counted in the files themselves."""
    out = shared_place(spark, "raw")
    table(spark, sf, "raw_lines", "fileName", "body").select("fileName", F.coalesce("body", F.lit("")).alias("value")).write.partitionBy("fileName").text(out)
    n = files.count_lines(spark, f"{out}/*/*.txt")
    return n.groupBy(F.regexp_extract("file", r"fileName=([^/]+)/", 1).alias("fileName")).agg(F.sum("lines").alias("lines"))


_DOC = """CASE rowId % 5 WHEN 0 THEN '{"interactions": [{"i": ' || rowId || '}, {"i": 2}]}' WHEN 1 THEN '{"moveHistory": [], "row": ' || rowId || '}' WHEN 2 THEN '{"other": ' || rowId || '}' WHEN 3 THEN '{"broken": ' || rowId ELSE '{"moveHistory": []}' END"""


def _documents(spark, sf):
    r = F.col("rowId").cast("string")
    forms = [F.concat(F.lit('{"interactions": [{"i": '), r, F.lit('}, {"i": 2}]}')), F.concat(F.lit('{"moveHistory": [], "row": '), r, F.lit("}")), F.concat(F.lit('{"other": '), r, F.lit("}")), F.concat(F.lit('{"broken": '), r), F.lit('{"moveHistory": []}')]
    d = table(spark, sf, "run_summary", "deck_seed").filter("deck_seed IS NOT NULL").distinct().select(F.col("deck_seed").alias("rowId"))
    out = shared_place(spark, "documents")
    d.select("rowId", F.get(F.array(*forms), (F.col("rowId") % 5).cast("int")).alias("value")).repartition("rowId").write.partitionBy("rowId").text(out)
    return f"{out}/*/*.txt"


_D = f"WITH d AS (SELECT {_DOC} || chr(10) AS doc FROM (SELECT DISTINCT deck_seed AS rowId FROM run_summary WHERE deck_seed IS NOT NULL))"


@query(f"{_D} SELECT DISTINCT sha256(doc) AS sha256, CASE WHEN contains(doc, 'interactions') THEN 'ai_log' WHEN contains(doc, 'moveHistory') THEN 'win_record' ELSE 'unknown' END AS kind FROM d")
def file_kinds(spark, sf):
    """Whole JSON files by content hash and kind; equal contents appear once, broken ones are unknown."""
    return files.scan_documents(spark, _documents(spark, sf)).select("sha256", "kind")


@query(f"{_D} SELECT count(*) * 2 AS items, count(DISTINCT doc) AS files FROM d WHERE contains(doc, 'interactions')")
def file_interactions(spark, sf):
    """Interactions of the log files, one row each."""
    i = files.interactions(files.scan_documents(spark, _documents(spark, sf)))
    return i.agg(F.count("*").alias("items"), F.count_distinct("sha256").alias("files"))


@query("""WITH a AS (SELECT exampleId, CASE WHEN exampleId % 3 = 0 THEN 0 ELSE 1 END AS part FROM sft_examples), o AS (SELECT exampleId, row_number() OVER (PARTITION BY part ORDER BY exampleId) - 1 AS k, part FROM a), f AS (SELECT count(*) AS n FROM a WHERE part = 0) SELECT CAST(CASE WHEN part = 0 THEN k ELSE k + f.n END // 100 AS BIGINT) AS shard, count(*) AS rows FROM o, f GROUP BY 1""")
def published_shards(spark, sf):
    """A third of the examples published, then all: shards of a hundred, the tail filled first, nothing twice."""
    e = table(spark, sf, "sft_examples", "exampleId", "split", "origin")
    out = shared_place(spark, "shards")
    bucket = F.floor(F.col("exampleId") / 1000)
    publish.publish(e.filter("exampleId % 3 = 0"), out, "exampleId", ["exampleId"], bucket, cap=100)
    publish.publish(e.withColumn("extra", F.lit(1)), out, "exampleId", ["exampleId"], bucket, cap=100)
    return publish.publish(e, out, "exampleId", ["exampleId"], bucket, cap=100)


@query("SELECT DISTINCT sessionId, id FROM decision_recs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY rowId) = 1")
def ingested_once(spark, sf):
    """Batches of decisions ingested twice in two orders: every id is stored once, by its first row."""
    d = table(spark, sf, "decision_recs", "rowId", "batchId", "sessionId", "id")
    src, store = shared_place(spark, "batches"), shared_place(spark, "store")
    first = d.filter("id IS NOT NULL").groupBy("id").agg(F.min("rowId").alias("rowId")).join(d.drop("id"), "rowId").select("sessionId", "id")
    first.repartition(3).write.parquet(src)
    for _ in range(2):
        logs.ingest_batches(spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(src), store, "id")
    return spark.read.parquet(store)


@query("""SELECT 'C' || deck_seed % 2 AS arm, CAST(deck_seed AS VARCHAR) AS state, 'run1' AS run, CAST(deck_seed % 7 AS INT) AS tier, 'answer ' || deck_seed AS response FROM (SELECT DISTINCT deck_seed FROM run_summary WHERE deck_seed IS NOT NULL)""")
def scored_answers(spark, sf):
    """Scored and raw answers read from their files, arm, state and run from the paths."""
    out = shared_place(spark, "scored")
    seed = F.col("deck_seed")
    folder = F.concat(F.lit("C"), (seed % 2).cast("string"), F.lit("/"), seed.cast("string"), F.lit("/run1"))
    s = table(spark, sf, "run_summary", "deck_seed").filter("deck_seed IS NOT NULL").distinct()
    texts = [(".scored.json", F.concat(F.lit('{"tier_score": '), (seed % 7).cast("string"), F.lit("}"))), (".response.txt", F.concat(F.lit("answer "), seed.cast("string")))]
    both = F.inline(F.array(*[F.struct(F.concat(folder, F.lit(end)).alias("path"), text.alias("value")) for end, text in texts]))
    files.write_texts(s.select(both), out)
    a = files.load_scored(spark, out).select("arm", "state", "run", F.try_variant_get("doc", "$.tier_score", "int").alias("tier"))
    b = files.scan_responses(spark, out).select("state", "response")
    return a.join(b, "state").select("arm", "state", "run", "tier", "response")


@query("""SELECT rowId, CASE WHEN rowId % 3 = 0 THEN NULL ELSE 'thought ' || rowId END AS "thinkingText", CASE WHEN rowId % 3 = 1 THEN '9' ELSE CAST(rowId % 5 AS VARCHAR) END AS "moveIndex", CASE WHEN rowId % 3 = 2 THEN '0.5' END AS confidence FROM decision_recs""")
def decision_records(spark, sf):
    """Decision records put together: the thinking is lifted out of the meta, whose other keys win over the decision's."""
    from ..operators.documents import decision_record

    r = F.col("rowId")
    s = lambda c: c.cast("string")
    decision = F.create_map(F.lit("moveIndex"), s(r % 5), F.lit("chosenKind"), F.lit("draw"))
    meta = F.when(r % 3 == 0, F.create_map().cast("map<string,string>")).when(r % 3 == 1, F.create_map(F.lit("thinkingText"), F.concat(F.lit("thought "), s(r)), F.lit("moveIndex"), F.lit("9"))).otherwise(F.create_map(F.lit("thinkingText"), F.concat(F.lit("thought "), s(r)), F.lit("confidence"), F.lit("0.5")))
    d, think = decision_record(decision, meta)
    return table(spark, sf, "decision_recs", "rowId").select("rowId", think.alias("thinkingText"), F.try_element_at(d, F.lit("moveIndex")).alias("moveIndex"), F.try_element_at(d, F.lit("confidence")).alias("confidence"))


@query("""SELECT rowId, rowId % 3 = 0 AS enabled, CASE WHEN rowId % 3 = 0 THEN rowId % 4 END AS move_count FROM decision_recs""")
def play_logs(spark, sf):
    """Play logs written and read back; a log that was not enabled is a stub."""
    from ..operators.documents import play_log, play_log_document

    r = F.col("rowId")
    moves = F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= r % 4), lambda i: F.struct(i.cast("double").alias("timestamp"), F.lit("draw").alias("move")))
    doc = play_log_document(r % 3 == 0, F.create_map(F.lit("player"), F.lit("p")), F.struct(F.lit(0).alias("score")), moves, F.lit("2026-01-01T00:00:00+00:00"))
    d = table(spark, sf, "decision_recs", "rowId").select("rowId", play_log(doc).alias("l"))
    return d.select("rowId", "l.enabled", F.col("l.move_count").cast("bigint").alias("move_count"))
