"""Queries of the parsing functions, over decision answers, completions and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, prompts
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT exampleId, CASE WHEN json_valid(completion) AND json_type(completion, '$.moveIndex') IN ('UBIGINT', 'BIGINT') THEN TRY_CAST(completion->>'$.moveIndex' AS INT) END AS idx FROM sft_examples")
def completion_index(spark, sf):
    return table(spark, sf, "sft_examples", "exampleId", "completion").select("exampleId", prompts.move_index(F.col("completion"), ("$.moveIndex",)).alias("idx"))


@query("SELECT rowId, trim(regexp_replace(regexp_replace('```json' || chr(10) || decision || chr(10) || '```', '^```[^\\n]*\\n', ''), '\\n?```\\s*$', '')) AS bare FROM decision_recs")
def fence_strip(spark, sf):
    fenced = F.concat(F.lit("```json\n"), "decision", F.lit("\n```"))
    return table(spark, sf, "decision_recs", "rowId", "decision").select("rowId", parsing.strip_code_fence(fenced).alias("bare"))


@query("""WITH c AS (SELECT rowId, CASE WHEN json_valid(decision) THEN decision->>'$.confidence' END AS c FROM decision_recs) SELECT rowId, CASE WHEN regexp_matches(c, '^\\s*\\d+(\\.\\d+)?\\s*%\\s*$') THEN CAST(regexp_extract(c, '\\d+(\\.\\d+)?') AS DOUBLE) / 100 ELSE TRY_CAST(c AS DOUBLE) END AS confidence FROM c""")
def confidence_values(spark, sf):
    return table(spark, sf, "decision_recs", "rowId", "decision").select("rowId", parsing.confidence(F.try_parse_json("decision")).alias("confidence"))


@query("SELECT source, count(*) AS n, CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K' WHEN count(*) < 1000000 THEN '100K<n<1M' ELSE 'n>1M' END AS size FROM documents GROUP BY source")
def size_categories(spark, sf):
    g = table(spark, sf, "documents", "source").groupBy("source").agg(F.count("*").alias("n"))
    return g.withColumn("size", parsing.size_category(F.col("n")))


@query("""WITH v AS (SELECT vec_id, -abs(embedding[1]::DOUBLE) - 0.01 AS c, -abs(embedding[2]::DOUBLE) - 0.01 AS r FROM embeddings), l AS (SELECT vec_id, c, (c - CASE WHEN c > -0.6931471805599453 THEN ln(-(exp(c) - 1)) ELSE ln(1 - exp(c)) END) - (r - CASE WHEN r > -0.6931471805599453 THEN ln(-(exp(r) - 1)) ELSE ln(1 - exp(r)) END) AS o FROM v)
SELECT vec_id, round(-c + 0.1 * (ln(1 + exp(-abs(o))) + greatest(-o, 0)), 6) AS loss FROM l""")
def preference_loss(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    lp = lambda i: -F.abs(F.get("embedding", F.lit(i)).cast("double")) - 0.01
    return e.select("vec_id", F.round(parsing.odds_ratio_loss(lp(0), lp(1), 0.1), 6).alias("loss"))


@query("""SELECT rowId, sha256(concat_ws('|', prompt->>'$.observation.foundations', prompt->>'$.observation.tableau', prompt->>'$.observation.waste', prompt->>'$.observation.stock')) IS NOT NULL AS has_key, sha256(prompt) AS prompt_hash FROM decision_recs""")
def prompt_hashes(spark, sf):
    d = table(spark, sf, "decision_recs", "rowId", "prompt")
    return d.select("rowId", F.get_json_object("prompt", "$.observation").isNotNull().alias("has_key"), F.sha2("prompt", 256).alias("prompt_hash"))


@query("""SELECT e.exampleId, t.exampleId AS trainId FROM sft_examples e JOIN (SELECT prompt, max(exampleId) AS exampleId FROM sft_examples WHERE split = 'train' GROUP BY prompt) t ON e.prompt = t.prompt WHERE e.split <> 'train'""")
def prompt_text_join(spark, sf):
    """Left rows by the whole prompt text: joined on its hash, checked on the text; the last duplicate wins."""
    e = table(spark, sf, "sft_examples", "exampleId", "split", "prompt").withColumn("h", F.sha2("prompt", 256))
    t = e.filter("split = 'train'").groupBy("h").agg(F.max("exampleId").alias("trainId"), F.max("prompt").alias("p"))
    return e.filter("split <> 'train'").join(t, "h").filter("prompt = p").select("exampleId", "trainId")
