"""Queries of projections, selections, comparisons by row, reports and samplings over decisions and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..operators import decisions as dec
from ..operators import reports
from ..operators import sampling
from ..operators import turnwindows as tw
from ..operators.runs import leaderboard
from ..session import table
from .relational import _STALLED, ORDER, TEACHER, TIER, T, _stalls, played

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_V = "CASE WHEN json_valid(d.decision) THEN d.decision ELSE '{}' END"


def lean_decisions(spark, sf: str) -> DataFrame:
    """The lean row of every successful decision that says something: 26 columns, tagged with the reasons against it."""
    st = _stalls(spark, sf).select("rowId", "fc", "fd", "flat", "stalled")
    d = table(spark, sf, "decision_recs", "rowId", "id", "sessionId", "timestamp", "turnIndex", "model", "provider", "appCommit", "outcome", "prompt", "decision", "thinkingText")
    v = pr.strict_json(F.col("decision"))
    said = F.coalesce(F.json_object_keys("decision"), F.array().cast("array<string>"))
    d = d.filter("outcome = 'success'").withColumn("v", v).filter(F.schema_of_variant("v").startswith("OBJECT") & (F.size(said) > 0))
    d = d.join(st, "rowId", "left").withColumn("legal", F.from_json("prompt", dec.PROMPT)["legalMoves"])
    i = pr._int(F.col("v"), "$.moveIndex")
    why = dec.exclude_reasons(dec.schema_tier(), F.col("model"), TEACHER, F.col("stalled"))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    pick = F.get("legal", F.when(i >= 0, i))
    return d.select(
        "rowId", "id", "sessionId", "timestamp", "turnIndex", "model", "provider", "appCommit", dec.schema_tier().alias("schemaTier"), (F.size(why) == 0).alias("trainingEligible"), why.alias("excludeReasons"), i.alias("moveIndex"),
        pick["kind"].alias("chosenMoveType"), pick["description"].alias("chosenMoveDescribe"), F.size(F.coalesce("legal", F.array().cast("array<struct<index:int,kind:string,description:string>>"))).alias("nLegalMoves"), dec.confidence_number(F.col("v")).alias("confidence"), pr._int(F.col("v"), "$.alternativeMoveIndex").alias("alternativeMoveIndex"),
        F.when(F.col("fc").isNotNull(), F.round(F.col("fc") / 52 * 100).cast("int")).alias("completionProgress"), F.lit(None).cast("int").alias("moveCount"), F.lit(None).cast("int").alias("perceivedDifficulty"), F.col("fc").alias("foundationCards"), F.col("fd").alias("faceDownTotal"), dec.progress_score(F.col("fc"), F.col("fd")).alias("progressScore"),
        F.col("flat").alias("turnsSinceProgress"), "thinkingText", text("boardAnalysis").alias("boardAnalysis"), text("reasoning").alias("reasoning"),
    )


@query(f"""WITH {T}, {_STALLED}, d AS (SELECT * FROM decision_recs WHERE outcome = 'success' AND CASE WHEN json_valid(decision) THEN json_type(decision) = 'OBJECT' AND len(json_keys(decision)) > 0 ELSE false END),
x AS (SELECT d.rowId, {TIER.replace('turn IS', 'd.turnIndex IS').replace("coalesce(id", "coalesce(d.id").replace("coalesce(sessionId", "coalesce(d.sessionId").replace("coalesce(appCommit", "coalesce(d.appCommit")} AS tier, d.model, st.stalled, st.fc, st.fd, st.flat, d.prompt, d.decision, CASE WHEN json_type(d.decision, '$.moveIndex') IN ('UBIGINT', 'BIGINT') THEN CAST(d.decision->>'$.moveIndex' AS INT) END AS i FROM d LEFT JOIN st ON st.rowId = d.rowId)
SELECT rowId, tier AS "schemaTier", tier = 'current' AND coalesce(model, '') = '{TEACHER}' AND NOT coalesce(stalled, false) AS "trainingEligible", i AS "moveIndex", CASE WHEN i >= 0 THEN prompt->>('$.legalMoves[' || i || '].kind') END AS "chosenMoveType", CASE WHEN i >= 0 THEN prompt->>('$.legalMoves[' || i || '].description') END AS "chosenMoveDescribe",
 CAST(coalesce(json_array_length(prompt, '$.legalMoves'), 0) AS INT) AS "nLegalMoves", CASE WHEN json_type(decision, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(decision->>'$.confidence' AS DOUBLE) END AS confidence, fc AS "foundationCards", fd AS "faceDownTotal", (0.65::DOUBLE * fc / 52 + 0.35::DOUBLE * (21 - fd) / 21) * 100 AS "progressScore", flat AS "turnsSinceProgress", decision->>'$.reasoning' AS reasoning FROM x""")
def derived_decisions(spark, sf):
    """The lean rows, without the columns that are taken over as they are."""
    return lean_decisions(spark, sf).select("rowId", "schemaTier", "trainingEligible", "moveIndex", "chosenMoveType", "chosenMoveDescribe", "nLegalMoves", "confidence", "foundationCards", "faceDownTotal", "progressScore", "turnsSinceProgress", "reasoning")


@query("""WITH s AS (SELECT DISTINCT sessionId FROM decision_recs WHERE sessionId LIKE '%a1%') SELECT d.sessionId, d.turnIndex, d.rowId, 'LLM' AS labeller FROM decision_recs d JOIN s ON d.sessionId = s.sessionId WHERE d.outcome = 'success' AND CASE WHEN json_valid(decision) THEN json_type(decision) = 'OBJECT' AND len(json_keys(decision)) > 0 ELSE false END""")
def session_rows(spark, sf):
    """Training records of the sessions whose id contains a text."""
    return lean_decisions(spark, sf).filter(F.contains("sessionId", F.lit("a1"))).select("sessionId", "turnIndex", "rowId", F.lit("LLM").alias("labeller"))


@query("""WITH won AS (SELECT DISTINCT sessionId FROM run_summary WHERE outcome = 'won' AND sessionId IS NOT NULL), held AS (SELECT DISTINCT deck_seed FROM run_summary WHERE deck_seed % 7 = 0 UNION SELECT DISTINCT seed FROM sft_examples WHERE split = 'test' AND seed <> 0)
SELECT d.rowId FROM decision_recs d WHERE d.sessionId IN (SELECT sessionId FROM won) AND (d.seed IS NULL OR d.seed = 0 OR d.seed NOT IN (SELECT deck_seed FROM held WHERE deck_seed IS NOT NULL))""")
def won_with_holdout(spark, sf):
    """Decisions of won sessions but for held-out seeds, which come from two sources; rows without a seed stay."""
    d = table(spark, sf, "decision_recs", "rowId", "sessionId", "seed")
    won = table(spark, sf, "run_summary", "sessionId", "outcome").filter("outcome = 'won' AND sessionId IS NOT NULL").select("sessionId").distinct()
    held = table(spark, sf, "run_summary", "deck_seed").filter("deck_seed % 7 = 0").select(F.col("deck_seed").alias("seed")).union(table(spark, sf, "sft_examples", "split", "seed").filter("split = 'test' AND seed <> 0").select("seed")).distinct()
    return d.join(won, "sessionId", "left_semi").join(held.withColumn("out", F.lit(True)), "seed", "left").filter("out IS NULL OR seed = 0").select("rowId")


# ---------------------------------------------------------------- comparisons
@query("""SELECT rowId, CASE rowId % 5 WHEN 3 THEN 'differs' WHEN 4 THEN 'only_got' ELSE 'same' END AS state FROM decision_recs WHERE rowId % 6 > 0 UNION ALL SELECT rowId, 'only_ref' FROM decision_recs WHERE rowId % 6 = 0 AND rowId % 5 <> 4""")
def rows_compared(spark, sf):
    """Documents of two sides by id, field for field, once nulls and empty containers are left out."""
    r = F.col("rowId").cast("string")
    d = table(spark, sf, "decision_recs", "rowId")
    ref = d.filter("rowId % 5 <> 4").select("rowId", F.concat(F.lit('{"a": '), r, F.lit(', "b": {"c": [1, null], "d": "x"}}')).alias("doc"))
    k = F.col("rowId") % 5
    got = F.when(k == 0, F.concat(F.lit('{"a": '), r, F.lit(', "b": {"c": [1, null], "d": "x", "e": null}, "f": {}}'))).when(k == 1, F.concat(F.lit('{"b": {"d": "x", "c": [1, null]}, "g": [], "a": '), r, F.lit("}"))).when(k == 2, F.concat(F.lit('{"a": '), r, F.lit(', "b": {"c": [1, null], "d": "x", "h": {"i": null}}}'))).otherwise(F.concat(F.lit('{"a": '), r, F.lit(', "b": {"c": [1], "d": "x"}}')))
    return reports.compare_rows(ref, d.filter("rowId % 6 > 0").select("rowId", got.alias("doc")), "rowId", "doc")


@query("""WITH k AS (SELECT rowId, json_keys(prompt) AS a, CASE WHEN json_valid(decision) THEN CASE WHEN json_type(decision) = 'OBJECT' THEN json_keys(decision) END END AS b FROM decision_recs WHERE prompt IS NOT NULL) SELECT rowId, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INT) AS only_a, CAST(len(list_filter(b, lambda x: NOT list_contains(a, x))) AS INT) AS only_b FROM k WHERE b IS NOT NULL""")
def key_differences(spark, sf):
    """Keys that only one of two documents has."""
    d = table(spark, sf, "decision_recs", "rowId", "prompt", "decision").filter("prompt IS NOT NULL")
    a, b = F.json_object_keys("prompt"), F.when(F.schema_of_variant(pr.strict_json(F.col("decision"))).startswith("OBJECT"), F.json_object_keys("decision"))
    return d.select("rowId", a.alias("a"), b.alias("b")).filter("b IS NOT NULL").select("rowId", F.size(F.array_except("a", "b")).alias("only_a"), F.size(F.array_except("b", "a")).alias("only_b"))


@query("""WITH t AS (SELECT prompt, max(exampleId) AS exampleId FROM sft_examples WHERE split = 'train' GROUP BY prompt), e AS (SELECT e.exampleId, t.exampleId AS trainId FROM sft_examples e LEFT JOIN t ON e.prompt = t.prompt WHERE e.split <> 'train') SELECT count(*) AS n, count(trainId) AS matched, count(*) - count(trainId) AS unmatched FROM e""")
def prompt_matches(spark, sf):
    """A left join by the whole prompt text; rows without a partner are counted."""
    e = table(spark, sf, "sft_examples", "exampleId", "split", "prompt").withColumn("h", F.sha2("prompt", 256))
    t = e.filter("split = 'train'").groupBy("h", "prompt").agg(F.max("exampleId").alias("trainId"))
    j = e.filter("split <> 'train'").join(t, ["h", "prompt"], "left")
    return j.agg(F.count("*").alias("n"), F.count("trainId").alias("matched"), F.count_if(F.col("trainId").isNull()).alias("unmatched"))


@query("""WITH k AS (SELECT DISTINCT deck_seed AS seed, sessionId FROM run_summary), d AS (SELECT coalesce(CAST(seed AS VARCHAR), sessionId) AS key FROM k WHERE seed IS NOT NULL OR sessionId IS NOT NULL), n AS (SELECT key, count(*) AS copies FROM d GROUP BY key), c AS (SELECT CAST(deck_seed AS VARCHAR) AS key, max(final_foundation_cards) AS known FROM run_summary WHERE deck_seed % 3 = 0 GROUP BY 1) SELECT n.key, n.copies, c.known FROM n LEFT JOIN c ON n.key = c.key""")
def decks_with_outcomes(spark, sf):
    """Decks once each by seed, else by source, with the outcome carried over from an earlier table."""
    r = table(spark, sf, "run_summary", "deck_seed", "sessionId", "final_foundation_cards")
    key = F.coalesce(F.col("deck_seed").cast("string"), F.col("sessionId"))
    d = r.select("deck_seed", "sessionId").distinct().select(key.alias("key")).filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"))
    c = r.filter("deck_seed % 3 = 0").groupBy(F.col("deck_seed").cast("string").alias("key")).agg(F.max("final_foundation_cards").alias("known"))
    return d.join(c, "key", "left")


# ---------------------------------------------------------------- walks
@query(f"""WITH RECURSIVE {T}, o AS MATERIALIZED (SELECT sessionId, turn, fc, row_number() OVER (PARTITION BY sessionId ORDER BY turn, rowId) AS k FROM u WHERE fc IS NOT NULL),
g AS (SELECT sessionId, k, turn, fc FROM o WHERE k = (SELECT min(k) FROM o p WHERE p.sessionId = o.sessionId AND p.turn >= 0) UNION ALL SELECT g.sessionId, n.k, n.turn, n.fc FROM g, LATERAL (SELECT o.k, o.turn, o.fc FROM o WHERE o.sessionId = g.sessionId AND o.k > g.k AND o.turn - g.turn >= 10 ORDER BY o.k LIMIT 1) n),
l AS (SELECT sessionId, max(k) AS k FROM o GROUP BY sessionId) SELECT sessionId, turn, fc FROM g UNION ALL SELECT o.sessionId, o.turn, o.fc FROM o JOIN l ON o.sessionId = l.sessionId AND o.k = l.k WHERE o.turn <> (SELECT max(turn) FROM g WHERE g.sessionId = o.sessionId)""")
def foundation_trajectory(spark, sf):
    """Foundation counts every ten turns or more, and the last one."""
    return tw.trajectory(played(spark, sf).filter("fc IS NOT NULL"), ORDER, "turn", "fc", 10)


@query(f"""WITH {T}, f AS (SELECT *, row_number() OVER (PARTITION BY sessionId, chosen ORDER BY turn, rowId) = 1 AND chosen IS NOT NULL AS new FROM u) SELECT rowId, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY sessionId ORDER BY turn, rowId) AS BIGINT) AS ever_seen FROM f""")
def ever_seen(spark, sf):
    """How many different actions a session has seen up to each turn."""
    return tw.seen_so_far(played(spark, sf), ORDER, "chosen", "ever_seen").select("rowId", "ever_seen")


@query(f"""WITH RECURSIVE {T}, o AS (SELECT sessionId, turn, row_number() OVER (PARTITION BY sessionId ORDER BY turn, rowId) AS k FROM u),
g AS (SELECT sessionId, k, turn FROM o WHERE k = 1 UNION ALL SELECT g.sessionId, n.k, n.turn FROM g, LATERAL (SELECT o.k, o.turn FROM o WHERE o.sessionId = g.sessionId AND o.k > g.k AND o.turn - g.turn >= 4 ORDER BY o.k LIMIT 1) n)
SELECT sessionId, turn FROM g ORDER BY sessionId, turn LIMIT 40""")
def spaced_first(spark, sf):
    """The first forty spaced turns over all sessions in order (the limit is the operator's)."""
    return tw.spaced(played(spark, sf), ORDER, "turn", 4).orderBy("sessionId", "turn").limit(40)


@query("""WITH s AS (SELECT DISTINCT sessionId FROM decision_recs WHERE sessionId <> ''), o AS (SELECT sessionId, row_number() OVER (ORDER BY sha256('5:' || sessionId), sessionId) AS k, count(*) OVER () AS n FROM s) SELECT sessionId, CASE WHEN k <= greatest(1, CAST(floor(n * 0.15) AS INT)) THEN 'valid' ELSE 'train' END AS split FROM o""")
def session_split(spark, sf):
    """Whole sessions into a validation part of at least one session, the rest into training."""
    s = table(spark, sf, "decision_recs", "sessionId").filter("sessionId <> ''").distinct()
    return sampling.valid_groups(s, "sessionId", 0.15, seed=5)


@query("SELECT model_id, list_sort(list(deck_seed) FILTER (WHERE outcome = 'won')) AS won, list_sort(list(deck_seed) FILTER (WHERE outcome <> 'won')) AS lost FROM (SELECT DISTINCT model_id, deck_seed, outcome FROM run_summary WHERE model_id IS NOT NULL AND deck_seed IS NOT NULL AND outcome IS NOT NULL) GROUP BY model_id")
def won_and_lost(spark, sf):
    """Decks each model won and lost."""
    r = table(spark, sf, "run_summary", "model_id", "deck_seed", "outcome").filter("model_id IS NOT NULL AND deck_seed IS NOT NULL AND outcome IS NOT NULL").distinct()
    lists = lambda c: F.nullif(F.array_sort(F.collect_list(F.when(c, F.col("deck_seed")))), F.array().cast("array<bigint>"))
    return r.groupBy("model_id").agg(lists(F.col("outcome") == "won").alias("won"), lists(F.col("outcome") != "won").alias("lost"))


@query("""SELECT CASE WHEN rowId % 4 = 0 THEN 'message ' || rowId % 3 WHEN rowId % 4 = 1 THEN 'kind' WHEN rowId % 4 = 2 THEN 'httpStatus=' || (500 + rowId % 2) ELSE 'httpStatus=None' END AS error, count(*) AS n FROM decision_recs WHERE outcome IS DISTINCT FROM 'success' GROUP BY 1""")
def error_causes(spark, sf):
    """Failures by message, else kind, else status; blank ones count as missing."""
    r = F.col("rowId")
    d = table(spark, sf, "decision_recs", "rowId", "outcome").filter(~F.coalesce(F.col("outcome") == "success", F.lit(False)))
    d = d.select(F.when(r % 4 == 0, F.concat(F.lit("message "), (r % 3).cast("string"))).otherwise("").alias("errorMessage"), F.when(r % 4 == 1, F.lit("kind")).alias("errorKind"), F.when(r % 4 == 2, 500 + r % 2).alias("httpStatus"))
    return reports.error_counts(d)


@query("""WITH e AS (SELECT count(*) FILTER (WHERE event = 'game_started') AS started, count(*) FILTER (WHERE event = 'game_ended') AS ended, count(DISTINCT session_id) FILTER (WHERE event = 'game_started') AS seen FROM server_log), d AS (SELECT count(*) AS decisions, count(DISTINCT coalesce(nullif(model, ''), '(none)')) AS models FROM decision_recs),
a AS (SELECT count(DISTINCT session_id) AS active FROM server_log s WHERE event = 'game_started' AND NOT EXISTS (SELECT 1 FROM server_log x WHERE x.session_id = s.session_id AND x.event IN ('game_ended', 'game_abandoned'))) SELECT started, ended, decisions, models, active FROM e, d, a""")
def combined_analytics(spark, sf):
    """Events, decisions and open sessions in one row."""
    from ..operators.events import summary

    log = table(spark, sf, "server_log")
    d = table(spark, sf, "decision_recs", "model").agg(F.count("*").alias("decisions"), F.count_distinct(dec.named("model")).alias("models"))
    over = log.filter("event IN ('game_ended', 'game_abandoned')").select("session_id").distinct()
    active = log.filter("event = 'game_started'").select("session_id").distinct().join(over, "session_id", "left_anti").agg(F.count("session_id").alias("active"))
    rows = summary(log).select("started", "ended")
    for other in (d, active):
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


# ---------------------------------------------------------------- reports
@query(f"""WITH {T}, {_STALLED}, f AS (SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'success') AS ok, count(*) FILTER (WHERE outcome = 'success' AND {TIER} = 'current') AS cur FROM st),
m AS (SELECT '| ' || {TIER} || ' | ' || count(*) || ' | ' || count(*) FILTER (WHERE outcome = 'success') || ' |' AS line FROM st GROUP BY {TIER}) SELECT '- Decisions: **' || total || '**' AS line FROM f UNION ALL SELECT '- Success: **' || ok || '**' FROM f UNION ALL SELECT '- Current schema: **' || cur || '**' FROM f UNION ALL SELECT line FROM m""")
def summary_report(spark, sf):
    """The main lines of the Markdown summary."""
    lines = reports.summary_lines(_stalls(spark, sf).withColumnRenamed("turn", "turnIndex"))
    return lines.select("line")


@query("SELECT '| ' || model_id || ' | ' || count(*) || ' | ' || count(*) FILTER (WHERE outcome = 'won') || ' | ' || max(final_foundation_cards) || ' |' AS line FROM (SELECT DISTINCT * FROM run_summary) WHERE model_id IS NOT NULL GROUP BY model_id")
def leaderboard_table(spark, sf):
    """The leaderboard as lines of a text table."""
    g = leaderboard(table(spark, sf, "run_summary").distinct().filter("model_id IS NOT NULL"), "model_id", "final_foundation_cards", "outcome")
    return reports.table_lines(g.select("model", "n", "wins", "max_fc"), "model")


@query("SELECT deck_seed AS state, a.arm, left(sha256('prompt ' || deck_seed || ' ' || a.arm), 16) AS prompt_hash, length('prompt ' || deck_seed || ' ' || a.arm) AS chars FROM (SELECT DISTINCT deck_seed FROM run_summary WHERE deck_seed IS NOT NULL), (VALUES ('plain'), ('hoisted')) a(arm)")
def render_manifest(spark, sf):
    """Rendered prompts of every state and arm: hash and length, as their manifest."""
    from ..operators.documents import cross_arms

    s = table(spark, sf, "run_summary", "deck_seed").filter("deck_seed IS NOT NULL").distinct().select(F.col("deck_seed").alias("state"))
    d = cross_arms(s, ["plain", "hoisted"], 1).drop("run")
    return reports.manifest_of(d, F.concat_ws(" ", F.lit("prompt"), F.col("state").cast("string"), "arm"))
