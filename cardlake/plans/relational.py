"""Queries of the relational operators over decisions, server events, run summaries, manifests and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..operators import turnwindows as tw
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_DEC = ("rowId", "id", "sessionId", "turnIndex", "timestamp", "outcome", "model", "agentId", "seed", "schemaTier", "appCommit", "drawCount", "prompt", "decision")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return dec.turns(table(spark, sf, "decision_recs", *_DEC))


def played(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that have a session and a number."""
    return turns(spark, sf).filter("sessionId <> '' AND turn IS NOT NULL")


ORDER = ["turn", "rowId"]
T = """t AS (SELECT rowId, id, sessionId, turnIndex AS turn, "timestamp" AS ts, outcome, model, agentId, seed, schemaTier, appCommit, drawCount,
 CAST(prompt->>'$.observation.foundations.H' AS INT) + CAST(prompt->>'$.observation.foundations.D' AS INT) + CAST(prompt->>'$.observation.foundations.C' AS INT) + CAST(prompt->>'$.observation.foundations.S' AS INT) AS fc,
 CAST(list_sum(CAST(json_extract_string(prompt, '$.observation.tableau[*].faceDownCount') AS INT[])) AS INT) AS fd,
 CAST(prompt->>'$.observation.stock' AS INT) AS stock, CAST(json_array_length(prompt, '$.legalMoves') AS INT) AS legal,
 CASE WHEN json_valid(decision) THEN TRY_CAST(decision->>'$.moveIndex' AS INT) END AS moveIndex, CASE WHEN json_valid(decision) THEN decision->>'$.chosenKind' END AS kind,
 CASE WHEN json_valid(decision) THEN decision->>'$.chosenDescribe' END AS chosen, prompt, decision FROM decision_recs),
u AS (SELECT * FROM t WHERE sessionId <> '' AND turn IS NOT NULL)"""
TIER = "CASE WHEN coalesce(id <> '', false) AND coalesce(sessionId <> '', false) AND coalesce(appCommit <> '', false) AND turn IS NOT NULL THEN 'current' ELSE 'legacy' END"
TEACHER = "quillo-4b"
STALL = 25
_STALLED = f"""ok AS (SELECT *, coalesce(sessionId, '') AS ses, coalesce(turn, 0) AS pos FROM t WHERE fc IS NOT NULL AND fd IS NOT NULL),
c AS (SELECT *, CASE WHEN fc = lag(fc) OVER w AND fd = lag(fd) OVER w THEN 0 ELSE 1 END AS chg FROM ok WINDOW w AS (PARTITION BY ses ORDER BY pos, rowId)),
i AS (SELECT *, sum(chg) OVER (PARTITION BY ses ORDER BY pos, rowId) AS isl FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY ses, isl ORDER BY pos, rowId) - 1 AS flat FROM i),
st AS (SELECT t.*, s.flat, coalesce(s.flat >= {STALL}, false) AS stalled FROM t LEFT JOIN s ON t.rowId = s.rowId)"""


def _stalls(spark, sf):
    """All decisions; rows without a session share one, a missing turn stands first."""
    d = turns(spark, sf).withColumn("__ses", F.coalesce("sessionId", F.lit(""))).withColumn("__pos", F.coalesce("turn", F.lit(0)))
    return tw.stalls(d, ["__pos", "rowId"], STALL, session="__ses").drop("__ses", "__pos")


# --- windows over turns -------------------------------------------------------------------------------------------


@query(f"WITH {T}, {_STALLED} SELECT rowId, sessionId, turn, fc, fd, flat, stalled FROM st")
def stall_annotation(spark, sf):
    return _stalls(spark, sf).select("rowId", "sessionId", "turn", "fc", "fd", "flat", "stalled")


@query(f"""WITH {T}, r AS (SELECT *, CASE WHEN kind = 'recycle' THEN 1 ELSE 0 END AS r FROM u), i AS (SELECT *, sum(r) OVER (PARTITION BY sessionId ORDER BY turn, rowId) AS isl FROM r)
SELECT rowId, sessionId, turn, row_number() OVER (PARTITION BY sessionId, isl ORDER BY turn, rowId) - CASE WHEN isl > 0 THEN 1 ELSE 0 END AS since_recycle FROM i""")
def since_recycle(spark, sf):
    return tw.since_reset(played(spark, sf), ORDER, F.col("kind") == "recycle", "since_recycle").select("rowId", "sessionId", "turn", "since_recycle")


@query(f"""WITH {T} SELECT rowId, sessionId, turn, row_number() OVER (PARTITION BY sessionId, concat_ws('|', fc, fd, stock) ORDER BY turn, rowId) - 1 AS seen_before FROM u""")
def position_repeat(spark, sf):
    return tw.repeats(played(spark, sf), ORDER, F.concat_ws("|", "fc", "fd", "stock")).select("rowId", "sessionId", "turn", "seen_before")


@query(f"""WITH {T}, d AS (SELECT rowId, lead(1) OVER w AS n, lead(coalesce(fc, 0)) OVER w - coalesce(fc, 0) AS d_fc, lead(coalesce(fd, 0)) OVER w - coalesce(fd, 0) AS d_fd
FROM u WINDOW w AS (PARTITION BY sessionId ORDER BY turn, rowId)) SELECT rowId, d_fc, d_fd FROM d WHERE n IS NOT NULL""")
def next_turn_delta(spark, sf):
    return tw.next_delta(played(spark, sf), ORDER, ["fc", "fd"]).select("rowId", "d_fc", "d_fd")


@query(f"""WITH {T}, d AS (SELECT rowId, model, lead(coalesce(fc, 0)) OVER w - coalesce(fc, 0) AS d_fc, lead(coalesce(fd, 0)) OVER w - coalesce(fd, 0) AS d_fd
FROM u WINDOW w AS (PARTITION BY sessionId ORDER BY turn, rowId)) SELECT rowId, model FROM d WHERE d_fc > 0 OR d_fd < 0""")
def quality_moves(spark, sf):
    """Moves after which a card went up or a card was turned."""
    return tw.next_delta(played(spark, sf), ORDER, ["fc", "fd"]).filter("d_fc > 0 OR d_fd < 0").select("rowId", "model")


@query(f"""WITH {T}, m AS (SELECT *, max(coalesce(fc, 0)) OVER (PARTITION BY sessionId) AS peak FROM u) SELECT rowId, sessionId, turn, peak FROM m WHERE peak >= 20""")
def winning_trajectories(spark, sf):
    """All turns of sessions whose foundation peak reaches 20 cards; the peak is a group aggregate joined back."""
    u = played(spark, sf).select("rowId", "sessionId", "turn", "fc")
    peak = u.groupBy("sessionId").agg(F.max(F.coalesce("fc", F.lit(0))).alias("peak")).filter("peak >= 20")
    return u.join(peak, "sessionId").select("rowId", "sessionId", "turn", "peak")


@query(f"""WITH {T}, d AS (SELECT * FROM u WHERE fc IS NOT NULL), c AS (SELECT *, CASE WHEN fc = lag(fc) OVER w THEN 0 ELSE 1 END AS chg FROM d WINDOW w AS (PARTITION BY sessionId ORDER BY turn, rowId)),
i AS (SELECT *, sum(chg) OVER (PARTITION BY sessionId ORDER BY turn, rowId) AS isl FROM c),
g AS (SELECT sessionId, isl, min(turn) AS "start", max(turn) AS "end", min(fc) AS fc FROM i GROUP BY sessionId, isl),
l AS (SELECT *, coalesce(lead("start") OVER (PARTITION BY sessionId ORDER BY isl) - "start", "end" - "start" + 1) AS length FROM g)
SELECT sessionId, fc, "start", "end", length FROM l WHERE length >= 10""")
def plateau_windows(spark, sf):
    return tw.plateaus(played(spark, sf), ORDER, "fc", 10)


@query(f"""WITH {T}, x AS (SELECT sessionId, fc, row_number() OVER (PARTITION BY sessionId ORDER BY turn, rowId) - 1 AS x, last_value(fc) OVER (PARTITION BY sessionId ORDER BY turn, rowId ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM u WHERE fc IS NOT NULL)
SELECT sessionId, coalesce(max(CASE WHEN fc <> l THEN x END) + 1, 0) AS onset FROM x GROUP BY sessionId""")
def loop_onset(spark, sf):
    return tw.loop_onset(played(spark, sf), ORDER, "fc")


@query(f"WITH {T} SELECT sessionId, greatest(0, max(fc)) AS best FROM u GROUP BY sessionId")
def max_foundation(spark, sf):
    return played(spark, sf).groupBy("sessionId").agg(F.greatest(F.lit(0), F.max("fc")).alias("best"))


@query(f"""WITH {T} SELECT rowId, array_to_string(list(chosen) FILTER (WHERE chosen IS NOT NULL) OVER (PARTITION BY sessionId ORDER BY turn, rowId ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ' / ') AS recent FROM u""")
def recent_moves(spark, sf):
    r = tw.recent(played(spark, sf), ORDER, "chosen", 10, "r")
    return r.select("rowId", F.when(F.size("r") > 0, F.array_join("r", " / ")).alias("recent"))


@query(f"""WITH {T} SELECT rowId, 1 + coalesce(sum(CASE WHEN kind = 'recycle' THEN 1 ELSE 0 END) OVER (PARTITION BY sessionId ORDER BY turn, rowId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cycle FROM u""")
def cycle_counter(spark, sf):
    w = tw.session_window(ORDER).rowsBetween(W.unboundedPreceding, -1)
    n = F.coalesce(F.sum(F.when(F.col("kind") == "recycle", 1).otherwise(0)).over(w), F.lit(0))
    return played(spark, sf).select("rowId", (n + 1).alias("cycle"))


@query(f"""WITH {T}, c AS (SELECT *, sum(CASE WHEN kind = 'recycle' THEN 1 ELSE 0 END) OVER (PARTITION BY sessionId ORDER BY turn, rowId) AS cyc FROM u),
d AS (SELECT sessionId, cyc, chosen, min(turn) AS f FROM c WHERE kind = 'move' GROUP BY ALL)
SELECT sessionId, cyc AS cycle, count(*) AS distinct_moves, min(f) AS first_turn FROM d GROUP BY sessionId, cyc""")
def seen_per_cycle(spark, sf):
    c = played(spark, sf).withColumn("cycle", F.sum(F.when(F.col("kind") == "recycle", 1).otherwise(0)).over(tw.session_window(ORDER)))
    return c.filter("kind = 'move'").groupBy("sessionId", "cycle").agg(F.count_distinct(F.coalesce("chosen", F.lit("\u0000"))).alias("distinct_moves"), F.min("turn").alias("first_turn"))


@query(f"""WITH RECURSIVE {T}, o AS (SELECT sessionId, turn, row_number() OVER (PARTITION BY sessionId ORDER BY turn, rowId) AS k FROM u),
g AS (SELECT sessionId, k, turn FROM o WHERE k = 1 UNION ALL SELECT g.sessionId, n.k, n.turn FROM g, LATERAL (SELECT o.k, o.turn FROM o WHERE o.sessionId = g.sessionId AND o.k > g.k AND o.turn - g.turn >= 5 ORDER BY o.k LIMIT 1) n)
SELECT sessionId, turn FROM g""")
def spaced_selection(spark, sf):
    return tw.spaced(played(spark, sf), ORDER, "turn", 5)


@query(f"""WITH RECURSIVE {T}, x AS (SELECT sessionId, turn, concat_ws('|', fc, fd, stock, chosen) AS key, row_number() OVER (PARTITION BY sessionId ORDER BY turn, rowId) AS k FROM u), o AS MATERIALIZED (SELECT *, max(k) OVER (PARTITION BY sessionId, key) AS last FROM x),
g AS (SELECT sessionId, last FROM o WHERE k = 1 UNION ALL SELECT o.sessionId, o.last FROM g JOIN o ON o.sessionId = g.sessionId AND o.k = g.last + 1)
SELECT g.sessionId, o.turn FROM g JOIN o ON o.sessionId = g.sessionId AND o.k = g.last""")
def loop_collapse(spark, sf):
    """Turns that remain after loops in (foundation, hidden, stock, move) are cut out."""
    u = played(spark, sf).withColumn("key", F.concat_ws("|", "fc", "fd", "stock", "chosen"))
    return tw.collapse_loops(u, ORDER, "key", "turn")


@query(f"WITH {T} SELECT sessionId, count(DISTINCT turn) AS turns, max(turn) - min(turn) + 1 AS span, CAST(count(DISTINCT turn) AS DOUBLE) / (max(turn) - min(turn) + 1) AS coverage FROM u GROUP BY sessionId")
def turn_coverage(spark, sf):
    g = played(spark, sf).groupBy("sessionId").agg(F.count_distinct("turn").alias("turns"), (F.max("turn") - F.min("turn") + 1).alias("span"))
    return g.withColumn("coverage", F.col("turns") / F.col("span"))


@query(f"""WITH {T}, g AS (SELECT sessionId, count(*) AS n, sha256(sessionId) AS h FROM u GROUP BY sessionId), s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, sessionId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
SELECT sessionId, n FROM s WHERE b < 2000""")
def budgeted_games(spark, sf):
    g = played(spark, sf).groupBy("sessionId").agg(F.count("*").alias("n"))
    return tw.within_budget(g, "sessionId", "n", 2000, F.sha2("sessionId", 256))


@query(f"""WITH {T}, o AS (SELECT rowId, sessionId, row_number() OVER (PARTITION BY sessionId ORDER BY turn, rowId) - 1 AS k, count(*) OVER (PARTITION BY sessionId) AS n FROM u),
x AS (SELECT o.rowId FROM o WHERE n <= 10 OR EXISTS (SELECT 1 FROM range(10) q(i) WHERE i * n // 10 = k)) SELECT rowId FROM x""")
def stride_subsample(spark, sf):
    """At most ten turns of a session at even strides: the k-th of n is kept when some i gives i * n div 10 = k."""
    whole = W.partitionBy("sessionId")
    d = played(spark, sf).withColumn("k", F.row_number().over(tw.session_window(ORDER)) - 1).withColumn("n", F.count("*").over(whole))
    i = F.ceil(F.col("k") * 10 / F.col("n"))
    return d.filter((F.col("n") <= 10) | ((i < 10) & (F.floor(i * F.col("n") / 10) == F.col("k")))).select("rowId")


# --- selection, tiers, aggregates ---------------------------------------------------------------------------------


@query(f"WITH {T} SELECT {TIER} AS tier, count(*) AS n, count(*) FILTER (WHERE outcome = 'success') AS ok FROM t GROUP BY 1")
def schema_tier_counts(spark, sf):
    d = turns(spark, sf).withColumnRenamed("turn", "turnIndex").withColumn("tier", dec.schema_tier())
    return d.groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("ok"))


@query(f"""WITH {T}, {_STALLED}, r AS (SELECT st.rowId, list_filter([CASE WHEN {TIER} <> 'current' THEN 'legacy-schema' END, CASE WHEN coalesce(model, '') <> '{TEACHER}' THEN 'non-teacher-model:' || coalesce(model, '(unknown)') END,
CASE WHEN stalled THEN 'stalled-game' END], lambda x: x IS NOT NULL) AS why FROM st) SELECT rowId, array_to_string(why, ',') AS reasons FROM r""")
def exclude_reasons(spark, sf):
    d = _stalls(spark, sf).withColumnRenamed("turn", "turnIndex").withColumn("tier", dec.schema_tier())
    return d.select("rowId", F.array_join(dec.exclude_reasons(F.col("tier"), F.col("model"), TEACHER, F.col("stalled")), ",").alias("reasons"))


@query(f"""WITH {T}, {_STALLED} SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'success') AS success, count(*) FILTER (WHERE outcome = 'success' AND {TIER} = 'current') AS current_tier,
count(*) FILTER (WHERE outcome = 'success' AND {TIER} = 'current' AND model = '{TEACHER}') AS teacher, count(*) FILTER (WHERE outcome = 'success' AND {TIER} = 'current' AND model = '{TEACHER}' AND NOT stalled) AS eligible FROM st""")
def selection_funnel(spark, sf):
    d = _stalls(spark, sf).withColumnRenamed("turn", "turnIndex").withColumn("tier", dec.schema_tier())
    ok = F.col("outcome") == "success"
    cur = ok & (F.col("tier") == "current")
    teach = cur & (F.col("model") == TEACHER)
    return d.agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(cur).alias("current_tier"), F.count_if(teach).alias("teacher"), F.count_if(teach & ~F.col("stalled")).alias("eligible"))


@query(f"""WITH {T} SELECT rowId, fc, fd, (0.65::DOUBLE * fc / 52 + 0.35::DOUBLE * (21 - fd) / 21) * 100 AS progress, chosen, CASE WHEN moveIndex >= 0 THEN prompt->>('$.legalMoves[' || moveIndex || '].description') END AS listed FROM t WHERE outcome = 'success' AND moveIndex IS NOT NULL""")
def decision_projection(spark, sf):
    """The chosen legal move looked up in the list; null when the index lies beyond it."""
    d = turns(spark, sf).filter("outcome = 'success' AND moveIndex IS NOT NULL")
    return d.select("rowId", "fc", "fd", dec.progress_score(F.col("fc"), F.col("fd")).alias("progress"), "chosen", F.col("listed.description").alias("listed"))


@query("""SELECT coalesce(CASE WHEN seed <> 0 THEN 'seed:' || seed END, CASE WHEN sessionId <> '' THEN 'session:' || sessionId END, 'row:' || rowId) AS game, count(*) AS n FROM decision_recs GROUP BY 1""")
def game_keys(spark, sf):
    return table(spark, sf, "decision_recs", "rowId", "sessionId", "seed").groupBy(dec.game_key().alias("game")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN outcome IS DISTINCT FROM 'success' THEN 'not_success' WHEN NOT coalesce(json_valid(decision), false) OR json_type(decision) <> 'OBJECT' THEN 'bad_json' ELSE 'kept' END AS reason, count(*) AS n FROM decision_recs GROUP BY 1""")
def clean_examples(spark, sf):
    d = table(spark, sf, "decision_recs", "outcome", "decision")
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("decision")).startswith("OBJECT"), F.lit(False))
    why = F.when(~F.coalesce(F.col("outcome") == "success", F.lit(False)), "not_success").when(~good, "bad_json").otherwise("kept")
    return d.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(model, '(unknown)') AS model, count(*) AS n, count(*) FILTER (WHERE outcome = 'success') AS ok, 100.0::DOUBLE * count(*) FILTER (WHERE outcome = 'success') / count(*) AS rate FROM decision_recs GROUP BY 1")
def by_model(spark, sf):
    g = table(spark, sf, "decision_recs", "model", "outcome").groupBy(F.coalesce("model", F.lit("(unknown)")).alias("model")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("ok"))
    return g.withColumn("rate", F.lit(100.0) * F.col("ok") / F.col("n"))


@query(f"WITH {T} SELECT sessionId, count(*) AS n, count(*) FILTER (WHERE outcome = 'success') AS ok, max(fc) AS best, min(turn) AS first_turn, max(turn) AS last_turn, min(coalesce(ts, 0)) AS began FROM u GROUP BY sessionId")
def by_session(spark, sf):
    return played(spark, sf).groupBy("sessionId").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("ok"), F.max("fc").alias("best"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.min(F.coalesce("ts", F.lit(0))).alias("began"))


@query("SELECT coalesce(nullif(outcome, ''), '(none)') AS error, count(*) AS n FROM decision_recs WHERE outcome IS DISTINCT FROM 'success' GROUP BY 1")
def error_breakdown(spark, sf):
    d = table(spark, sf, "decision_recs", "outcome").filter(~F.coalesce(F.col("outcome") == "success", F.lit(False)))
    return d.groupBy(F.coalesce(F.nullif(F.col("outcome"), F.lit("")), F.lit("(none)")).alias("error")).agg(F.count("*").alias("n"))


@query(f"WITH {T} SELECT kind, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM t WHERE kind IS NOT NULL GROUP BY kind")
def move_mix(spark, sf):
    return dec.share_of(turns(spark, sf).select("kind"), "kind")


@query("""WITH c AS (SELECT TRY_CAST(decision->>'$.confidence' AS DECIMAL(9, 4)) AS c FROM decision_recs WHERE json_valid(decision) AND json_type(decision, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT')),
o AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k, count(*) OVER () AS n FROM c WHERE c IS NOT NULL) SELECT max(n) AS n, CAST(min(c) AS DOUBLE) AS lo, CAST(max(c) AS DOUBLE) AS hi, CAST(sum(c) AS DOUBLE) / max(n) AS mean, CAST(max(CASE WHEN k = n // 2 THEN c END) AS DOUBLE) AS upper_median FROM o""")
def confidence_stats(spark, sf):
    """Median means the upper of the two middle values. Distinct values are counted first, so the ordering works on as
    many rows as there are different confidences."""
    v = F.try_parse_json("decision")
    num = F.schema_of_variant(F.try_variant_get(v, "$.confidence", "variant"))
    d = table(spark, sf, "decision_recs", "decision").select(F.when(~num.isin("STRING", "VOID", "BOOLEAN"), F.try_variant_get(v, "$.confidence", "decimal(9,4)")).alias("c")).filter("c IS NOT NULL")
    g = d.groupBy("c").agg(F.count("*").alias("m"))
    w = W.orderBy("c")
    g = g.withColumn("upto", F.sum("m").over(w)).withColumn("n", F.sum("m").over(W.partitionBy()))
    half = F.floor(F.col("n") / 2)
    mid = F.max(F.when((F.col("upto") > half) & (F.col("upto") - F.col("m") <= half), F.col("c")))
    return g.agg(F.max("n").alias("n"), F.min("c").cast("double").alias("lo"), F.max("c").cast("double").alias("hi"), (F.sum(F.col("c") * F.col("m")).cast("double") / F.max("n")).alias("mean"), mid.cast("double").alias("upper_median"))


@query("SELECT CAST(make_timestamp(min(t) * 1000) AS DATE) AS first_day, CAST(make_timestamp(max(t) * 1000) AS DATE) AS last_day FROM (SELECT CASE WHEN abs(\"timestamp\") < 100000000000 THEN \"timestamp\" * 1000 ELSE \"timestamp\" END AS t FROM decision_recs)")
def date_span(spark, sf):
    t = F.when(F.abs("timestamp") < 100_000_000_000, F.col("timestamp") * 1000).otherwise(F.col("timestamp"))
    return table(spark, sf, "decision_recs", "timestamp").agg(F.to_date(F.timestamp_millis(F.min(t))).alias("first_day"), F.to_date(F.timestamp_millis(F.max(t))).alias("last_day"))


@query("""SELECT count(*) FILTER (WHERE event = 'game_started') AS started, count(*) FILTER (WHERE event = 'game_ended') AS ended, count(*) FILTER (WHERE event = 'game_abandoned') AS abandoned, count(*) FILTER (WHERE event = 'move_played') AS moves,
count(*) FILTER (WHERE event = 'game_ended' AND won) AS won, count(*) FILTER (WHERE event = 'game_ended' AND stuck) AS stuck, coalesce(count(*) FILTER (WHERE event = 'game_ended' AND won) / nullif(count(*) FILTER (WHERE event = 'game_ended'), 0), 0.0) AS win_rate,
coalesce(CAST(sum(move_count) FILTER (WHERE event = 'game_ended') AS DOUBLE) / nullif(count(move_count) FILTER (WHERE event = 'game_ended'), 0), 0.0) AS avg_moves FROM (SELECT DISTINCT * FROM server_log)""")
def analytics_summary(spark, sf):
    from ..operators.events import summary

    return summary(table(spark, sf, "server_log").distinct())


@query("SELECT coalesce(kind, 'unknown') AS kind, count(*) AS n FROM (SELECT DISTINCT * FROM server_log) WHERE event = 'move_played' GROUP BY 1")
def actions_by_kind(spark, sf):
    return table(spark, sf, "server_log").distinct().filter("event = 'move_played'").groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT 'session' AS part, CASE WHEN coalesce(trim(sessionId), '') = '' THEN '(none)' ELSE sessionId END AS name, count(*) AS n FROM decision_recs GROUP BY 2
UNION ALL SELECT 'model', CASE WHEN coalesce(trim(model), '') = '' THEN '(none)' ELSE model END, count(*) FROM decision_recs GROUP BY 2""")
def harvest_summary(spark, sf):
    """Decisions by session and by model in one pass over the table (grouping sets)."""
    d = table(spark, sf, "decision_recs", "sessionId", "model").select(dec.named("sessionId").alias("s"), dec.named("model").alias("m"))
    d = d.select(F.explode(F.array(F.struct(F.lit("session").alias("part"), F.col("s").alias("name")), F.struct(F.lit("model").alias("part"), F.col("m").alias("name")))).alias("x"))
    return d.groupBy("x.part", "x.name").agg(F.count("*").alias("n"))


# --- joins and set operations ---------------------------------------------------------------------------------------


@query(f"WITH {T} SELECT t.rowId, t.sessionId FROM t WHERE t.sessionId IN (SELECT sessionId FROM run_summary WHERE outcome = 'won')")
def won_only(spark, sf):
    won = table(spark, sf, "run_summary", "sessionId", "outcome").filter("outcome = 'won'").select("sessionId")
    return table(spark, sf, "decision_recs", "rowId", "sessionId").join(won, "sessionId", "left_semi").select("rowId", "sessionId")


@query("SELECT exampleId FROM sft_examples WHERE split = 'train' AND (seed IS NULL OR seed = 0 OR seed NOT IN (SELECT seed FROM sft_examples WHERE split <> 'train' AND seed IS NOT NULL AND seed <> 0))")
def eval_holdout(spark, sf):
    """Training examples whose deal is in no evaluation split; rows without a seed stay."""
    e = table(spark, sf, "sft_examples", "exampleId", "split", "seed")
    held = e.filter("split <> 'train' AND seed <> 0").select("seed").distinct()
    tr = e.filter("split = 'train'").withColumn("k", F.when(F.col("seed") != 0, F.col("seed")))
    return tr.join(held.withColumnRenamed("seed", "k"), "k", "left_anti").select("exampleId")


@query("SELECT fileName, count(*) AS lines FROM raw_lines WHERE fileName NOT IN (SELECT file FROM manifest) GROUP BY fileName")
def unlisted_files(spark, sf):
    """Files that the manifest does not list, with their lines."""
    m = table(spark, sf, "manifest", "file").select(F.col("file").alias("fileName"))
    return table(spark, sf, "raw_lines", "fileName").join(m, "fileName", "left_anti").groupBy("fileName").agg(F.count("*").alias("lines"))


@query("""WITH f AS (SELECT fileName, count(*) AS rows, count(*) FILTER (WHERE json_valid(body)) AS usable FROM raw_lines WHERE trim(body) <> '' GROUP BY fileName), m AS (SELECT DISTINCT file, "rows" AS listed, usable AS listed_usable FROM manifest)
SELECT coalesce(f.fileName, m.file) AS file, f.rows AS rows, f.usable AS usable, m.listed AS listed, m.listed_usable AS listed_usable, CASE WHEN m.file IS NULL THEN 'only_files' WHEN f.fileName IS NULL THEN 'only_manifest' WHEN f.rows IS DISTINCT FROM m.listed OR f.usable IS DISTINCT FROM m.listed_usable THEN 'differs' ELSE 'same' END AS state FROM f FULL JOIN m ON f.fileName = m.file""")
def publish_integrity(spark, sf):
    """Files against manifest: a full outer join with null-safe comparison of the counters."""
    f = table(spark, sf, "raw_lines", "fileName", "body").filter(F.trim("body") != "").groupBy("fileName").agg(F.count("*").alias("rows"), F.count(F.try_parse_json("body")).alias("usable"))
    m = table(spark, sf, "manifest", "file", "rows", "usable").distinct().select("file", F.col("rows").alias("listed"), F.col("usable").alias("listed_usable"))
    j = f.join(m, f["fileName"] == m["file"], "full_outer")
    same = F.col("rows").eqNullSafe(F.col("listed")) & F.col("usable").eqNullSafe(F.col("listed_usable"))
    state = F.when(F.col("file").isNull(), "only_files").when(F.col("fileName").isNull(), "only_manifest").when(~same, "differs").otherwise("same")
    return j.select(F.coalesce("fileName", "file").alias("file"), "rows", "usable", "listed", "listed_usable", state.alias("state"))


@query("""WITH r AS (SELECT deck_seed, model_id, max(final_foundation_cards) AS fc FROM run_summary WHERE deck_seed IS NOT NULL AND model_id IS NOT NULL GROUP BY ALL), b AS (SELECT deck_seed, fc FROM r WHERE model_id = 'quillo-4b')
SELECT r.model_id AS model, count(*) AS decks, count(*) FILTER (WHERE r.fc > b.fc) AS better, count(*) FILTER (WHERE r.fc = b.fc) AS tied, count(*) FILTER (WHERE r.fc < b.fc) AS worse, CAST(sum(r.fc - b.fc) AS DOUBLE) / count(*) AS mean_delta FROM r JOIN b ON r.deck_seed = b.deck_seed WHERE r.model_id <> 'quillo-4b' GROUP BY 1""")
def paired_vs_base(spark, sf):
    from ..operators.runs import paired

    return paired(table(spark, sf, "run_summary", "deck_seed", "model_id", "final_foundation_cards"), "deck_seed", "model_id", "final_foundation_cards", "quillo-4b")


@query("SELECT count(*) AS common FROM (SELECT sessionId FROM run_summary WHERE outcome = 'won' AND sessionId IS NOT NULL INTERSECT SELECT sessionId FROM decision_recs WHERE model = 'quillo-4b' AND sessionId IS NOT NULL)")
def cohort_intersection(spark, sf):
    a = table(spark, sf, "run_summary", "sessionId", "outcome").filter("outcome = 'won' AND sessionId IS NOT NULL").select("sessionId")
    b = table(spark, sf, "decision_recs", "sessionId", "model").filter("model = 'quillo-4b' AND sessionId IS NOT NULL").select("sessionId")
    return a.intersect(b).agg(F.count("*").alias("common"))


@query("""WITH l AS (SELECT session_id, "timestamp", description, kind FROM (SELECT DISTINCT * FROM server_log) WHERE event = 'move_played'), d AS (SELECT sessionId, CASE WHEN json_valid(decision) THEN decision->>'$.chosenKind' END AS kind, CASE WHEN json_valid(decision) THEN decision->>'$.chosenDescribe' END AS chosen FROM decision_recs)
SELECT l.session_id, count(*) AS matched FROM (SELECT DISTINCT session_id, kind, description FROM l) l JOIN (SELECT DISTINCT sessionId, kind, chosen FROM d) d ON l.session_id = d.sessionId AND l.kind IS NOT DISTINCT FROM d.kind AND l.description IS NOT DISTINCT FROM d.chosen GROUP BY 1""")
def suggested_to_played(spark, sf):
    """Null-safe equality on several attributes between logged moves and decisions."""
    log = table(spark, sf, "server_log").distinct().filter("event = 'move_played'").select("session_id", "kind", "description").distinct()
    d = turns(spark, sf).select("sessionId", F.col("kind").alias("k"), "chosen").distinct()
    on = (log["session_id"] == d["sessionId"]) & log["kind"].eqNullSafe(d["k"]) & log["description"].eqNullSafe(d["chosen"])
    return log.join(d, on).groupBy("session_id").agg(F.count("*").alias("matched"))


@query("""WITH k AS (SELECT *, md5(concat_ws('|', coalesce(sessionId, ''), coalesce(outcome, ''), coalesce(model, ''))) AS h, row_number() OVER (PARTITION BY id ORDER BY rowId) AS r, first_value(md5(concat_ws('|', coalesce(sessionId, ''), coalesce(outcome, ''), coalesce(model, '')))) OVER (PARTITION BY id ORDER BY rowId) AS fh FROM decision_recs WHERE id IS NOT NULL)
SELECT id, min(rowId) AS rowId, count(*) - 1 AS further, count(*) FILTER (WHERE h <> fh) AS conflicts FROM k GROUP BY id""")
def dedup_first_wins(spark, sf):
    """Union by raw id where the first copy wins, with the number of copies that differ from it."""
    d = table(spark, sf, "decision_recs", "rowId", "id", "sessionId", "outcome", "model")
    d = d.select("rowId", "id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("sessionId", "outcome", "model")])
    return dec.first_wins(d, "id", ["rowId"]).select("id", "rowId", "further", "conflicts")


@query("SELECT id, max(rowId) AS rowId FROM decision_recs WHERE id IS NOT NULL GROUP BY id")
def dedup_last_wins(spark, sf):
    return dec.last_wins(table(spark, sf, "decision_recs", "rowId", "id"), "id", ["rowId"]).select("id", "rowId")


@query("""WITH o AS (SELECT rowId, row_number() OVER (ORDER BY coalesce("timestamp", 0), coalesce(id, ''), rowId) - 1 AS k FROM decision_recs) SELECT rowId, k // 2000 AS shard FROM o""")
def shard_assignment(spark, sf):
    d = table(spark, sf, "decision_recs", "rowId", "id", "timestamp").select("rowId", F.coalesce("timestamp", F.lit(0)).alias("t"), F.coalesce("id", F.lit("")).alias("i"))
    return dec.sharded(d, ["t", "i", "rowId"], F.floor(F.col("t") / 60_000), 2000).select("rowId", "shard")


@query("""WITH old AS (SELECT DISTINCT id FROM decision_recs WHERE receivedAt < (SELECT max(receivedAt) - INTERVAL 7 DAY FROM decision_recs) AND id IS NOT NULL), n AS (SELECT id, min(rowId) AS rowId FROM decision_recs WHERE receivedAt >= (SELECT max(receivedAt) - INTERVAL 7 DAY FROM decision_recs) AND id IS NOT NULL AND id NOT IN (SELECT id FROM old) GROUP BY id),
b AS (SELECT count(*) AS have FROM old), o AS (SELECT id, row_number() OVER (ORDER BY rowId) - 1 AS k FROM n) SELECT o.id, (b.have + o.k) // 2000 AS shard FROM o, b""")
def append_shard_plan(spark, sf):
    """New ids of the last week behind those published before: the under-full tail shard is filled first."""
    from ..operators.publish import append_plan

    d = table(spark, sf, "decision_recs", "rowId", "id", "receivedAt")
    late = F.col("receivedAt") >= F.lit(d.agg(F.max("receivedAt") - F.expr("INTERVAL 7 DAYS")).first()[0])
    d = d.filter("id IS NOT NULL")
    return append_plan(d.filter(~late), d.filter(late), "id", "rowId", 2000)


@query("""SELECT e.exampleId, c.i AS "copy" FROM sft_examples e, range(3) c(i) WHERE c.i = 0 OR (e.split = 'train' AND e.origin = 'closeout')""")
def oversample_closeout(spark, sf):
    """Matching training rows three times, side by side; all others once."""
    n = F.when((F.col("split") == "train") & (F.col("origin") == "closeout"), 2).otherwise(0)
    return table(spark, sf, "sft_examples", "exampleId", "split", "origin").select("exampleId", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint"))).alias("copy"))


@query("SELECT origin, count(*) AS n FROM (SELECT origin FROM sft_examples UNION ALL SELECT origin FROM sft_examples, range(2) WHERE split = 'train' AND origin = 'star_round') GROUP BY 1")
def union_all_mix(spark, sf):
    """All examples, and those of one origin's training part twice more, duplicates wanted."""
    e = table(spark, sf, "sft_examples", "origin", "split")
    twice = e.filter("split = 'train' AND origin = 'star_round'").select("origin", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("k")).drop("k")
    return e.select("origin").unionAll(twice).groupBy("origin").agg(F.count("*").alias("n"))


# --- sampling and splits ----------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT exampleId, origin, row_number() OVER (PARTITION BY origin ORDER BY sha256('7:' || exampleId), exampleId) AS k FROM sft_examples) SELECT exampleId, origin FROM r WHERE k <= 20")
def quota_sample(spark, sf):
    """Twenty examples of each origin in hash order (a sampling operator)."""
    from ..operators.sampling import quota

    return quota(table(spark, sf, "sft_examples", "exampleId", "origin"), "origin", "exampleId", 20, seed=7)


@query("SELECT exampleId FROM (SELECT exampleId, row_number() OVER (ORDER BY sha256('3:' || exampleId), exampleId) AS k FROM sft_examples) WHERE k <= 100")
def uniform_sample(spark, sf):
    from ..operators.sampling import uniform

    return uniform(table(spark, sf, "sft_examples", "exampleId"), "exampleId", 100, seed=3)


@query("WITH r AS (SELECT rowId, sessionId, row_number() OVER (PARTITION BY sessionId ORDER BY sha256('5:' || rowId), rowId) AS k FROM decision_recs WHERE sessionId IS NOT NULL) SELECT rowId, sessionId FROM r WHERE k <= 30")
def per_session_cap(spark, sf):
    from ..operators.sampling import quota

    return quota(table(spark, sf, "decision_recs", "rowId", "sessionId").filter("sessionId IS NOT NULL"), "sessionId", "rowId", 30, seed=5)


@query("""WITH g AS (SELECT DISTINCT coalesce(CASE WHEN seed <> 0 THEN 'seed:' || seed END, CASE WHEN sessionId <> '' THEN 'session:' || sessionId END, 'row:' || rowId) AS game FROM decision_recs),
o AS (SELECT game, row_number() OVER (ORDER BY sha256('1:' || game), game) - 1 AS k, count(*) OVER () AS n FROM g) SELECT game, CASE WHEN k < CAST(floor(n * 0.8) AS BIGINT) THEN 'train' WHEN k < CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'valid' ELSE 'test' END AS split FROM o""")
def game_level_split(spark, sf):
    from ..operators.sampling import split_groups

    g = table(spark, sf, "decision_recs", "rowId", "sessionId", "seed").select(dec.game_key().alias("game")).distinct()
    return split_groups(g, "game", {"train": 0.8, "valid": 0.1, "test": 0.1}, seed=1)


@query("WITH s AS (SELECT sessionId, max(turnIndex) AS turns FROM decision_recs WHERE sessionId <> '' GROUP BY sessionId) SELECT sessionId, turns FROM s ORDER BY turns DESC NULLS LAST, sessionId LIMIT 10")
def longest_sessions(spark, sf):
    """Top ten, ties by name (a top-k report)."""
    g = table(spark, sf, "decision_recs", "sessionId", "turnIndex").filter("sessionId <> ''").groupBy("sessionId").agg(F.max("turnIndex").alias("turns"))
    return g.orderBy(F.desc_nulls_last("turns"), "sessionId").limit(10)


# --- runs and tournaments -----------------------------------------------------------------------------------------------

_R = "r AS (SELECT DISTINCT * FROM run_summary WHERE model_id IS NOT NULL)"


@query(f"""WITH {_R} SELECT model_id AS model, count(*) AS n, count(*) FILTER (WHERE outcome = 'won') AS wins, CAST(sum(final_foundation_cards) AS DOUBLE) / count(final_foundation_cards) AS mean_fc, median(final_foundation_cards) AS median_fc, max(final_foundation_cards) AS max_fc, count(*) FILTER (WHERE outcome IS NULL) AS unfinished FROM r GROUP BY 1""")
def leaderboard(spark, sf):
    from ..operators.runs import leaderboard as board

    return board(table(spark, sf, "run_summary").distinct().filter("model_id IS NOT NULL"), "model_id", "final_foundation_cards", "outcome")


@query(f"WITH {_R} SELECT deck_seed AS deck, count(*) AS tries, count(*) FILTER (WHERE outcome = 'won') AS wins, coalesce(bool_or(outcome = 'won'), false) AS solved, max(final_foundation_cards) AS best FROM r WHERE deck_seed IS NOT NULL GROUP BY 1")
def pass_at_n(spark, sf):
    r = table(spark, sf, "run_summary").distinct().filter("model_id IS NOT NULL AND deck_seed IS NOT NULL")
    won = F.col("outcome") == "won"
    return r.groupBy(F.col("deck_seed").alias("deck")).agg(F.count("*").alias("tries"), F.count_if(won).alias("wins"), F.coalesce(F.bool_or(won), F.lit(False)).alias("solved"), F.max("final_foundation_cards").alias("best"))


@query(f"""WITH {_R}, g AS (SELECT model_id, outcome, CAST(count(final_foundation_cards) AS DOUBLE) AS n, CAST(sum(final_foundation_cards) AS DOUBLE) AS s, CAST(sum(final_foundation_cards * final_foundation_cards) AS DOUBLE) AS q FROM r GROUP BY ALL)
SELECT model_id AS arm, coalesce(outcome, '(none)') AS category, CAST(n AS BIGINT) AS n, s / nullif(n, 0) AS mean, CASE WHEN n > 1 THEN sqrt(greatest(0, (q - s * s / n) / (n - 1))) ELSE 0.0 END AS sd FROM g""")
def arm_categories(spark, sf):
    """Mean and sample deviation per arm and category; 0 for a single run. Built from exact integer sums."""
    from ..operators.runs import arm_stats

    return arm_stats(table(spark, sf, "run_summary").distinct().filter("model_id IS NOT NULL"), ["model_id", "outcome"], "final_foundation_cards")


@query(f"""WITH {_R} SELECT deck_seed AS state, model_id AS arm, array_to_string(list_sort(list(outcome) FILTER (WHERE outcome IS NOT NULL)), ',') AS picks, count(DISTINCT outcome) AS unique_picks FROM r WHERE deck_seed IS NOT NULL GROUP BY 1, 2""")
def per_state_picks(spark, sf):
    r = table(spark, sf, "run_summary").distinct().filter("model_id IS NOT NULL AND deck_seed IS NOT NULL")
    g = r.groupBy(F.col("deck_seed").alias("state"), F.col("model_id").alias("arm")).agg(F.array_sort(F.collect_list("outcome")).alias("p"), F.count_distinct("outcome").alias("unique_picks"))
    return g.select("state", "arm", F.when(F.size("p") > 0, F.array_join("p", ",")).alias("picks"), "unique_picks")


@query()
def bootstrap_ci(spark, sf):
    """Paired bootstrap of the foundation difference to the base model: mean and the 2.5 and 97.5 % elements."""
    from ..operators.runs import paired_bootstrap

    r = table(spark, sf, "run_summary", "deck_seed", "model_id", "final_foundation_cards")
    return paired_bootstrap(r, "deck_seed", "model_id", "final_foundation_cards", "quillo-4b", replicates=5000, seed=0)


# --- files --------------------------------------------------------------------------------------------------------------


@query("SELECT fileName, count(*) AS lines FROM raw_lines WHERE trim(body) <> '' GROUP BY fileName")
def count_lines(spark, sf):
    return table(spark, sf, "raw_lines", "fileName", "body").filter(F.trim("body") != "").groupBy("fileName").agg(F.count("*").alias("lines"))


@query("""WITH v AS (SELECT fileName, exporter, exportedAt, body, json_valid(body) AS ok FROM raw_lines WHERE trim(body) <> ''),
x AS (SELECT *, CASE WHEN ok THEN body->>'$.schemaTier' END AS tier, CASE WHEN ok THEN body->>'$.id' END AS rid FROM v), f AS (SELECT rid, min((exportedAt, fileName)) AS first FROM x WHERE rid IS NOT NULL GROUP BY rid)
SELECT x.fileName AS file, count(*) AS rows, count(*) FILTER (WHERE ok) AS usable, count(DISTINCT x.rid) FILTER (WHERE f.first = (x.exportedAt, x.fileName)) AS new_ids, count(DISTINCT x.tier) AS tiers FROM x LEFT JOIN f ON x.rid = f.rid GROUP BY x.fileName""")
def file_manifest(spark, sf):
    from ..operators.publish import manifest

    return manifest(table(spark, sf, "raw_lines", "fileName", "exportedAt", "body")).select("file", "rows", "usable", "new_ids", "tiers")
