"""Queries of run outcomes, oscillation, evaluation metrics and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..operators import runs
from ..operators import turnwindows as tw
from ..session import table
from .answers import _A, _answers
from .relational import ORDER, T, played

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Move between columns as a signature: card, from, to.
_MOVE = r"^Move (\S+)(?: plus \d+ more)? from col(?:umn)? (\d+) to col(?:umn)? (\d+)"
_OSC = rf"""g AS (SELECT *, CASE WHEN regexp_matches(chosen, '{_MOVE}') THEN regexp_extract(chosen, '{_MOVE}', 1) || ' ' || regexp_extract(chosen, '{_MOVE}', 2) || '->' || regexp_extract(chosen, '{_MOVE}', 3) END AS sig,
 count(*) OVER (PARTITION BY sessionId) AS rows, row_number() OVER (PARTITION BY sessionId ORDER BY turn DESC, rowId DESC) AS back FROM u WHERE chosen <> ''),
p AS (SELECT sessionId, sig, lead(sig) OVER w AS nxt, row_number() OVER w AS x FROM g WHERE rows >= 6 AND back <= 15 WINDOW w AS (PARTITION BY sessionId ORDER BY turn, rowId)),
n AS (SELECT sessionId, least(sig, nxt) || ' / ' || greatest(sig, nxt) AS pair, count(*) AS times, min(x) AS first FROM p WHERE sig IS NOT NULL AND nxt IS NOT NULL GROUP BY ALL),
osc AS (SELECT sessionId, arg_min(pair, (-times, first)) AS pair, max(times) AS times FROM n GROUP BY sessionId)"""


def _oscillating(spark, sf, least: int):
    p = played(spark, sf).filter("chosen <> ''")
    sig = F.when(F.col("chosen").rlike(_MOVE), F.concat(F.regexp_extract("chosen", _MOVE, 1), F.lit(" "), F.regexp_extract("chosen", _MOVE, 2), F.lit("->"), F.regexp_extract("chosen", _MOVE, 3)))
    return tw.oscillation(p.withColumn("sig", sig), ORDER, "sig", least_pairs=least)


@query(f"WITH {T}, {_OSC} SELECT sessionId, pair, times FROM osc WHERE times >= 4")
def oscillation_pairs(spark, sf):
    """Pairs of neighbouring column moves that come four times or more in a session's last fifteen moves."""
    return _oscillating(spark, sf, 4)


@query(f"WITH {T}, {_OSC} SELECT sessionId, pair, times FROM osc")
def neighbour_pairs(spark, sf):
    """The most common pair of neighbouring column moves at the end of a session, however rare."""
    return _oscillating(spark, sf, 1)


_R = "r AS (SELECT DISTINCT * FROM run_summary WHERE model_id IS NOT NULL)"


@query(f"""WITH {T}, {_OSC}, {_R}, o AS (SELECT r.*, osc.sessionId IS NOT NULL AS swings, coalesce(final_foundation_cards, 0) AS fc, coalesce(plateau_at_end_turns, 0) AS pl, coalesce(turns_played, 0) AS tp FROM r LEFT JOIN osc ON r.sessionId = osc.sessionId)
SELECT CASE WHEN outcome = 'won' THEN CASE WHEN tp <= 250 THEN 'WIN' ELSE 'WIN_LONG' END WHEN outcome = 'parse_failure' THEN 'PARSE_FAILURE' WHEN outcome = 'engine_violation' THEN 'ENGINE_VIOLATION' WHEN swings AND pl >= 15 THEN 'MIDGAME_STALL_DOOMLOOP'
 WHEN outcome = 'illegal_move' THEN CASE WHEN swings THEN 'MIDGAME_STALL_DOOMLOOP' ELSE 'MOVE_INDEX_FIXATION' END WHEN outcome = 'max_turns' THEN CASE WHEN fc >= 45 THEN 'HIT_MAX_TURNS_NEAR_WIN' WHEN fc >= 30 THEN 'CLOSEOUT_FAIL' WHEN fc >= 10 THEN 'MIDGAME_STALL' ELSE 'EARLY_FAIL' END
 WHEN outcome = 'stalled' THEN 'STALLED_NO_LEGAL' ELSE 'UNCLASSIFIED' END AS class, count(*) AS n FROM o GROUP BY 1""")
def outcome_classes(spark, sf):
    """Classes of finished runs. A session counts as swinging here from one pair on, so that the rule is met by these runs."""
    r = table(spark, sf, "run_summary").distinct().filter("model_id IS NOT NULL")
    o = _oscillating(spark, sf, 1).select("sessionId", F.lit(True).alias("swings"))
    return r.join(o, "sessionId", "left").groupBy(runs.outcome_class(F.coalesce("swings", F.lit(False))).alias("class")).agg(F.count("*").alias("n"))


_G = r"""g AS (SELECT rowId, drawCount = 3 AS truncated, CASE WHEN json_valid(decision) THEN json_type(decision) = 'OBJECT' ELSE false END AS ok, CASE WHEN json_valid(decision) THEN CASE WHEN json_type(decision, '$.moveIndex') IN ('UBIGINT', 'BIGINT') THEN CAST(decision->>'$.moveIndex' AS INT) END END AS idx,
 CASE WHEN json_valid(decision) THEN CASE WHEN json_type(decision, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(decision->>'$.confidence' AS DOUBLE) END END AS conf FROM decision_recs WHERE drawCount IN (1, 3)),
v AS (SELECT truncated, round(count(*) FILTER (WHERE ok) / count(*), 3) AS valid, round(count(*) FILTER (WHERE idx IS NOT NULL) / count(*), 3) AS parsed, round(count(*) FILTER (WHERE idx = 0) / count(*), 3) AS agree, round(median(conf), 3) AS conf FROM g GROUP BY truncated)"""


@query(f"""WITH {_G} SELECT t.valid AS json_valid_rate, t.parsed AS move_parsed_rate, round((t.agree - c.agree) * 100, 1) AS teacher_match_delta_pp, round(t.conf - c.conf, 3) AS confidence_median_delta,
 CASE WHEN t.valid >= 1 AND t.parsed >= 1 AND abs(round((t.agree - c.agree) * 100, 1)) <= 5 AND (t.conf IS NULL OR c.conf IS NULL OR abs(round(t.conf - c.conf, 3)) <= 0.05) THEN 'SHIP' ELSE 'REVISE' END AS verdict FROM v t, v c WHERE t.truncated AND NOT c.truncated""")
def guardrail_verdict(spark, sf):
    """A changed arm against its control: draws of three against draws of one, the first move as the teacher's."""
    d = table(spark, sf, "decision_recs", "drawCount", "decision").filter("drawCount IN (1, 3)")
    v = pr.strict_json(F.col("decision"))
    d = d.select((F.col("drawCount") == 3).alias("changed"), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("ok"), pr._int(v, "$.moveIndex").alias("idx"), pr._number(v, "$.confidence").alias("conf"))
    return runs.guardrail(d, "changed", F.lit(0))


_E = f"""{_A}, e AS (SELECT rowId, n, CAST(CASE rowId % 10 WHEN 0 THEN n WHEN 6 THEN n WHEN 8 THEN -1 END AS INT) AS idx, rowId % 10 = 8 AS ok, rowId % 5 + 1 AS legal, CASE WHEN rowId % 4 = 0 THEN NULL ELSE rowId % 3 END AS teacher FROM a)"""


@query(f"""WITH {_E}, k AS (SELECT max(c) AS top FROM (SELECT count(*) AS c FROM e GROUP BY teacher)) SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE idx >= 0 AND idx < legal) AS legal, count(*) FILTER (WHERE idx = teacher) AS agree, any_value(k.top) / count(*) AS baseline,
 CASE WHEN count(*) FILTER (WHERE ok) / count(*) >= 0.98 AND count(*) FILTER (WHERE idx >= 0 AND idx < legal) / count(*) >= 0.98 AND count(*) FILTER (WHERE idx = teacher) / count(*) > any_value(k.top) / count(*) THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM e, k""")
def evaluation_metrics(spark, sf):
    """Validity, legality and agreement of answers with the teacher's, against the most common teacher move."""
    r = F.col("rowId")
    d = _answers(spark, sf)
    teacher = F.when(r % 4 == 0, F.lit("none")).otherwise(F.concat(F.lit('{"final_decision": {"move_index": '), (r % 3).cast("string"), F.lit("}}")))
    prompt = F.concat(F.lit('{"legalMoves": ['), F.array_join(F.array_repeat(F.lit('{"a": [1]}'), (r % 5 + 1).cast("int")), ", "), F.lit("]}"))
    d = d.select(pr.evaluated(F.col("t")).alias("e"), pr.evaluated(teacher)["idx"].alias("teacher"), pr.legal_move_count(prompt).alias("legal"))
    return runs.evaluation(d.select("e.idx", "e.ok", "teacher", "legal"))


@query(f"""WITH {T}, c AS (SELECT *, CASE WHEN fc = lag(fc) OVER w AND fd = lag(fd) OVER w THEN 0 ELSE 1 END AS chg FROM u WHERE fc IS NOT NULL AND fd IS NOT NULL WINDOW w AS (PARTITION BY sessionId ORDER BY turn, rowId)), i AS (SELECT *, sum(chg) OVER (PARTITION BY sessionId ORDER BY turn, rowId) AS isl FROM c),
s AS (SELECT rowId, row_number() OVER (PARTITION BY sessionId, isl ORDER BY turn, rowId) - 1 AS flat, row_number() OVER (PARTITION BY sessionId, fc, fd, stock ORDER BY turn, rowId) - 1 AS seen FROM i)
SELECT rowId, CASE WHEN flat > 0 THEN 'STALL: no foundation play and no new card revealed in the last ' || flat || ' moves.' ELSE '' END || CASE WHEN seen > 0 THEN CASE WHEN flat > 0 THEN chr(10) ELSE '' END || 'REPEAT: this exact board position has already occurred ' || seen || ' time(s) earlier this game.' ELSE '' END AS lines FROM s""")
def stall_lines(spark, sf):
    """What a prompt says about a stall: moves without progress and how often the position stood before."""
    d = played(spark, sf).filter("fc IS NOT NULL AND fd IS NOT NULL")
    d = tw.repeats(tw.stalls(d, ORDER, 25), ORDER, F.struct("fc", "fd", "stock"))
    return d.select("rowId", F.array_join(pr.stall_lines(F.col("flat"), F.col("seen_before")), "\n").alias("lines"))


@query("""SELECT rowId, CASE WHEN arm_ok THEN 'PASS' ELSE 'FAIL' END AS gate FROM (SELECT rowId, rowId % 4 >= 2 AND rowId % 3 < 2 AS arm_ok FROM decision_recs)""")
def hypothesis_gates(spark, sf):
    """Several thresholds on one row; all of them must hold, and a missing figure fails."""
    d = table(spark, sf, "decision_recs", "rowId").select("rowId", F.when(F.col("rowId") % 4 >= 1, F.col("rowId") % 4).alias("mean"), (F.col("rowId") % 3).alias("illegal"))
    g = runs.gates(d, {"mean": (">=", 2), "illegal": ("<", 2)})
    return g.select("rowId", F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("gate"))


@query("""WITH b AS (SELECT rowId % 3 AS state, rowId % 5 AS pick FROM decision_recs WHERE rowId % 7 > 0) SELECT state, count(*) AS n, CAST(count(*) FILTER (WHERE pick <> 2) AS DOUBLE) / count(*) AS escape FROM b GROUP BY state UNION ALL SELECT 9, 0, NULL""")
def escape_probability(spark, sf):
    """Share of picks that leave the loop move; null where nothing was picked."""
    d = table(spark, sf, "decision_recs", "rowId").select((F.col("rowId") % 3).alias("state"), F.when(F.col("rowId") % 7 > 0, F.col("rowId") % 5).alias("pick"))
    d = d.unionByName(spark.range(1).select(F.lit(9).cast("bigint").alias("state"), F.lit(None).cast("bigint").alias("pick")))
    return runs.escape(d, "state", "pick", F.lit(2))


@query("""WITH r AS (SELECT rowId % 4 AS arm, (rowId // 4) % 5 AS state, CASE WHEN rowId % 9 = 0 THEN NULL ELSE rowId % 7 END AS tier, rowId % 3 = 0 AS osc FROM decision_recs), t AS (SELECT i AS state, CASE WHEN i = 4 THEN NULL ELSE i END AS teacher FROM range(5) x(i))
SELECT arm, count(*) AS n, avg(tier) AS mean_tier, count(*) FILTER (WHERE tier = 0) AS illegal, count(*) FILTER (WHERE tier = 6) AS foundation, count(*) FILTER (WHERE osc) AS osc_n, count(*) FILTER (WHERE osc AND tier = teacher) AS osc_agree, avg(tier - teacher) AS gap FROM r JOIN t ON r.state = t.state GROUP BY arm""")
def learning_curve(spark, sf):
    """Scored picks against the teacher's per state: mean tier, illegal picks, oscillation agreement, gap; a state without a
    teacher's pick counts for no gap."""
    r = F.col("rowId")
    d = table(spark, sf, "decision_recs", "rowId").select((r % 4).alias("arm"), (F.floor(r / 4) % 5).alias("state"), F.when(r % 9 > 0, r % 7).alias("tier"), (r % 3 == 0).alias("osc"))
    t = spark.range(5).select(F.col("id").alias("state"), F.when(F.col("id") < 4, F.col("id")).alias("teacher"))
    return runs.score_picks(d, t, "arm", "state")


@query("""WITH r AS (SELECT rowId % 4 AS arm, rowId % 7 AS tier, rowId % 6 = 0 AS rev FROM decision_recs), g AS (SELECT arm, count(*) AS n, sum(tier) AS s, sum(tier * tier) AS q, count(*) FILTER (WHERE rev) AS rev FROM r GROUP BY arm), d AS (SELECT arm, tier, count(*) AS c FROM r GROUP BY arm, tier)
SELECT g.arm, g.n, CAST(s AS DOUBLE) / n AS mean, CASE WHEN n > 1 THEN sqrt(greatest(0, (q - CAST(s AS DOUBLE) * s / n) / (n - 1))) ELSE 0.0 END AS sd, CAST(rev AS DOUBLE) / n AS reversal_rate, string_agg(d.tier || ':' || d.c, ' ' ORDER BY d.tier) AS distribution FROM g JOIN d ON g.arm = d.arm GROUP BY ALL""")
def arm_tiers(spark, sf):
    """Per arm: mean and sample deviation of the tier, share of reversals, and how often each tier came."""
    r = F.col("rowId")
    d = table(spark, sf, "decision_recs", "rowId").select((r % 4).alias("arm"), (r % 7).alias("tier"), (r % 6 == 0).alias("rev"))
    return runs.arm_summary(d, "arm", "tier", "rev")
