"""Evaluation statistics over finished runs: leaderboards, paired deltas, bootstrap intervals, outcome classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outcome_class(swings: Column) -> Column:
    """Ordered decision rules over a run's summary; the first that holds names the class. ``swings``: the session ends in
    an oscillation. Missing counts are 0. A resigned game meets none of the rules."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    out, fc = F.col("outcome"), c("final_foundation_cards")
    spent = F.when(fc >= 45, "HIT_MAX_TURNS_NEAR_WIN").when(fc >= 30, "CLOSEOUT_FAIL").when(fc >= 10, "MIDGAME_STALL").otherwise("EARLY_FAIL")
    return (
        F.when(out == "won", F.when(c("turns_played") <= 250, "WIN").otherwise("WIN_LONG"))
        .when(out == "parse_failure", "PARSE_FAILURE")
        .when(out == "engine_violation", "ENGINE_VIOLATION")
        .when(swings & (c("plateau_at_end_turns") >= 15), "MIDGAME_STALL_DOOMLOOP")
        .when(out == "illegal_move", F.when(swings, "MIDGAME_STALL_DOOMLOOP").otherwise("MOVE_INDEX_FIXATION"))
        .when(out == "max_turns", spent)
        .when(out == "stalled", "STALLED_NO_LEGAL")
        .otherwise("UNCLASSIFIED")
    )


def guardrail(results: DataFrame, changed: str, teacher: Column) -> DataFrame:
    """One row: the changed arm's rates, its differences to the control and SHIP or REVISE. ``results`` has the flag, ok
    (the answer is JSON), idx and conf (a number or null). Rates are rounded to three digits first; SHIP needs every
    answer valid and parsed, agreement within 5 points and the median confidence within 0.05 where both have one."""
    n = F.count("*")
    g = results.groupBy(F.col(changed).alias("changed")).agg(
        F.round(F.count_if("ok") / n, 3).alias("valid"), F.round(F.count("idx") / n, 3).alias("parsed"), F.round(F.count_if(F.col("idx") == teacher) / n, 3).alias("agree"), F.round(F.median("conf"), 3).alias("conf")
    )
    of = lambda c, flag: F.max(F.when(F.col("changed") == F.lit(flag), F.col(c)))
    r = g.agg(*[of(c, f).alias(f"{c}_{f}") for c in ("valid", "parsed", "agree", "conf") for f in (True, False)])
    match, conf = F.round((F.col("agree_True") - F.col("agree_False")) * 100, 1), F.round(F.col("conf_True") - F.col("conf_False"), 3)
    ship = (F.col("valid_True") >= 1) & (F.col("parsed_True") >= 1) & (F.abs(match) <= 5) & (conf.isNull() | (F.abs(conf) <= 0.05))
    return r.select(F.col("valid_True").alias("json_valid_rate"), F.col("parsed_True").alias("move_parsed_rate"), match.alias("teacher_match_delta_pp"), conf.alias("confidence_median_delta"), F.when(ship, "SHIP").otherwise("REVISE").alias("verdict"))


def evaluation(answers: DataFrame) -> DataFrame:
    """One row: valid, legal and agreeing answers, the share of the most common teacher move (no move counts as one), and
    PASS when both rates reach 0.98 and agreement beats that share. ``answers`` has idx, ok, teacher and legal."""
    fits = (F.col("idx") >= 0) & (F.col("idx") < F.col("legal"))
    per = answers.groupBy("teacher").agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"), F.count_if(fits).alias("legal"), F.count_if(F.col("idx") == F.col("teacher")).alias("agree"))
    g = per.agg(F.sum("n").alias("n"), F.sum("valid").alias("valid"), F.sum("legal").alias("legal"), F.sum("agree").alias("agree"), F.max("n").alias("top"))
    rate = lambda c: F.col(c) / F.col("n")
    ok = (rate("valid") >= 0.98) & (rate("legal") >= 0.98) & (rate("agree") > rate("top"))
    return g.select("n", "valid", "legal", "agree", rate("top").alias("baseline"), F.when(ok, "PASS").otherwise("REVIEW").alias("verdict"))


def escape(picks: DataFrame, state: str, pick: str, loop_move: Column) -> DataFrame:
    """Per state: picks and the share that is not the loop move; null without any pick."""
    g = picks.groupBy(state).agg(F.count(pick).alias("n"), F.count_if(F.col(pick) != loop_move).alias("out"))
    return g.select(state, "n", F.when(F.col("n") > 0, F.col("out") / F.col("n")).alias("escape"))


def arm_summary(picks: DataFrame, arm: str, tier: str, flag: str) -> DataFrame:
    """Per arm: picks, mean and sample deviation (0 for one pick) of an integer tier, share of flagged picks, and the
    distribution as ``tier:count`` in order. Counted per (arm, tier) first, so an arm is a handful of rows."""
    x = F.col(tier).cast("bigint")
    g = picks.groupBy(arm, x.alias("t")).agg(F.count("*").alias("c"), F.count_if(flag).alias("f")).groupBy(arm).agg(
        F.sum("c").alias("n"), F.sum(F.col("t") * F.col("c")).cast("double").alias("s"), F.sum(F.col("t") * F.col("t") * F.col("c")).cast("double").alias("q"), F.sum("f").alias("f"),
        F.array_sort(F.collect_list(F.struct("t", "c"))).alias("d"),
    )
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))).otherwise(0.0)
    return g.select(arm, "n", (F.col("s") / F.col("n")).alias("mean"), sd.alias("sd"), (F.col("f") / F.col("n")).alias("reversal_rate"), F.array_join(F.transform("d", lambda y: F.concat(y["t"].cast("string"), F.lit(":"), y["c"].cast("string"))), " ").alias("distribution"))


def score_picks(picks: DataFrame, teacher: DataFrame, arm: str, state: str) -> DataFrame:
    """Per arm: picks, mean tier (nulls left out), illegal and foundation picks, oscillating states and how many of their
    picks agree with the teacher's, and the mean gap to the teacher where there is one."""
    j = picks.join(teacher, state, "left")
    return j.groupBy(arm).agg(
        F.count("*").alias("n"), F.avg("tier").alias("mean_tier"), F.count_if(F.col("tier") == 0).alias("illegal"), F.count_if(F.col("tier") == 6).alias("foundation"),
        F.count_if("osc").alias("osc_n"), F.count_if(F.col("osc") & (F.col("tier") == F.col("teacher"))).alias("osc_agree"), F.avg(F.col("tier") - F.col("teacher")).alias("gap"),
    )


def leaderboard(runs: DataFrame, arm: str, score: str, outcome: str) -> DataFrame:
    """Per arm: runs, wins, mean, averaging median and best score, runs without an outcome. The mean divides exact sums."""
    return runs.groupBy(F.col(arm).alias("model")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(outcome) == "won").alias("wins"),
        (F.sum(score).cast("double") / F.count(score)).alias("mean_fc"),
        F.median(score).alias("median_fc"),
        F.max(score).alias("max_fc"),
        F.count_if(F.col(outcome).isNull()).alias("unfinished"),
    )


def _best(runs: DataFrame, deck: str, arm: str, score: str) -> DataFrame:
    return runs.filter(F.col(deck).isNotNull() & F.col(arm).isNotNull()).groupBy(deck, arm).agg(F.max(score).alias("fc"))


def paired(runs: DataFrame, deck: str, arm: str, score: str, base: str) -> DataFrame:
    """Each arm against the base on the decks both played: better, tied, worse and the mean difference."""
    r = _best(runs, deck, arm, score)
    b = r.filter(F.col(arm) == base).select(deck, F.col("fc").alias("base"))
    j = r.filter(F.col(arm) != base).join(b, deck).withColumn("d", F.col("fc") - F.col("base"))
    return j.groupBy(F.col(arm).alias("model")).agg(F.count("*").alias("decks"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") == 0).alias("tied"), F.count_if(F.col("d") < 0).alias("worse"), (F.sum("d").cast("double") / F.count("*")).alias("mean_delta"))


def arm_stats(runs: DataFrame, by: list[str], score: str) -> DataFrame:
    """Count, mean and sample deviation (0 for one run) per arm and category, from integer sums."""
    x = F.col(score).cast("bigint")
    g = runs.groupBy(*by).agg(F.count(x).cast("double").alias("n"), F.sum(x).cast("double").alias("s"), F.sum(x * x).cast("double").alias("q"))
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))).otherwise(0.0)
    return g.select(F.col(by[0]).alias("arm"), F.coalesce(by[1], F.lit("(none)")).alias("category"), F.col("n").cast("bigint").alias("n"), F.try_divide("s", "n").alias("mean"), sd.alias("sd"))


def paired_bootstrap(runs: DataFrame, deck: str, arm: str, score: str, base: str, replicates: int = 5000, seed: int = 0) -> DataFrame:
    """(model, decks, delta, low, high): the observed mean difference and the elements at 2.5 and 97.5 % of the sorted
    replicate means. Draws are hashes of (seed, replicate, slot), so the result does not depend on partitioning. The
    deltas of an arm (one a deck) are gathered into an array that every task gets once; the replicates are spread over the
    cluster."""
    r = _best(runs, deck, arm, score)
    b = r.filter(F.col(arm) == base).select(deck, F.col("fc").alias("base"))
    d = r.filter(F.col(arm) != base).join(b, deck).filter("fc IS NOT NULL AND base IS NOT NULL").select(F.col(arm).alias("model"), deck, (F.col("fc") - F.col("base")).cast("double").alias("d"))
    g = d.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(deck), F.col("d")))), lambda x: x["d"]).alias("a"))
    reps = runs.sparkSession.range(replicates).select(F.col("id").cast("int").alias("rep"))
    g = reps.crossJoin(F.broadcast(g.withColumn("n", F.size("a"))))
    draw = lambda i: F.get(F.col("a"), F.pmod(F.xxhash64(F.lit(seed), F.col("model"), F.col("rep"), i), F.col("n")).cast("int"))
    total = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, i: s + draw(i))
    g = g.select("model", "n", F.aggregate("a", F.lit(0.0), lambda s, x: s + x).alias("s"), (total / F.col("n")).alias("m"))
    g = g.withColumn("k", F.row_number().over(W.partitionBy("model").orderBy("m")) - 1)
    at = lambda q: F.max(F.when(F.col("k") == int(q * replicates), F.col("m")))
    return g.groupBy("model").agg(F.max("n").alias("decks"), (F.max("s") / F.max("n")).alias("delta"), at(0.025).alias("low"), at(0.975).alias("high"))


def gates(stats: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds ``passed``: every named figure keeps its limit (>=, >, <= or <). A missing figure fails."""
    ok = F.lit(True)
    for c, (op, x) in limits.items():
        v = F.col(c)
        ok = ok & F.coalesce({">=": v >= x, ">": v > x, "<=": v <= x, "<": v < x}[op], F.lit(False))
    return stats.withColumn("passed", ok)
