"""Queries of the prompt and answer functions. Prompts and answers in the layouts of the log are put together from the
tables by plain concatenation, in Spark and in SQL alike; what must come out of them is then known from the columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import prompts as pr
from ..functions.actions import let
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


# ---------------------------------------------------------------- answers
#: Ten ways of writing an answer around a number, by rowId modulo ten.
_ANSWER = r"""CASE rowId % 10 WHEN 0 THEN '{"final_decision": {"move_index": ' || n || ', "confidence": 0.5}}'
 WHEN 1 THEN 'Let me think {"a": 1}. {"move_index": ' || n || ', "confidence": 1} then {"note": "x"}'
 WHEN 2 THEN '```json' || chr(10) || '{"move_index": ' || n || '}' || chr(10) || '```'
 WHEN 3 THEN '{"move_index": "' || n || '"}'
 WHEN 4 THEN '{' || chr(10) || '  "board_analysis": "a "hidden" card",' || chr(10) || '  "final_decision": {"move_index": ' || n || '}' || chr(10) || '}'
 WHEN 5 THEN 'The best is "move_index": ' || n || ', I think'
 WHEN 6 THEN '{"move_index": 1, "final_decision": {"move_index": ' || n || '}}'
 WHEN 7 THEN 'no answer ' || n
 WHEN 8 THEN '{"board_analysis": "b", "strategic_plan": "p", "final_decision": {"move_index": -1}}'
 ELSE '{"move_index": ' || n || '.5} or {"final_decision": {"move_index": ' || n || '}' END"""
_A = f"a AS (SELECT rowId, n, {_ANSWER} AS t FROM (SELECT rowId, rowId % 7 AS n FROM decision_recs))"


def _answers(spark, sf):
    n = (F.col("rowId") % 7).cast("string")
    b, e = F.lit("\n"), F.lit("}")
    forms = [
        F.concat(F.lit('{"final_decision": {"move_index": '), n, F.lit(', "confidence": 0.5}}')),
        F.concat(F.lit('Let me think {"a": 1}. {"move_index": '), n, F.lit(', "confidence": 1} then {"note": "x"}')),
        F.concat(F.lit("```json"), b, F.lit('{"move_index": '), n, e, b, F.lit("```")),
        F.concat(F.lit('{"move_index": "'), n, F.lit('"}')),
        F.concat(F.lit("{"), b, F.lit('  "board_analysis": "a "hidden" card",'), b, F.lit('  "final_decision": {"move_index": '), n, e, b, e),
        F.concat(F.lit('The best is "move_index": '), n, F.lit(", I think")),
        F.concat(F.lit('{"move_index": 1, "final_decision": {"move_index": '), n, F.lit("}}")),
        F.concat(F.lit("no answer "), n),
        F.lit('{"board_analysis": "b", "strategic_plan": "p", "final_decision": {"move_index": -1}}'),
        F.concat(F.lit('{"move_index": '), n, F.lit('.5} or {"final_decision": {"move_index": '), n, e),
    ]
    return table(spark, sf, "decision_recs", "rowId").select("rowId", F.get(F.array(*forms), (F.col("rowId") % 10).cast("int")).alias("t"))


@query(f"WITH {_A} SELECT rowId, CAST(CASE rowId % 10 WHEN 8 THEN -1 WHEN 9 THEN n WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 7 THEN NULL ELSE n END AS INT) AS idx FROM a")
def answer_index(spark, sf):
    """The last object that has an index, the nested key first."""
    return _answers(spark, sf).select("rowId", pr.move_index(F.col("t")).alias("idx"))


@query(f"WITH {_A} SELECT rowId, CAST(CASE rowId % 10 WHEN 8 THEN -1 WHEN 9 THEN n WHEN 6 THEN 1 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 7 THEN NULL ELSE n END AS INT) AS idx FROM a")
def answer_index_flat_first(spark, sf):
    return _answers(spark, sf).select("rowId", pr.move_index_flat_first(F.col("t")).alias("idx"))


@query(f"WITH {_A} SELECT rowId, CAST(CASE rowId % 10 WHEN 8 THEN -1 WHEN 9 THEN n WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 7 THEN NULL ELSE n END AS INT) AS idx, CASE rowId % 10 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 END::DOUBLE AS confidence, rowId % 10 NOT IN (3, 4, 5, 7) AS ok FROM a")
def answer_confidence(spark, sf):
    return _answers(spark, sf).select("rowId", pr.move_and_confidence(F.col("t")).alias("x")).select("rowId", "x.idx", "x.confidence", "x.ok")


@query(f"""WITH {_A} SELECT rowId, CAST(CASE rowId % 10 WHEN 0 THEN n WHEN 4 THEN n WHEN 6 THEN n WHEN 8 THEN -1 WHEN 9 THEN n WHEN 3 THEN NULL WHEN 7 THEN NULL ELSE n END AS INT) AS idx,
 CASE rowId % 10 WHEN 0 THEN 'strict' WHEN 6 THEN 'strict' WHEN 8 THEN 'strict' WHEN 4 THEN 'repair' WHEN 3 THEN NULL WHEN 7 THEN NULL ELSE 'field' END AS via, rowId % 10 NOT IN (3, 7) AS ok,
 CASE rowId % 10 WHEN 4 THEN 'a "hidden" card' WHEN 8 THEN 'b' END AS board_analysis FROM a""")
def answer_tiers(spark, sf):
    """Strict, repaired or salvaged decisions."""
    return _answers(spark, sf).select("rowId", pr.decision(F.col("t")).alias("d")).select("rowId", "d.idx", "d.via", "d.ok", "d.board_analysis")


@query(f"WITH {_A} SELECT rowId, CAST(CASE rowId % 10 WHEN 0 THEN n WHEN 2 THEN n WHEN 3 THEN n WHEN 6 THEN 1 WHEN 8 THEN -1 END AS INT) AS idx FROM a")
def answer_fenced(spark, sf):
    """The widest braces of an answer without its code fence; digits as text count."""
    return _answers(spark, sf).select("rowId", pr.fenced_move_index(F.col("t")).alias("idx"))


@query(f"WITH {_A} SELECT rowId, CAST(CASE rowId % 10 WHEN 0 THEN n WHEN 6 THEN n WHEN 8 THEN -1 END AS INT) AS idx, rowId % 10 = 8 AS ok FROM a")
def answer_evaluated(spark, sf):
    return _answers(spark, sf).select("rowId", pr.evaluated(F.col("t")).alias("x")).select("rowId", "x.idx", "x.ok")


@query("""SELECT rowId, CASE rowId % 4 WHEN 0 THEN 'raw a' WHEN 1 THEN 'dec a' WHEN 2 THEN 'dec b' END AS analysis, CASE rowId % 4 WHEN 0 THEN 'raw p' WHEN 1 THEN 'why' WHEN 2 THEN 'plan' END AS plan,
 CASE WHEN rowId % 4 < 3 THEN '{"board_analysis":"' || CASE rowId % 4 WHEN 0 THEN 'raw a' WHEN 1 THEN 'dec a' WHEN 2 THEN 'dec b' END || '","strategic_plan":"' || CASE rowId % 4 WHEN 0 THEN 'raw p' WHEN 1 THEN 'why' WHEN 2 THEN 'plan' END || '","final_decision":{"move_index":' || rowId % 5 || '}}' END AS answer FROM decision_recs""")
def response_prose(spark, sf):
    """Prose of an answer from the raw text or the parsed decision, written back as an answer."""
    k = (F.col("rowId") % 4).cast("int")
    raw = F.get(F.array(F.lit('{"board_analysis": "raw a", "strategic_plan": "raw p"}'), F.lit("not json"), F.lit('{"board_analysis": ""}'), F.lit(None)), k)
    dec = F.get(F.array(F.lit('{"reasoning": "x"}'), F.lit('{"boardAnalysis": "dec a", "reasoning": "why"}'), F.lit('{"board_analysis": "dec b", "strategicPlan": "plan"}'), F.lit('{"boardAnalysis": "alone"}')), k)
    d = table(spark, sf, "decision_recs", "rowId").select("rowId", pr.response_prose(raw, dec).alias("p"))
    return d.select("rowId", "p.analysis", "p.plan", F.when(F.col("p").isNotNull(), pr.response_text((F.col("rowId") % 5).cast("int"), F.col("p.analysis"), F.col("p.plan"))).alias("answer"))


# ---------------------------------------------------------------- boards of sft prompts
_JSON = r"regexp_extract(prompt, '(?s)CURRENT GAME \(JSON\):\s*(\{.*\})', 1)"


@query(rf"""SELECT exampleId, CAST(json_array_length({_JSON}, '$.legalMoves') AS INT) AS options, CAST(list_sum(CAST(json_extract_string({_JSON}, '$.tableau[*].faceDownCount') AS INT[])) AS INT) AS hidden,
 {_JSON}->>'$.legalMoves[0].describe' AS first_move FROM sft_examples WHERE json_valid({_JSON})""")
def json_games(spark, sf):
    """Boards of prompts with a JSON board."""
    e = table(spark, sf, "sft_examples", "exampleId", "prompt").filter(pr.json_board(F.col("prompt")).isNotNull())
    e = e.select("exampleId", pr.game(F.col("prompt")).alias("g"))
    return e.select("exampleId", F.size("g.legalMoves").alias("options"), pr.progress_components(F.col("g"))["fd"].alias("hidden"), F.get("g.legalMoves", F.lit(0))["describe"].alias("first_move"))


@query(rf"""SELECT exampleId, CAST(json_array_length({_JSON}, '$.legalMoves') AS INT) AS options, 0 AS recent, CAST(json_array_length({_JSON}, '$.legalMoves') AS INT) AS counted FROM sft_examples WHERE json_valid({_JSON})""")
def legacy_states(spark, sf):
    """States behind the marker by balanced braces, and the moves counted by balanced brackets."""
    e = table(spark, sf, "sft_examples", "exampleId", "prompt").filter(pr.json_board(F.col("prompt")).isNotNull())
    e = e.select("exampleId", pr.legacy_state(F.col("prompt")).alias("s"), pr.legal_move_count(F.col("prompt")).alias("counted"))
    return e.select("exampleId", F.size("s.legal").alias("options"), F.size("s.recent").alias("recent"), "counted")


_BLOCK = "split_part(split_part(prompt, 'TABLEAU:', 2), 'WASTE:', 1)"
_FLINE = "split_part(substr(prompt, instr(prompt, 'FOUNDATIONS:')), chr(10), 1)"


@query(rf"""WITH x AS (SELECT exampleId, list_filter(regexp_extract_all({_FLINE}, '\b[HDCS]:\s*([AKQJT2-9][HDCS])', 1), lambda y: y <> '') AS tops, prompt FROM sft_examples WHERE contains(prompt, 'FOUNDATIONS:') AND contains(prompt, chr(10) || 'TABLEAU:' || chr(10)))
SELECT exampleId, CAST(coalesce(list_sum(list_transform(tops, lambda y: instr('A23456789TJQK', left(y, 1)))), 0) AS INT) AS fc, CAST((length({_BLOCK}) - length(replace({_BLOCK}, '??', ''))) / 2 AS INT) AS fd,
 CAST(len(regexp_extract_all(prompt, '\n\s*\[\d+\]\s+\S+\s+\S')) AS INT) AS options FROM x""")
def text_games(spark, sf):
    """Boards of prompts in text blocks."""
    e = table(spark, sf, "sft_examples", "exampleId", "prompt").filter(F.contains("prompt", F.lit("FOUNDATIONS:")) & F.contains("prompt", F.lit("\nTABLEAU:\n")))
    e = e.select("exampleId", pr.text_game(F.col("prompt")).alias("g")).withColumn("p", pr.progress_components(F.col("g")))
    return e.select("exampleId", "p.fc", "p.fd", F.size("g.legalMoves").alias("options"))


@query(r"""SELECT exampleId, CAST(len(regexp_extract_all(prompt, '\n\s*\[\d+\]\s+\S+\s+\S')) AS INT) AS options, CAST(len(regexp_extract_all(prompt, '\n  - ')) AS INT) AS recent, trim(regexp_extract(prompt, '\n\s*\[0\]\s+\S+\s+([^\n]+)', 1)) AS first_move,
 CAST(len(regexp_extract_all(prompt, '\n\s*\[\d+\]\s+\S+\s+\S')) AS INT) AS listed FROM sft_examples WHERE contains(prompt, 'FOUNDATIONS:') AND regexp_matches(prompt, 'LEGAL MOVES \(choose one\):\n\s*\[0\]')""")
def hybrid_states(spark, sf):
    """States of text blocks, with the block titles as the log writes them."""
    e = table(spark, sf, "sft_examples", "exampleId", "prompt").filter(F.contains("prompt", F.lit("FOUNDATIONS:")) & F.col("prompt").rlike(r"LEGAL MOVES \(choose one\):\n\s*\[0\]"))
    p = F.regexp_replace(F.replace("prompt", F.lit("LEGAL MOVES (choose one):"), F.lit("LEGAL MOVES (respond with the index):")), "RECENT MOVES:\n", "RECENT MOVES (oldest -> newest):\n")
    p = F.regexp_replace(p, "\n  - ", "\n   1. ")
    e = e.select("exampleId", pr.state(p).alias("s"), pr.listed_moves(p).alias("l"))
    return e.select("exampleId", F.size("s.legal").alias("options"), F.size("s.recent").alias("recent"), F.get("s.legal", F.lit(0))["describe"].alias("first_move"), F.size("l").alias("listed"))


@query(rf"""WITH x AS (SELECT exampleId, {_JSON} AS j FROM sft_examples WHERE json_valid({_JSON})), k AS (SELECT *, count(*) OVER (PARTITION BY j->>'$.foundations', j->>'$.tableau', j->>'$.waste', j->>'$.stock') AS same_board FROM x)
SELECT exampleId, j->>'$.waste' AS top, CAST(j->>'$.stock' AS INT) AS stock, 7 AS columns, same_board FROM k""")
def board_keys(spark, sf):
    """Observable boards and how often each occurs, by key."""
    e = table(spark, sf, "sft_examples", "exampleId", "prompt").filter(pr.json_board(F.col("prompt")).isNotNull()).select("exampleId", pr.board(F.col("prompt")).alias("b"), pr.board_key(F.col("prompt")).alias("k"))
    n = e.groupBy("k").agg(F.count("*").alias("same_board"))
    return e.join(n, "k").select("exampleId", F.col("b.discardTop").alias("top"), F.col("b.drawPileCount").alias("stock"), F.size("b.tableau").alias("columns"), "same_board")


@query(rf"""WITH x AS (SELECT exampleId, {_JSON} AS j FROM sft_examples WHERE json_valid({_JSON})), k AS (SELECT exampleId, row_number() OVER (PARTITION BY j->>'$.foundations', j->>'$.tableau', j->>'$.waste', j->>'$.stock', json_extract_string(j, '$.legalMoves[*].describe') ORDER BY exampleId) AS r FROM x) SELECT exampleId FROM k WHERE r = 1""")
def distinct_states(spark, sf):
    """The first example of every state: board and texts of the legal moves."""
    e = table(spark, sf, "sft_examples", "exampleId", "prompt").filter(pr.json_board(F.col("prompt")).isNotNull()).select("exampleId", pr.state_hash(F.col("prompt")).alias("h"))
    return e.groupBy("h").agg(F.min("exampleId").alias("exampleId")).select("exampleId")


# ---------------------------------------------------------------- reversals, tiers, kinds
#: Recent and legal moves from a row number: from and to of the past move (a, b) and of the chosen one (x, y).
_M = """m AS (SELECT rowId, rowId % 3 + 1 AS a, rowId // 3 % 3 + 4 AS b, CASE WHEN rowId % 4 < 2 THEN rowId // 3 % 3 + 4 ELSE 7 END AS x, rowId % 3 + 1 AS y, rowId % 5 AS k, rowId % 11 AS old FROM decision_recs)"""


def _moves(spark, sf):
    r = F.col("rowId")
    third = F.floor(r / 3)
    d = table(spark, sf, "decision_recs", "rowId").select("rowId", (r % 3 + 1).alias("a"), (third % 3 + 4).alias("b"), F.when(r % 4 < 2, third % 3 + 4).otherwise(7).alias("x"), (r % 3 + 1).alias("y"), (r % 5).alias("k"), (r % 11).alias("old"))
    s = lambda c: F.col(c).cast("string")
    past = F.concat(F.lit("move 7H col "), s("a"), F.lit(" -> col "), s("b"))
    recent = F.array(F.lit("move 2S col 9 -> col 8"), F.when(F.col("old") == 0, F.lit("7H waste -> col 3")).otherwise(past), F.lit("draw 5C"))
    describe = F.when(F.col("k") == 1, F.concat(F.lit("7H col "), s("x"), F.lit(" to col "), s("y"))).when(F.col("k") == 2, F.concat(F.lit("Column "), s("x"), F.lit(" to column "), s("y"))).otherwise(F.concat(F.lit("Move 7H from column "), s("x"), F.lit(" to column "), s("y")))
    kind = F.when(F.col("k") == 4, "discard_to_tableau").otherwise("tableau_to_tableau")
    legal = F.array(F.struct(F.lit("draw_card").alias("type"), F.lit("Draw the next card").alias("describe")), F.struct(kind.alias("type"), describe.alias("describe")))
    return d.select("rowId", F.struct(legal.alias("legal"), recent.alias("recent")).alias("s"))


@query(f"""WITH {_M}, r AS (SELECT *, CASE WHEN old = 0 THEN x = 8 AND y = 9 ELSE x = b AND y = a END AS back FROM m) SELECT rowId, back AND k <> 4 AS reversal, back AND k <> 2 AS two_needles, back AND k <> 2 AS could_go_back, false AS drawing FROM r""")
def reversal_flags(spark, sf):
    """Whether a chosen move takes the latest column-to-column move back, in two readings, and whether one could."""
    d = _moves(spark, sf)
    s = F.col("s")
    return d.select("rowId", pr.is_reversal(s, F.lit(1)).alias("reversal"), pr.is_reversal(s, F.lit(1), typed=False, anchored=True, bare=False).alias("two_needles"), pr.looks_like_oscillation(s).alias("could_go_back"), pr.is_reversal(s, F.lit(0)).alias("drawing"))


@query(f"""WITH {_M}, r AS (SELECT *, CASE WHEN old = 0 THEN x = 8 AND y = 9 ELSE x = b AND y = a END AS back FROM m) SELECT count(*) AS input_rows, count(*) FILTER (WHERE k = 3) AS unparseable, count(*) FILTER (WHERE back AND k NOT IN (3, 4)) AS dropped, count(*) - count(*) FILTER (WHERE back AND k NOT IN (3, 4)) AS kept FROM r""")
def reversal_filter(spark, sf):
    """Only confirmed reversals are dropped; rows whose prompt cannot be read are kept."""
    d = _moves(spark, sf).withColumn("s", F.when(F.col("rowId") % 5 != 3, F.col("s")))
    drop = F.coalesce(pr.is_reversal(F.col("s"), F.lit(1)), F.lit(False))
    return d.agg(F.count("*").alias("input_rows"), F.count_if(F.col("s").isNull()).alias("unparseable"), F.count_if(drop).alias("dropped"), F.count_if(~drop).alias("kept"))


_PICK = """p AS (SELECT rowId, rowId % 9 AS i, rowId % 4 AS fd, rowId // 4 % 3 AS up, rowId // 12 % 3 AS more FROM decision_recs),
t AS (SELECT *, CASE i WHEN 0 THEN 'foundation' WHEN 1 THEN 'foundation' WHEN 2 THEN 'draw' WHEN 3 THEN 'recycle' WHEN 4 THEN 'waste_play' WHEN 5 THEN CASE WHEN fd > 0 AND more + 1 >= up THEN 'reveal' ELSE 'shuffle' END WHEN 6 THEN 'shuffle' WHEN 7 THEN 'shuffle' ELSE 'illegal' END AS tier FROM p)"""


@query(f"WITH {_PICK} SELECT rowId, tier, CASE tier WHEN 'foundation' THEN 6 WHEN 'reveal' THEN 5 WHEN 'waste_play' THEN 4 WHEN 'shuffle' THEN 2 WHEN 'illegal' THEN 0 ELSE 1 END AS rank, tier IN ('foundation', 'reveal', 'waste_play') AS quality FROM t")
def pick_tiers(spark, sf):
    """Tiers of chosen moves by type, hidden cards and length of the run."""
    r = F.col("rowId")
    more = F.floor(r / 12) % 3
    plus = F.when(more > 0, F.concat(F.lit(" plus "), more.cast("string"), F.lit(" more"))).otherwise("")
    legal = [("tableau_to_foundation", F.lit("Send 2H")), ("discard_to_foundation", F.lit("Send 3H")), ("draw_card", F.lit("Draw")), ("recycle_stock", F.lit("Recycle")), ("discard_to_tableau", F.lit("Move 4S from the waste to column 2")), ("tableau_to_tableau", F.concat(F.lit("Move 7H"), plus, F.lit(" from column 3 to column 5"))), ("tableau_to_tableau", F.lit("Move 7H from column 6 to column 5")), ("tableau_to_tableau", F.lit("Move 7H"))]
    legal = F.array(*[F.struct(F.lit(t).alias("type"), d.alias("describe")) for t, d in legal])
    cards = F.slice(F.array(F.lit("9S"), F.lit("8D")), F.lit(1), (F.floor(r / 4) % 3).cast("int"))
    tab = F.array(F.struct(F.lit(3).alias("column"), (r % 4).cast("int").alias("faceDownCount"), cards.alias("faceUp")), F.struct(F.lit(6).alias("column"), F.lit(0).alias("faceDownCount"), cards.alias("faceUp")))
    d = table(spark, sf, "decision_recs", "rowId").select("rowId", pr.classify_pick(legal, (r % 9).cast("int"), tab).alias("tier"))
    return d.select("rowId", "tier", pr.tier_rank(F.col("tier")).alias("rank"), pr.is_quality(F.col("tier")).alias("quality"))


@query("""WITH k AS (SELECT CASE rowId % 7 WHEN 0 THEN 'resign' WHEN 1 THEN '?' WHEN 2 THEN 'foundation' WHEN 3 THEN 'draw' WHEN 4 THEN 'recycle' WHEN 5 THEN 'tableau' ELSE '?' END AS kind FROM decision_recs)
SELECT kind, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS share, kind = 'draw' AND 100.0 * count(*) / sum(count(*)) OVER () < 25 AS low_draw FROM k GROUP BY kind""")
def move_kind_mix(spark, sf):
    """Kinds of the moves that completions teach and their shares; a warning when draws fall below a quarter."""
    legal = F.array(*[F.struct(F.lit("t").alias("type"), F.lit(d).alias("describe")) for d in ("Send 2H to the hearts foundation", "Draw the next card", "Recycle the waste", "Move 7H from column 3 to column 5")])
    idx = F.get(F.array(*[F.lit(x) for x in ("-1", "9", "0", "1", "2", "3")]), (F.col("rowId") % 7).cast("int"))
    completion = F.coalesce(F.concat(F.lit('{"final_decision": {"move_index": '), idx, F.lit("}}")), F.lit("broken {"))
    g = table(spark, sf, "decision_recs", "rowId").select(pr.move_kind(legal, completion).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    total = F.sum("n").over(_all())
    return g.select("kind", "n", (100.0 * F.col("n") / total).alias("share"), ((F.col("kind") == "draw") & (100.0 * F.col("n") / total < 25)).alias("low_draw"))


def _all():
    from pyspark.sql import Window as W

    return W.partitionBy()


@query(f"""WITH {_M}, r AS (SELECT *, CASE WHEN old = 0 THEN x = 8 AND y = 9 ELSE x = b AND y = a END AS back FROM m) SELECT rowId, CASE WHEN k IN (0, 1) THEN 3 ELSE 2 END AS chosen, CASE WHEN back THEN 1 ELSE 0 END AS rejected FROM r WHERE k IN (0, 1, 2)""")
def preference_pairs(spark, sf):
    """A move worth making against a plain one, a reversal first; positions without both give none."""
    d = _moves(spark, sf).withColumn("k", F.col("rowId") % 5)
    s = F.col("s")
    mv = lambda t, x: F.struct(F.lit(t).alias("type"), F.lit(x).alias("describe"))
    plain = mv("tableau_to_tableau", "Move KS from column 1 to column 2")
    reveal = mv("tableau_to_tableau", "Move QS from column 1 to column 2 (reveals a hidden card)")
    extra = F.when(F.col("k") < 2, F.array(reveal, mv("tableau_to_foundation", "Send AS to the spades foundation"))).when(F.col("k") == 2, F.array(reveal)).otherwise(F.array(mv("draw_card", "Draw")))
    legal = F.concat(F.array(plain), F.slice(s["legal"], 2, 1), extra)
    d = d.select("rowId", pr.preference_moves(F.struct(legal.alias("legal"), s["recent"].alias("recent"))).alias("p"))
    return d.filter("p IS NOT NULL").select("rowId", F.col("p.chosen").cast("int").alias("chosen"), F.col("p.rejected").cast("int").alias("rejected"))


# ---------------------------------------------------------------- buckets
_S = """x AS (SELECT rowId, CAST(rowId % 22 AS INT) AS fd, CAST(rowId % 101 AS INT) AS prog, rowId // 22 % 9 AS n, rowId % 5 AS swap FROM decision_recs)"""


@query(f"""WITH {_S}, s AS (SELECT *, CAST(CASE WHEN swap = 0 THEN n + 2 ELSE n END AS INT) AS n_recent FROM x) SELECT rowId, fd, prog, n_recent, CASE WHEN n_recent > 0 THEN CAST(n AS DOUBLE) / n_recent ELSE 0.0 END AS stall_ratio, swap = 0 AS reversal,
 CASE WHEN (n_recent >= 6 AND CAST(n AS DOUBLE) / n_recent >= 0.7) OR swap = 0 THEN 'oscillation' WHEN fd >= 18 THEN 'early' WHEN fd >= 10 THEN 'midgame' ELSE 'endgame' END AS bucket FROM s""")
def prompt_states(spark, sf):
    """Progress, idle share and swings read from a prompt, and the bucket they make."""
    r = F.col("rowId")
    n = (F.floor(r / 22) % 9).cast("int")
    idle = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("   "), i.cast("string"), F.lit(". draw 5C\n")))).otherwise(F.array().cast("array<string>"))
    swap = F.when(r % 5 == 0, F.array(F.lit("  8. move 7H col 1 -> col 2\n"), F.lit("  9. move 7H col 2 -> col 1\n"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(idle, swap)
    p = F.concat(F.when(F.size(lines) > 0, F.concat(F.lit("RECENT MOVES (oldest -> newest):\n"), F.array_join(lines, ""))).otherwise(""), F.lit("\nPROGRESS: foundation=3/52, face-down remaining="), (r % 22).cast("string"), F.lit(", completion="), (r % 101).cast("string"), F.lit("%\n"))
    d = table(spark, sf, "decision_recs", "rowId").select("rowId", pr.prompt_state(p).alias("s"))
    return d.select("rowId", "s.fd", "s.prog", "s.n_recent", "s.stall_ratio", "s.reversal", pr.spaced_bucket(F.col("s")).alias("bucket"))


@query(f"""WITH {_M}, r AS (SELECT *, rowId % 22 AS fd, k <> 2 AND CASE WHEN old = 0 THEN x = 8 AND y = 9 ELSE x = b AND y = a END AS back FROM m)
SELECT rowId, CASE WHEN rowId % 13 = 0 THEN NULL WHEN back THEN 'oscillation' WHEN fd <= 4 THEN 'endgame' WHEN fd >= 18 THEN 'early' WHEN fd BETWEEN 10 AND 15 THEN 'midgame' END AS bucket, true AS has_history FROM r""")
def state_buckets(spark, sf):
    """Kind of position; nothing to choose gives none."""
    d = _moves(spark, sf)
    s = F.when(F.col("rowId") % 13 == 0, F.struct(F.slice("s.legal", 1, 1).alias("legal"), F.col("s.recent").alias("recent"))).otherwise(F.col("s"))
    return d.select("rowId", let(s, lambda x: pr.bench_bucket(x, F.col("rowId") % 22)).alias("bucket"), pr.has_min_history(F.col("s"), 3).alias("has_history"))


# ---------------------------------------------------------------- rendering
@query("""WITH x AS (SELECT rowId, prompt->'$.observation' AS o FROM decision_recs WHERE prompt IS NOT NULL), t AS (SELECT rowId, o, list_transform(range(1, 8), lambda i: '  col' || i || ': ' || coalesce(nullif(trim(repeat('?? ', CAST(o->>('$.tableau[' || (i - 1) || '].faceDownCount') AS INT)) || (o->>('$.tableau[' || (i - 1) || '].faceUp'))), ''), '<empty>')) AS cols FROM x)
SELECT rowId, 'NOTATION: rank+suit (A 2-9 T J Q K; H D C S). ?? = face-down. In each column the top of the stack is the rightmost card.' || chr(10) || chr(10) || 'FOUNDATIONS: H: ' || (o->>'$.foundations.H') || '   D: ' || (o->>'$.foundations.D') || '   C: --   S: --' || chr(10) || 'STOCK: ' || (o->>'$.stock') || ' cards   WASTE top: ' || coalesce(o->>'$.waste', '--') || '   recycle stock: no' || chr(10) || chr(10)
 || 'TABLEAU:' || chr(10) || array_to_string(cols, chr(10)) || chr(10) || chr(10) || 'RECENT MOVES (oldest -> newest; review before picking, do not undo your own work):' || chr(10) || '   1. draw 5C' || chr(10) || '   2. recycle stock' || chr(10) || chr(10)
 || 'LEGAL MOVES (respond with the index of your chosen move):' || chr(10) || '  [0] draw_card                Draw' || chr(10) || chr(10) || 'PROGRESS: foundation=3/52, face-down remaining=4, completion=6%' AS txt FROM t""")
def rendered_prompts(spark, sf):
    """Text blocks of a prompt's board."""
    o = F.from_json("prompt", "observation struct<foundations:map<string,string>,tableau:array<struct<faceDownCount:int,faceUp:string>>,waste:string,stock:int>")["observation"]
    d = table(spark, sf, "decision_recs", "rowId", "prompt").filter("prompt IS NOT NULL").select("rowId", o.alias("o"))
    tab = F.transform("o.tableau", lambda c, i: F.struct((i + 1).alias("column"), c["faceDownCount"].alias("faceDownCount"), F.filter(F.split(c["faceUp"], " "), lambda x: x != "").alias("faceUp")))
    f = F.create_map(F.lit("hearts"), F.try_element_at("o.foundations", F.lit("H")), F.lit("diamonds"), F.try_element_at("o.foundations", F.lit("D")))
    b = F.struct(f.alias("foundations"), tab.alias("tableau"), F.col("o.waste").alias("discardTop"), F.col("o.stock").alias("drawPileCount"), F.lit(False).alias("canRecycleStock"), F.array(F.lit("draw 5C"), F.lit("recycle stock")).alias("recent"), F.array().cast("array<string>").alias("seen"),
        F.array(F.struct(F.lit("draw_card").alias("type"), F.lit("Draw").alias("describe"))).alias("legal"), F.lit(3).alias("fc"), F.lit(4).alias("fd"), F.lit(6).alias("completion"))
    return d.select("rowId", pr.hybrid_text(b).alias("txt"))


@query("""SELECT rowId, 'Rules.' || chr(10) || 'PRIOR REASONING (may be obsolete):' || chr(10) || '  1. move: draw' || chr(10) || '  2. move: recycle' || chr(10) || 'Now choose. Row ' || rowId AS txt, CASE WHEN rowId % 3 = 1 THEN ' (+2)' WHEN rowId % 3 = 2 THEN ' (-2)' ELSE '' END AS delta FROM decision_recs""")
def prior_reasons_cut(spark, sf):
    """Prior reasoning without its explanations; and changes of counts as text."""
    r = F.col("rowId")
    p = F.concat(F.lit("Rules.\nPRIOR REASONING (may be obsolete):\n  1. move: draw\n     why: because of "), r.cast("string"), F.lit("\n second line\n  2. move: recycle\n     why: the stock is out\nNow choose. Row "), r.cast("string"))
    d = F.when(r % 3 == 1, 7).when(r % 3 == 2, 3).otherwise(5)
    return table(spark, sf, "decision_recs", "rowId").select("rowId", pr.without_prior_reasons(p).alias("txt"), pr.delta_text(d, F.lit(5)).alias("delta"))


_P0 = """'You are an expert.' || chr(10) || 'KLONDIKE SOLITAIRE RULES: ...' || chr(10) || 'RESPONSE FORMAT:' || chr(10) || 'long. Produce the keys in the order above: look, then decide.' || chr(10) || chr(10) || 'CURRENT GAME (JSON):' || chr(10) || '{"notation": "n' || rowId || '", "stock": 3, "reasoningTrail": "t' || rowId || '"}'"""


@query(f"""WITH p AS (SELECT rowId, {_P0} AS c FROM decision_recs) SELECT rowId, a.arm, CASE a.arm WHEN 'C0' THEN c WHEN 'A1' THEN replace(c, ', "reasoningTrail": "t' || rowId || '"', '') WHEN 'A2' THEN replace(c, 'RESPONSE FORMAT:' || chr(10) || 'long. Produce the keys in the order above: look, then decide.', 'RESPONSE FORMAT: short')
 WHEN 'A3' THEN replace(replace(c, ', "reasoningTrail": "t' || rowId || '"', ''), 'RESPONSE FORMAT:' || chr(10) || 'long. Produce the keys in the order above: look, then decide.', 'RESPONSE FORMAT: short') ELSE replace(replace(c, '"notation": "n' || rowId || '", ', ''), 'KLONDIKE', 'NOTATION first.' || chr(10) || 'KLONDIKE') END AS txt
 FROM p, (VALUES ('C0'), ('A1'), ('A2'), ('A3'), ('A4')) a(arm)""")
def prompt_arms(spark, sf):
    """A prompt in the five arms."""
    r = F.col("rowId").cast("string")
    p = F.concat(F.lit('You are an expert.\nKLONDIKE SOLITAIRE RULES: ...\nRESPONSE FORMAT:\nlong. Produce the keys in the order above: look, then decide.\n\nCURRENT GAME (JSON):\n{"notation": "n'), r, F.lit('", "stock": 3, "reasoningTrail": "t'), r, F.lit('"}'))
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), pr.render_arm(a, p, "RESPONSE FORMAT: short", "NOTATION first.\n").alias("txt")) for a in pr.ARMS])
    return table(spark, sf, "decision_recs", "rowId").select("rowId", F.explode(arms).alias("x")).select("rowId", "x.*")


@query("""SELECT rowId, CASE WHEN rowId % 4 > 0 THEN 'STALL: no foundation play and no new card revealed in the last ' || rowId % 4 || ' moves.' ELSE '' END || '|' || CASE WHEN rowId % 3 > 0 THEN 'REPEAT: this exact board position has already occurred ' || rowId % 3 || ' time(s) earlier this game.' ELSE '' END AS lines FROM decision_recs""")
def stall_texts(spark, sf):
    """The lines that state a stall and a repeated position, from one on."""
    x = pr.stall_lines(F.col("rowId") % 4, F.col("rowId") % 3)
    parts = let(x, lambda a: F.concat(F.coalesce(F.get(F.filter(a, lambda y: y.startswith("STALL")), F.lit(0)), F.lit("")), F.lit("|"), F.coalesce(F.get(F.filter(a, lambda y: y.startswith("REPEAT")), F.lit(0)), F.lit(""))))
    return table(spark, sf, "decision_recs", "rowId").select("rowId", parts.alias("lines"))


@query("""SELECT rowId, CASE rowId % 6 WHEN 0 THEN 'draw 5C' WHEN 1 THEN 'recycle stock' WHEN 2 THEN 'move 7H col 3 -> col 5' WHEN 3 THEN '7H col 3 -> hearts foundation' WHEN 4 THEN '7H waste -> col 5' ELSE '7H waste -> hearts foundation' END AS line FROM decision_recs""")
def recent_lines(spark, sf):
    """Past moves in compact form."""
    kinds = ["stock_to_waste", "recycle_stock", "tableau_to_tableau", "tableau_to_foundation", "waste_to_tableau", "waste_to_foundation"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("rowId") % 6).cast("int"))
    h = F.struct(kind.alias("engine_move_type"), F.when(kind == "stock_to_waste", "5C").otherwise("7H").alias("card"), F.lit(3).alias("from_col"), F.lit(5).alias("to_col"), F.lit("hearts").alias("foundation_suit"))
    return table(spark, sf, "decision_recs", "rowId").select("rowId", pr.recent_line(h).alias("line"))


# ---------------------------------------------------------------- aggregates over picks
@query(f"""WITH {_PICK}, r AS (SELECT t.tier AS a, CASE WHEN rowId % 4 = 0 THEN t.tier WHEN rowId % 2 = 0 THEN 'draw' ELSE 'foundation' END AS b, rowId FROM t),
k AS (SELECT *, CASE a WHEN 'foundation' THEN 6 WHEN 'reveal' THEN 5 WHEN 'waste_play' THEN 4 WHEN 'shuffle' THEN 2 WHEN 'illegal' THEN 0 ELSE 1 END AS ra, CASE b WHEN 'foundation' THEN 6 WHEN 'reveal' THEN 5 WHEN 'waste_play' THEN 4 WHEN 'shuffle' THEN 2 WHEN 'illegal' THEN 0 ELSE 1 END AS rb FROM r)
SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS agree, CAST(count(*) FILTER (WHERE a = b) AS DOUBLE) / count(*) AS agreement_rate, count(*) FILTER (WHERE rb > ra) AS better, count(*) FILTER (WHERE rb < ra) AS worse, count(*) FILTER (WHERE ra = rb) AS tied FROM k""")
def ab_summary(spark, sf):
    """Two arms' picks on the same positions: agreement, and where the second is better, worse or tied."""
    d = pick_tiers(spark, sf).select("rowId", F.col("tier").alias("a"))
    d = d.withColumn("b", F.when(F.col("rowId") % 4 == 0, F.col("a")).when(F.col("rowId") % 2 == 0, "draw").otherwise("foundation"))
    x, y = pr.tier_rank(F.col("a")), pr.tier_rank(F.col("b"))
    same: Column = F.col("a") == F.col("b")
    return d.agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), (F.count_if(same) / F.count("*")).alias("agreement_rate"), F.count_if(y > x).alias("better"), F.count_if(y < x).alias("worse"), F.count_if(x == y).alias("tied"))
