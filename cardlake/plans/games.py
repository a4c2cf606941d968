"""Queries of game sessions: actions folded onto deals, session documents, and sessions as the state of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as bd
from ..operators import gamesession as gs
from ..session import shared_place
from .boards import C, deals

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Actions of every session, by its seed: draws, and a recycle whenever the stock is empty. After k of them at a draw of d
#: a pass takes ceil(24 / d) draws and one recycle.
_N = "CAST(20 + seed % 40 AS INT)"
_W = f"""{C}, a AS (SELECT seed, CAST(CASE WHEN seed % 2 = 0 THEN 1 ELSE 3 END AS INT) AS d, {_N} AS n FROM s), w AS (SELECT *, CASE d WHEN 1 THEN 25 ELSE 9 END AS pass FROM a), x AS (SELECT *, n % pass AS k, n // pass AS redeals FROM w),
f AS (SELECT *, least(24, k * d) AS waste, n + redeals * 0 AS moves FROM x)"""


def _indexes(d, n):
    """-1 draws, -2 recycles."""
    per = F.when(d == 1, 25).otherwise(9)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i % per == 0, -2).otherwise(-1))


def _played(spark, sf):
    d = F.when(F.col("seed") % 2 == 0, 1).otherwise(3)
    n = (20 + F.col("seed") % 40).cast("int")
    g = deals(spark, sf).withColumn("d", d).withColumn("n", n)
    return g.select("seed", "d", "board", gs.play(gs.session(F.col("board"), F.col("d")), _indexes(F.col("d"), F.col("n"))).alias("r"))


@query(f"""WITH {_W} SELECT f.seed, f.d AS draw_count, CAST(f.n AS INT) AS moves, CAST(f.redeals AS INT) AS redeals, CAST(f.waste AS INT) AS waste, CAST(24 - f.waste AS INT) AS stock, c.rank || left(c.suit, 1) AS top FROM f LEFT JOIN c ON c.seed = f.seed AND c.pile_kind = 'stock' AND c.pos = 24 - f.waste""")
def session_plays(spark, sf):
    """Twenty to sixty draws and recycles per deal, applied one by one."""
    b = F.col("r.session.board")
    t = bd.top(b["waste"])
    return _played(spark, sf).select("seed", F.col("d").alias("draw_count"), b["move_count"].alias("moves"), F.col("r.session.redeals").alias("redeals"), F.size(b["waste"]).alias("waste"), F.size(b["stock"]).alias("stock"), F.when(t.isNotNull(), F.concat(t["rank"].cast("string"), F.substring(t["suit"], 1, 1))).alias("top"))


@query(f"""WITH {_W}, e AS (SELECT seed, d, pass, CAST(i AS INT) AS seq FROM w, range(1, 61) q(i) WHERE i <= n) SELECT seed, seq, CASE WHEN seq % pass = 0 THEN 'recycle' ELSE 'draw' END AS kind, CASE WHEN seq % pass = 0 THEN 'Recycle the waste pile back into the stock' ELSE 'Draw ' || d || ' card(s) from stock' END AS description, seq AS move_count, false AS won, true AS ok FROM e""")
def session_action_log(spark, sf):
    """The log of every session's actions."""
    return _played(spark, sf).select("seed", F.explode("r.log").alias("l")).select("seed", "l.seq", "l.kind", "l.description", "l.move_count", "l.won", "l.ok")


@query(f"""WITH {_W} SELECT f.seed, CAST(f.n AS INT) AS total_actions, CAST(f.redeals AS INT) AS redeal_count, f.d AS draw_count, 24 AS dealt_stock, 'draw' AS first_kind FROM f""")
def session_logs(spark, sf):
    """Session logs as documents with initial state, actions and result, read back."""
    d = _played(spark, sf).select("seed", gs.session_document(F.col("seed"), F.col("r.session"), F.col("r.log"), F.col("board")).alias("doc"))
    v = F.from_json("doc", f"seed bigint, draw_count int, initial_state {bd.BOARD}, actions array<{gs.LOG}>, result struct<won:boolean,stuck:boolean,score:int,move_count:int,redeal_count:int,total_actions:int>")
    return d.select(v.alias("v")).select("v.seed", "v.result.total_actions", "v.result.redeal_count", "v.draw_count", F.size("v.initial_state.stock").alias("dealt_stock"), F.get("v.actions", F.lit(0))["kind"].alias("first_kind"))


@query(f"""WITH {C}, n AS (SELECT seed, count(*) AS k FROM m GROUP BY seed) SELECT seed, CAST(k AS INT) AS actions, CAST(k - 1 AS INT) AS draw_index, 'Draw 3 card(s) from stock' AS draw_text, false AS stuck FROM n""")
def session_actions(spark, sf):
    """Legal actions of every deal, the draw last."""
    d = deals(spark, sf).select("seed", gs.legal_actions(F.col("board"), F.lit(3)).alias("a"), gs.is_stuck(F.col("board")).alias("stuck"))
    draw = F.get(F.filter("a", lambda a: a["kind"] == "draw"), F.lit(0))
    return d.select("seed", F.size("a").alias("actions"), draw["index"].alias("draw_index"), draw["description"].alias("draw_text"), "stuck")


def _commands(spark, sf):
    """Commands of every deal in three files: opened and two draws; one draw, a wrong index and, for every third, the end;
    a draw for all and an unknown session."""
    s = deals(spark, sf).select("seed", F.col("seed").cast("string").alias("session_id"), F.size(bd.legal_moves(F.col("board"))).alias("n"))
    out = shared_place(spark, "commands")
    move = lambda i: F.lit(i).cast("int") if isinstance(i, int) else i.cast("int")

    def rows(seq, command, index=None):
        return s.select("session_id", F.lit(seq).cast("bigint").alias("seq"), F.lit(command).alias("command"), "seed", F.lit(3).alias("draw_count"), (F.lit(None).cast("int") if index is None else move(index)).alias("move_index"))

    draw = F.col("n") - 1
    rows(1, "new_game").unionByName(rows(2, "play_move", draw)).coalesce(1).write.parquet(f"{out}/a")
    rows(3, "play_move", 500).unionByName(rows(4, "end_session").filter(F.col("seed") % 3 == 0)).coalesce(1).write.parquet(f"{out}/b")
    rows(5, "end_session").filter(F.col("seed") % 3 != 1).coalesce(1).write.parquet(f"{out}/c")
    return out


def _run(spark, sf, cap=10**9):
    out = _commands(spark, sf)
    stream = spark.readStream.schema(gs.COMMAND).option("maxFilesPerTrigger", 1).parquet(f"{out}/*")
    return gs.run_sessions(stream, cap=cap)


@query("""WITH s AS (SELECT DISTINCT deck_seed AS seed FROM run_summary WHERE deck_seed IS NOT NULL)
SELECT CAST(seed AS VARCHAR) AS session_id, 1 AS seq, 'game_started' AS event, CAST(NULL AS INT) AS move_count FROM s UNION ALL SELECT CAST(seed AS VARCHAR), 2, 'move', 1 FROM s UNION ALL SELECT CAST(seed AS VARCHAR), 3, 'error', NULL FROM s
UNION ALL SELECT CAST(seed AS VARCHAR), 4, 'game_abandoned', 1 FROM s WHERE seed % 3 = 0 UNION ALL SELECT CAST(seed AS VARCHAR), 5, CASE WHEN seed % 3 = 0 THEN 'error' ELSE 'game_abandoned' END, CASE WHEN seed % 3 = 0 THEN NULL ELSE 1 END FROM s WHERE seed % 3 <> 1""")
def stream_sessions(spark, sf):
    """Commands in three micro-batches; sessions live from batch to batch."""
    return _run(spark, sf)[1].select("session_id", "seq", "event", "move_count")


@query("""SELECT DISTINCT CAST(deck_seed AS VARCHAR) AS session_id, 1 AS move_count, 0 AS score, false AS won, false AS stuck, 3 AS draw_count, deck_seed AS seed FROM run_summary WHERE deck_seed % 3 = 1""")
def stream_open_sessions(spark, sf):
    """The sessions that are still open after the stream."""
    return gs.list_sessions(_run(spark, sf)[0])


@query("""WITH s AS (SELECT DISTINCT CAST(deck_seed AS VARCHAR) AS id FROM run_summary WHERE deck_seed IS NOT NULL), r AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM s) SELECT id AS session_id, CASE WHEN k <= 100 THEN 'game_started' ELSE 'error' END AS event FROM r""")
def stream_session_cap(spark, sf):
    """At most a hundred sessions are open at a time; further ones are refused."""
    return _run(spark, sf, cap=100)[1].filter("seq = 1").select("session_id", "event")
