"""Further queries: trees and solving, documents, evaluation metrics, arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as bd
from ..operators import documents as doc
from ..operators import solver
from ..operators import turnwindows as tw
from ..session import table
from .boards import C, _games, deals
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


@query()
def best_first(spark, sf):
    """Best-first search of every deal with at most the 200,000 nodes of the reference."""
    return solver.solve_boards(_games(spark, sf), cap=200_000)


@query()
def tree_statistics(spark, sf):
    """Depth-first move tree of every deal with the reference's depth and nodes."""
    return solver.tree_sizes(_games(spark, sf), depth=10, max_nodes=10_000)


@query(f"""WITH {C}, x AS (SELECT seed, pile_idx, list((CASE WHEN face_up THEN '' ELSE '<' END) || (['A', '2', '3', '4', '5', '6', '7', '8', '9', 'T', 'J', 'Q', 'K'])[rank] || left(suit, 1) || (CASE WHEN face_up THEN '' ELSE '>' END) ORDER BY pos) AS l FROM c WHERE pile_kind = 'tableau' GROUP BY seed, pile_idx),
w AS (SELECT seed, string_agg((['A', '2', '3', '4', '5', '6', '7', '8', '9', 'T', 'J', 'Q', 'K'])[rank] || left(suit, 1), ' ' ORDER BY pos DESC) AS t FROM c WHERE pile_kind = 'stock' GROUP BY seed)
SELECT x.seed, 'Talon: ' || any_value(w.t) || chr(10) || string_agg(array_to_string(l, ' '), chr(10) ORDER BY pile_idx) AS txt FROM x JOIN w ON x.seed = w.seed GROUP BY x.seed""")
def text_boards(spark, sf):
    return deals(spark, sf).select("seed", doc.text_board(F.col("board")).alias("txt"))


@query(f"""WITH {C}, x AS (SELECT seed, pile_idx, string_agg(CASE WHEN face_up THEN (['A', '2', '3', '4', '5', '6', '7', '8', '9', 'T', 'J', 'Q', 'K'])[rank] || left(suit, 1) ELSE '?' END, '' ORDER BY pos) AS l FROM c WHERE pile_kind = 'tableau' GROUP BY seed, pile_idx)
SELECT seed, '----|' || string_agg(l, ',' ORDER BY pile_idx) || '|24|0' AS signature FROM x GROUP BY seed""")
def board_signatures(spark, sf):
    return deals(spark, sf).select("seed", doc.board_signature(F.col("board")).alias("signature"))


@query("SELECT DISTINCT deck_seed AS seed, true AS same FROM run_summary WHERE deck_seed IS NOT NULL")
def board_round_trip(spark, sf):
    """Boards written as JSON and read back are the same boards."""
    d = deals(spark, sf).withColumn("back", doc.board_from_json(doc.board_to_json(F.col("board"))))
    return d.select("seed", (bd.state_key(F.col("board")) == bd.state_key(F.col("back"))).alias("same"))


@query("SELECT session_id, count(*) AS actions, string_agg(kind, ',' ORDER BY \"timestamp\", description) AS kinds FROM (SELECT DISTINCT session_id, \"timestamp\", kind, description FROM server_log WHERE event = 'move_played') GROUP BY session_id")
def session_documents(spark, sf):
    """Session logs as documents, then read back."""
    a = table(spark, sf, "server_log", "session_id", "event", "timestamp", "kind", "description").filter("event = 'move_played'").drop("event").distinct()
    a = a.withColumn("at", F.struct("timestamp", "description"))
    d = doc.session_log(a, "session_id", "at", ["at", "kind"])
    v = F.from_json("doc", "actions array<struct<kind:string>>")["actions"]
    return d.select("session_id", F.size(v).cast("bigint").alias("actions"), F.array_join(v["kind"], ",").alias("kinds"))


@query("SELECT r.deck_seed AS state, a.arm, q.i AS run FROM (SELECT DISTINCT deck_seed FROM run_summary WHERE deck_seed IS NOT NULL) r, (VALUES ('plain'), ('hoisted')) a(arm), range(1, 4) q(i)")
def arm_product(spark, sf):
    s = table(spark, sf, "run_summary", "deck_seed").filter("deck_seed IS NOT NULL").distinct().select(F.col("deck_seed").alias("state"))
    d = doc.cross_arms(s, ["plain", "hoisted"], 3)
    return d.select("state", "arm", F.col("run").cast("bigint").alias("run"))


@query("SELECT deck_seed, model_id, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY deck_seed) AS share FROM run_summary WHERE deck_seed IS NOT NULL AND model_id IS NOT NULL GROUP BY deck_seed, model_id")
def pick_distribution(spark, sf):
    """Share of each pick within its state."""
    from pyspark.sql import Window as W

    g = table(spark, sf, "run_summary", "deck_seed", "model_id").filter("deck_seed IS NOT NULL AND model_id IS NOT NULL").groupBy("deck_seed", "model_id").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("deck_seed")))


@query(f"WITH {T} SELECT rowId, array_to_string(list(kind) FILTER (WHERE kind IS NOT NULL) OVER (PARTITION BY sessionId ORDER BY turn, rowId ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ',') AS prior FROM u")
def prior_five(spark, sf):
    r = tw.recent(played(spark, sf), ORDER, "kind", 5, "r")
    return r.select("rowId", F.when(F.size("r") > 0, F.array_join("r", ",")).alias("prior"))


@query("SELECT a.agentId, a.model, count(d.rowId) AS n FROM agents a LEFT JOIN decision_recs d ON a.agentId = d.agentId GROUP BY a.agentId, a.model")
def agents_with_decisions(spark, sf):
    """A left join onto the small agent table: decisions are counted per agent before they meet it."""
    n = table(spark, sf, "decision_recs", "agentId").filter("agentId IS NOT NULL").groupBy("agentId").agg(F.count("*").alias("n"))
    return table(spark, sf, "agents", "agentId", "model").join(n, "agentId", "left").fillna(0, ["n"])


@query("SELECT c_custkey AS arm, count(*) AS games, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(*) >= 2")
def orders_per_customer(spark, sf):
    """Inner equi-join of two growing tables, reduced before the shuffle of the larger one."""
    o = table(spark, sf, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("games"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    c = table(spark, sf, "customer", "c_custkey")
    return o.filter("games >= 2").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("arm"), "games", "total")
