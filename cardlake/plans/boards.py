"""Queries over dealt boards. Deals come from hashes of the deck seeds in run_summary, so SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import board as bd
from ..operators import search
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


#: Tasks over which boards are spread.
TASKS = 64


def deals(spark: SparkSession, sf: str) -> DataFrame:
    """Every deck's deal. Boards are few and cost much work each: they are spread over tasks by number, which also keeps
    the deal from being computed anew wherever the board is named."""
    s = table(spark, sf, "run_summary", "deck_seed").filter("deck_seed IS NOT NULL").select(F.col("deck_seed").alias("seed")).distinct()
    return s.select("seed", bd.deal(F.col("seed")).alias("board")).repartition(TASKS, "seed")


C = """s AS (SELECT DISTINCT deck_seed AS seed FROM run_summary WHERE deck_seed IS NOT NULL), k AS (SELECT seed, i, sha256(seed || ':' || i) AS h FROM s, range(52) r(i)),
o AS (SELECT seed, i, row_number() OVER (PARTITION BY seed ORDER BY h) - 1 AS p FROM k), q AS (SELECT *, CAST(floor((sqrt(8 * p + 1) - 1) / 2) AS INT) AS t FROM o),
c AS (SELECT seed, CASE WHEN p < 28 THEN 'tableau' ELSE 'stock' END AS pile_kind, CASE WHEN p < 28 THEN t ELSE 0 END AS pile_idx, CAST(CASE WHEN p < 28 THEN p - t * (t + 1) // 2 ELSE p - 28 END AS INT) AS pos,
 CAST(i % 13 + 1 AS INT) AS rank, ['hearts', 'diamonds', 'clubs', 'spades'][i // 13 + 1] AS suit, p < 28 AND p - t * (t + 1) // 2 = t AS face_up FROM q),
tops AS MATERIALIZED (SELECT *, suit IN ('hearts', 'diamonds') AS red FROM c WHERE face_up),
m AS (SELECT seed, 0 AS g, a.pile_idx AS src, f.j AS dst, 1 AS n, 10 AS sc, 'tableau_to_foundation' AS kind FROM tops a, range(4) f(j) WHERE a.rank = 1
 UNION ALL SELECT a.seed, 2, a.pile_idx, b.pile_idx, 1, 0, 'tableau_to_tableau' FROM tops a JOIN tops b ON a.seed = b.seed AND a.rank = b.rank - 1 AND a.red = (NOT b.red)
 UNION ALL SELECT seed, 4, NULL, NULL, 1, 0, 'stock_to_waste' FROM s)"""


@query(f"WITH {C} SELECT seed, pile_kind, pile_idx, pos, rank, suit, face_up FROM c")
def deal_cells(spark, sf):
    return bd.cells(deals(spark, sf))


@query(f"WITH {C} SELECT seed, pile_kind, pile_idx, count(*) AS cards, count(*) FILTER (WHERE face_up) AS up FROM c GROUP BY ALL")
def pile_sizes(spark, sf):
    return bd.cells(deals(spark, sf)).groupBy("seed", "pile_kind", "pile_idx").agg(F.count("*").alias("cards"), F.count_if("face_up").alias("up"))


@query(f"WITH {C} SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY g, src, dst) - 1 AS INT) AS idx, kind AS move_type, src AS source_pile, CAST(dst AS INT) AS dest_pile, n AS num_cards, sc AS score_delta FROM m")
def legal_moves_ordered(spark, sf):
    return deals(spark, sf).select("seed", F.posexplode(bd.legal_moves(F.col("board"))).alias("idx", "m")).select("seed", "idx", "m.*")


@query(f"WITH {C} SELECT seed, kind AS move_type, count(*) AS n FROM m GROUP BY ALL")
def legal_by_kind(spark, sf):
    return deals(spark, sf).select("seed", F.explode(bd.legal_moves(F.col("board"))).alias("m")).groupBy("seed", "m.move_type").agg(F.count("*").alias("n"))


@query(f"""WITH {C} SELECT seed, 0.6::DOUBLE * (0 / 52) + 0.2::DOUBLE * (1 - 21 / 28) + 0.1::DOUBLE * (0 / 7) + 0.1::DOUBLE * (1 - 24 / 24) AS progression, 0 + 10 * 7 + 0 - 0 - 5 * 24 AS heuristic, 21 AS hidden, false AS won FROM s""")
def board_scores(spark, sf):
    b = F.col("board")
    return deals(spark, sf).select("seed", bd.progression(b).alias("progression"), bd.heuristic(b).alias("heuristic"), bd.face_down(b).alias("hidden"), bd.is_won(b).alias("won"))


@query(f"""WITH {C}, n AS (SELECT seed, count(*) AS n FROM m GROUP BY seed) SELECT seed, CAST(n AS INT) AS available_moves, false AS is_dead_end, false AS no_moves, false AS has_blocking_cards, 21 AS face_down_cards, CASE WHEN n < 3 THEN 0.2 ELSE 0.0 END::DOUBLE AS risk_score FROM n""")
def dead_end_risk(spark, sf):
    return deals(spark, sf).select("seed", bd.dead_end(F.col("board")).alias("d")).select("seed", "d.available_moves", "d.is_dead_end", "d.no_moves", "d.has_blocking_cards", "d.face_down_cards", "d.risk_score")


@query(f"""WITH {C}, x AS (SELECT seed, pile_idx, list(CASE WHEN face_up THEN (['A', '2', '3', '4', '5', '6', '7', '8', '9', 'T', 'J', 'Q', 'K'])[rank] || left(suit, 1) ELSE '??' END ORDER BY pos) AS l FROM c WHERE pile_kind = 'tableau' GROUP BY ALL)
SELECT seed, 'FOUNDATIONS: -- -- -- --' || chr(10) || string_agg('col' || (pile_idx + 1) || ': ' || array_to_string(l, ' '), chr(10) ORDER BY pile_idx) || chr(10) || 'WASTE: -- STOCK: 24' AS txt FROM x GROUP BY seed""")
def rendered_boards(spark, sf):
    return deals(spark, sf).select("seed", bd.render(F.col("board")).alias("txt"))


@query(f"""WITH {C}, x AS (SELECT seed, pile_idx, '{{"faceDownCount":' || pile_idx || ',"faceUp":["' || max(CASE WHEN face_up THEN (['A', '2', '3', '4', '5', '6', '7', '8', '9', 'T', 'J', 'Q', 'K'])[rank] || left(suit, 1) END) || '"]}}' AS j FROM c WHERE pile_kind = 'tableau' GROUP BY seed, pile_idx)
SELECT seed, '{{"foundations":[0,0,0,0],"tableau":[' || string_agg(j, ',' ORDER BY pile_idx) || '],"stockCount":24,"waste":[]}}' AS view FROM x GROUP BY seed""")
def masked_observation(spark, sf):
    """What a player sees: counts of hidden and stock cards, the waste's top only."""
    return deals(spark, sf).select("seed", bd.observation(F.col("board")).alias("view"))


@query(f"""WITH {C}, d AS (SELECT seed, rank, suit FROM c WHERE pile_kind = 'stock' AND pos >= 21) SELECT seed, string_agg(rank || left(suit, 1), ' ' ORDER BY p DESC) AS waste, 21 AS stock FROM (SELECT c.seed, c.rank, c.suit, c.pos AS p FROM c WHERE pile_kind = 'stock' AND pos >= 21) GROUP BY seed""")
def session_draws(spark, sf):
    """A draw of three turns the cards up in the order drawn."""
    d = deals(spark, sf).select("seed", bd.session_draw(F.col("board"), F.lit(3)).alias("b"))
    return d.select("seed", F.array_join(F.transform("b.waste", lambda c: F.concat(c["rank"].cast("string"), F.substring(c["suit"], 1, 1))), " ").alias("waste"), F.size("b.stock").alias("stock"))


def _games(spark, sf):
    return deals(spark, sf).select(F.col("seed").alias("game"), "board")


@query()
def greedy_games(spark, sf):
    """Twenty first-legal moves per deal."""
    b = F.col("board")
    return search.greedy_game(_games(spark, sf), 20).select("game", bd.count_cards(b["foundations"]).alias("foundation"), bd.face_down(b).alias("hidden"), b["score"].alias("score"), b["move_count"].alias("moves"), bd.state_key(b).alias("key"))


@query()
def beam_solve(spark, sf):
    """Beam search of every deal with the depth and width of the reference solver."""
    return search.beam(_games(spark, sf), depth=100, width=1000)


@query()
def best_sequences(spark, sf):
    return search.best_sequences(_games(spark, sf), depth=3, keep=3)


@query()
def all_moves_report(spark, sf):
    """Every legal move of every deal with the scores of the board after it."""
    d = deals(spark, sf).select("seed", "board", F.posexplode(bd.legal_moves(F.col("board"))).alias("idx", "m"))
    d = d.select("seed", "idx", bd.describe(F.col("m")).alias("move"), bd.apply_move(F.col("board"), F.col("m")).alias("after"))
    return d.select("seed", "idx", "move", bd.progression(F.col("after")).alias("progression"), bd.heuristic(F.col("after")).alias("heuristic"), bd.is_won(F.col("after")).alias("won"), F.size(bd.legal_moves(F.col("after"))).alias("replies"))


@query()
def move_trees(spark, sf):
    """Breadth-first tree of two moves per deal: nodes, leaves and distinct boards."""
    f = search.expand(_games(spark, sf).select("game", "board", F.array().cast(f"array<{bd.MOVE}>").alias("path"), F.lit(0).cast("bigint").alias("ord")))
    f = f.select("game", "board", "path", F.col("i").cast("bigint").alias("ord"))
    g = search.expand(f)
    every = f.select("game", "board", F.lit(1).alias("depth")).unionByName(g.select("game", "board", F.lit(2).alias("depth")))
    return every.groupBy("game").agg(F.count("*").alias("nodes"), F.count_if(F.col("depth") == 2).alias("leaves"), F.count_distinct(bd.state_key(F.col("board"))).alias("boards"))


@query()
def strategy_picks(spark, sf):
    """The simple, weighted and lookahead choice on every deal."""
    from ..operators import strategies as st

    g = _games(spark, sf)
    out = None
    for name in ("simple", "weighted", "lookahead"):
        p = st.choose(g, name, st.Config(depth=2)).select("game", F.lit(name).alias("strategy"), bd.describe(F.col("move")).alias("move"), "score")
        out = p if out is None else out.unionByName(p)
    return out


@query()
def session_replay(spark, sf):
    """The best two-move line of every deal, replayed from the deal."""
    best = search.best_sequences(_games(spark, sf), depth=2, keep=1, with_path=True).select("game", F.col("path").alias("moves"))
    r = search.replay(_games(spark, sf).join(best, "game"))
    return r.select("game", "applied", "ok", bd.state_key(F.col("board")).alias("key"))
