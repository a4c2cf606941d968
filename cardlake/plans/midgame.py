"""Queries over boards in the middle of a game: foundations above the ace, a waste, empty columns, runs of several cards.

The boards come from hashes of the deck seeds, by a rule that SQL repeats card by card: each suit's foundation holds its
lowest ranks, the other cards lie in hash order on waste, stock and six or seven columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import board as bd
from ..functions.actions import let
from ..session import table
from .boards import TASKS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def laid(seed: Column) -> Column:
    """The board of a seed."""
    suits = F.array(*[F.lit(s) for s in bd.SUITS])
    level = lambda j: F.pmod(F.floor(seed / (j + 2)), F.lit(7)).cast("int")
    none = F.array().cast(f"array<{bd.CARD}>")
    every = F.transform(F.sequence(F.lit(0), F.lit(51)), lambda k: F.struct(F.sha2(F.concat_ws("#", seed.cast("string"), k.cast("string")), 256).alias("h"), k.alias("k")))

    def foundation(j: int) -> Column:
        ranks = F.when(level(j) > 0, F.sequence(F.lit(1), level(j))).otherwise(F.array().cast("array<int>"))
        return F.transform(ranks, lambda r: bd.card(r, F.lit(bd.SUITS[j]), F.lit(True)))

    found = F.array(*[foundation(j) for j in range(4)])
    levels = F.array(*[level(j) for j in range(4)])
    rest = F.array_sort(F.filter(every, lambda x: x["k"] % 13 + 1 > F.get(levels, F.floor(x["k"] / 13).cast("int"))))
    as_card = lambda x, up: bd.card(x["k"] % 13 + 1, F.get(suits, F.floor(x["k"] / 13).cast("int")), up)
    waste, stock, piles = F.pmod(seed, F.lit(4)).cast("int"), F.pmod(seed, F.lit(6)).cast("int"), (7 - F.pmod(seed, F.lit(2))).cast("int")

    def build(r: Column) -> Column:
        cards = F.transform(r, lambda x: as_card(x, F.lit(True)))
        down = F.transform(r, lambda x: as_card(x, F.lit(False)))
        tab = F.slice(cards, waste + stock + 1, F.lit(52))
        column = lambda i: F.filter(tab, lambda c, q: q % piles == i)
        hide = lambda i: F.pmod(seed + i, F.lit(3)).cast("int")
        cols = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.transform(column(i), lambda c, k: bd.card(c["rank"], c["suit"], k >= hide(i))))
        return F.struct(cols.alias("tableau"), found.alias("foundations"), F.slice(down, waste + 1, stock).alias("stock"), F.when(waste > 0, F.slice(cards, F.lit(1), waste)).otherwise(none).alias("waste"), F.lit(0).alias("move_count"), F.lit(0).alias("score"))

    return let(rest, build)


def boards(spark, sf: str) -> DataFrame:
    s = table(spark, sf, "run_summary", "deck_seed").filter("deck_seed IS NOT NULL").select(F.col("deck_seed").alias("seed")).distinct()
    return s.select("seed", laid(F.col("seed")).alias("board")).repartition(TASKS, "seed")


C = """s AS (SELECT DISTINCT deck_seed AS seed FROM run_summary WHERE deck_seed IS NOT NULL), k AS (SELECT seed, i, CAST(i % 13 + 1 AS INT) AS rank, CAST(i // 13 AS INT) AS j, sha256(seed || '#' || i) AS h FROM s, range(52) r(i)),
l AS (SELECT *, rank <= (seed // (j + 2)) % 7 AS up FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY h) - 1 AS p FROM l WHERE NOT up),
q AS (SELECT *, p - seed % 4 - seed % 6 AS t, 7 - seed % 2 AS piles FROM o),
c AS (SELECT seed, 'foundation' AS pile_kind, j AS pile_idx, rank - 1 AS pos, rank, ['hearts', 'diamonds', 'clubs', 'spades'][j + 1] AS suit, true AS face_up FROM l WHERE up
 UNION ALL SELECT seed, CASE WHEN p < seed % 4 THEN 'waste' WHEN t < 0 THEN 'stock' ELSE 'tableau' END, CAST(CASE WHEN t < 0 THEN 0 ELSE t % piles END AS INT), CAST(CASE WHEN p < seed % 4 THEN p WHEN t < 0 THEN p - seed % 4 ELSE t // piles END AS INT), rank, ['hearts', 'diamonds', 'clubs', 'spades'][j + 1],
  p < seed % 4 OR (t >= 0 AND t // piles >= (seed + t % piles) % 3) FROM q),
n AS (SELECT s.seed, k.pile_kind, CAST(k.i AS INT) AS pile_idx, count(c.rank) AS size, count(c.rank) FILTER (WHERE NOT c.face_up) AS down FROM s CROSS JOIN (SELECT 'tableau' AS pile_kind, i FROM range(7) a(i) UNION ALL SELECT 'foundation', i FROM range(4) b(i) UNION ALL SELECT 'stock', 0 UNION ALL SELECT 'waste', 0) k LEFT JOIN c ON c.seed = s.seed AND c.pile_kind = k.pile_kind AND c.pile_idx = k.i GROUP BY ALL),
top AS (SELECT n.seed, n.pile_kind, n.pile_idx, n.size, n.down, c.rank, c.suit, c.suit IN ('hearts', 'diamonds') AS red FROM n LEFT JOIN c ON c.seed = n.seed AND c.pile_kind = n.pile_kind AND c.pile_idx = n.pile_idx AND c.pos = n.size - 1),
m AS (SELECT a.seed, 0 AS g, a.pile_idx AS src, 0 AS k, f.pile_idx AS dst, 1 AS n, 10 AS sc, 'tableau_to_foundation' AS kind FROM top a JOIN top f ON a.seed = f.seed AND f.pile_kind = 'foundation' WHERE a.pile_kind = 'tableau' AND a.size > 0 AND ((f.size = 0 AND a.rank = 1) OR (f.suit = a.suit AND a.rank = f.rank + 1))
 UNION ALL SELECT a.seed, 1, NULL, 0, f.pile_idx, 1, 10, 'waste_to_foundation' FROM top a JOIN top f ON a.seed = f.seed AND f.pile_kind = 'foundation' WHERE a.pile_kind = 'waste' AND a.size > 0 AND ((f.size = 0 AND a.rank = 1) OR (f.suit = a.suit AND a.rank = f.rank + 1))
 UNION ALL SELECT x.seed, 2, x.pile_idx, x.pos, t.pile_idx, n.size - x.pos, 0, 'tableau_to_tableau' FROM c x JOIN n ON n.seed = x.seed AND n.pile_kind = 'tableau' AND n.pile_idx = x.pile_idx JOIN top t ON t.seed = x.seed AND t.pile_kind = 'tableau' AND t.pile_idx <> x.pile_idx
  WHERE x.pile_kind = 'tableau' AND x.face_up AND ((t.size = 0 AND x.rank = 13 AND x.pos > 0) OR (t.size > 0 AND x.rank = t.rank - 1 AND (x.suit IN ('hearts', 'diamonds')) <> t.red))
 UNION ALL SELECT a.seed, 3, NULL, 0, t.pile_idx, 1, 5, 'waste_to_tableau' FROM top a JOIN top t ON a.seed = t.seed AND t.pile_kind = 'tableau' WHERE a.pile_kind = 'waste' AND a.size > 0 AND ((t.size = 0 AND a.rank = 13) OR (t.size > 0 AND a.rank = t.rank - 1 AND a.red <> t.red))
 UNION ALL SELECT seed, 4, NULL, 0, NULL, 1, 0, 'stock_to_waste' FROM n WHERE pile_kind = 'stock' AND size > 0),
z AS (SELECT seed, sum(size) FILTER (WHERE pile_kind = 'foundation') AS fnd, sum(size) FILTER (WHERE pile_kind = 'tableau') AS tab, sum(down) FILTER (WHERE pile_kind = 'tableau') AS down, count(*) FILTER (WHERE pile_kind = 'tableau' AND size = 0) AS empties, sum(size) FILTER (WHERE pile_kind = 'stock') AS stock, sum(size) FILTER (WHERE pile_kind = 'waste') AS waste FROM n GROUP BY seed)"""


@query(f"WITH {C} SELECT seed, pile_kind, pile_idx, CAST(pos AS INT) AS pos, rank, suit, face_up FROM c")
def mid_cells(spark, sf):
    return bd.cells(boards(spark, sf))


@query(f"WITH {C} SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY g, src, k, dst) - 1 AS INT) AS idx, kind AS move_type, src AS source_pile, CAST(dst AS INT) AS dest_pile, CAST(n AS INT) AS num_cards, sc AS score_delta FROM m")
def mid_legal_moves(spark, sf):
    """Legal moves in their fixed order, of all five kinds, runs of several cards among them."""
    return boards(spark, sf).select("seed", F.posexplode(bd.legal_moves(F.col("board"))).alias("idx", "m")).select("seed", "idx", "m.*")


@query(f"""WITH {C} SELECT seed, least(1.0, 0.6::DOUBLE * (fnd / 52) + 0.2::DOUBLE * (1 - down / 28) + 0.1::DOUBLE * (empties / 7) + 0.1::DOUBLE * (1 - (stock + waste) / 24))::DOUBLE AS progression, CAST(100 * fnd + 10 * (tab - down) + 20 * empties - 2 * waste - 5 * stock AS INT) AS heuristic, CAST(down AS INT) AS hidden,
 CAST(100 * fnd + 20 * (28 - down) + 5 * (SELECT count(*) FROM m WHERE m.seed = z.seed) AS DOUBLE) - 0.1 * 3 AS sequence, false AS won, CAST(fnd AS INT) AS foundation FROM z""")
def mid_scores(spark, sf):
    b = F.col("board")
    return boards(spark, sf).select("seed", bd.progression(b).alias("progression"), bd.heuristic(b).alias("heuristic"), bd.face_down(b).alias("hidden"), bd.sequence_score(b, F.lit(3)).alias("sequence"), bd.is_won(b).alias("won"), bd.count_cards(b["foundations"]).alias("foundation"))


@query(f"""WITH {C}, r AS (SELECT x.seed, x.pile_idx, x.pos, x.rank, x.suit IN ('hearts', 'diamonds') AS red, lag(x.rank) OVER w AS pr, lag(x.suit IN ('hearts', 'diamonds')) OVER w AS pred FROM c x WHERE pile_kind = 'tableau' AND face_up WINDOW w AS (PARTITION BY seed, pile_idx ORDER BY pos)),
 b AS (SELECT DISTINCT r.seed FROM r JOIN n ON n.seed = r.seed AND n.pile_kind = 'tableau' AND n.pile_idx = r.pile_idx AND n.down > 0 WHERE r.pr IS NOT NULL AND NOT (r.red <> r.pred AND r.rank = r.pr - 1)),
 a AS (SELECT z.seed, (SELECT count(*) FROM m WHERE m.seed = z.seed) AS moves, z.stock, b.seed IS NOT NULL AS blocking, z.down, z.fnd FROM z LEFT JOIN b ON z.seed = b.seed),
 d AS (SELECT *, moves = 0 OR (moves = 1 AND stock = 0) AS none FROM a)
SELECT seed, CAST(moves AS INT) AS available_moves, none AS no_moves, blocking AS has_blocking_cards, none OR blocking AS is_dead_end, CAST(down AS INT) AS face_down_cards, (fnd / 52)::DOUBLE AS foundation_progress,
 CASE WHEN moves = 0 THEN 1.0 WHEN moves < 3 THEN least(1.0, (CASE WHEN none THEN 0.5 ELSE 0 END + CASE WHEN blocking THEN 0.3 ELSE 0 END) + 0.2) ELSE CASE WHEN none THEN 0.5 ELSE 0 END + CASE WHEN blocking THEN 0.3 ELSE 0 END END::DOUBLE AS risk_score FROM d""")
def mid_dead_ends(spark, sf):
    d = boards(spark, sf).select("seed", bd.dead_end(F.col("board")).alias("d"))
    return d.select("seed", *[f"d.{c}" for c in ("available_moves", "no_moves", "has_blocking_cards", "is_dead_end", "face_down_cards", "foundation_progress", "risk_score")])


@query(f"""WITH {C}, e AS (SELECT m.*, row_number() OVER (PARTITION BY m.seed ORDER BY g, src, k, dst) - 1 AS idx, z.fnd, z.down, z.stock, z.waste, n.size AS ssize, n.down AS sdown FROM m JOIN z ON m.seed = z.seed LEFT JOIN n ON n.seed = m.seed AND n.pile_kind = 'tableau' AND n.pile_idx = m.src)
SELECT seed, CAST(idx AS INT) AS idx, CAST(fnd + CASE WHEN g < 2 THEN 1 ELSE 0 END AS INT) AS foundation, CAST(down - CASE WHEN g IN (0, 2) AND ssize - n > 0 AND ssize - n <= sdown THEN 1 ELSE 0 END AS INT) AS hidden, CAST(stock - CASE WHEN g = 4 THEN 1 ELSE 0 END AS INT) AS stock,
 CAST(waste + CASE WHEN g = 4 THEN 1 WHEN g IN (1, 3) THEN -1 ELSE 0 END AS INT) AS waste, sc AS score, 1 AS moves, CASE g WHEN 0 THEN 'Move card from tableau ' || src || ' to foundation ' || dst WHEN 1 THEN 'Move card from waste to foundation ' || dst WHEN 2 THEN 'Move ' || n || ' card(s) from tableau ' || src || ' to tableau ' || dst WHEN 3 THEN 'Move card from waste to tableau ' || dst ELSE 'Draw from stock' END AS move FROM e""")
def mid_moves_applied(spark, sf):
    """Every legal move applied: what the board after it holds."""
    d = boards(spark, sf).select("seed", "board", F.posexplode(bd.legal_moves(F.col("board"))).alias("idx", "m"))
    a = F.col("after")
    d = d.select("seed", "idx", bd.move_text(F.col("m")).alias("move"), bd.apply_move(F.col("board"), F.col("m")).alias("after"))
    return d.select("seed", "idx", "move", bd.count_cards(a["foundations"]).alias("foundation"), bd.face_down(a).alias("hidden"), F.size(a["stock"]).alias("stock"), F.size(a["waste"]).alias("waste"), a["score"].alias("score"), a["move_count"].alias("moves"))


_CODE = "(['A', '2', '3', '4', '5', '6', '7', '8', '9', 'T', 'J', 'Q', 'K'])[rank] || upper(left(suit, 1))"


@query(f"""WITH {C}, p AS (SELECT seed, pile_kind, pile_idx, coalesce(string_agg(CASE WHEN face_up OR pile_kind = 'stock' THEN {_CODE} ELSE '##' END, ' ' ORDER BY pos), '') AS up FROM c GROUP BY ALL),
 f AS (SELECT seed, string_agg(CASE WHEN rank IS NULL THEN '--' ELSE {_CODE} END, ' ' ORDER BY pile_idx) AS t FROM top WHERE pile_kind = 'foundation' GROUP BY seed),
 t AS (SELECT n.seed, string_agg('  T' || n.pile_idx || ': ' || CASE WHEN n.size = 0 THEN '(empty)' ELSE p.up END, chr(10) ORDER BY n.pile_idx) AS t FROM n LEFT JOIN p ON p.seed = n.seed AND p.pile_kind = n.pile_kind AND p.pile_idx = n.pile_idx WHERE n.pile_kind = 'tableau' GROUP BY n.seed)
SELECT z.seed, '=== Solitaire ===' || chr(10) || 'Foundations: ' || f.t || chr(10) || 'Tableau:' || chr(10) || t.t || chr(10) || 'Stock: ' || z.stock || ' cards' || chr(10) || CASE WHEN z.waste = 0 THEN 'Waste: (empty)' ELSE 'Waste: ' || {_CODE.replace('rank', 'w.rank').replace('suit', 'w.suit')} || ' (+' || (z.waste - 1) || ' below)' END || chr(10) || 'Score: 0  Moves: 0' AS txt
 FROM z JOIN f ON z.seed = f.seed JOIN t ON z.seed = t.seed JOIN top w ON w.seed = z.seed AND w.pile_kind = 'waste'""")
def mid_text(spark, sf):
    """The text board at the plain information level."""
    return boards(spark, sf).select("seed", bd.render_text(F.col("board")).alias("txt"))


@query(f"""WITH {C}, v AS (SELECT seed, pile_idx, string_agg(rank || left(suit, 1), ' ' ORDER BY pos) FILTER (WHERE face_up) AS up, string_agg(rank || left(suit, 1), ' ' ORDER BY pos) FILTER (WHERE NOT face_up) AS dn FROM c WHERE pile_kind = 'tableau' GROUP BY ALL)
SELECT n.seed, n.pile_idx AS "index", CAST(n.size AS INT) AS size, CAST(n.down AS INT) AS face_down_count, coalesce(v.up, '') AS face_up, v.dn AS face_down_cards, CAST(z.stock AS INT) AS stock_count, CAST(z.waste AS INT) AS waste_cards FROM n JOIN z ON z.seed = n.seed LEFT JOIN v ON v.seed = n.seed AND v.pile_idx = n.pile_idx WHERE n.pile_kind = 'tableau'""")
def mid_views(spark, sf):
    """Columns, stock and waste of the observation at the open information level."""
    o = bd.observe(F.col("board"), "revealed", "revealed", "full")
    d = boards(spark, sf).select("seed", o.alias("o")).select("seed", F.explode("o.tableau").alias("t"), F.col("o.stock.count").alias("stock_count"), F.size("o.waste.cards").alias("waste_cards"))
    names = lambda a: F.array_join(F.transform(a, lambda c: F.concat(c["rank"].cast("string"), F.substring(c["suit"], 1, 1))), " ")
    return d.select("seed", "t.index", "t.size", "t.face_down_count", names(F.col("t.face_up")).alias("face_up"), F.when(F.col("t.face_down_cards").isNotNull(), names(F.col("t.face_down_cards"))).alias("face_down_cards"), "stock_count", "waste_cards")


@query(f"""WITH {C}, w AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY g, src, k, dst) - 1 AS idx FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY CASE g WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END DESC, idx) AS best FROM w)
SELECT z.seed, CAST(coalesce(r.idx, CASE WHEN z.stock = 0 AND z.waste > 0 THEN 0 END) AS INT) AS "index", CASE WHEN r.idx IS NULL THEN CASE WHEN z.stock = 0 AND z.waste > 0 THEN 'Recycle the waste pile.' ELSE 'No legal moves; the game is over.' END ELSE 'Greedy strategy pick.' END AS reason FROM z LEFT JOIN r ON z.seed = r.seed AND r.best = 1""")
def mid_suggestions(spark, sf):
    """The greedy strategy's move as an index into the legal actions, with the recycle as a last resort."""
    from ..operators import gamesession as gs

    return boards(spark, sf).select("seed", gs.suggest(F.col("board")).alias("s")).select("seed", "s.index", "s.reason")
