"""Queries of the playing harness over boards in the middle of a game and over deals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import board as bd
from ..functions.actions import let
from ..operators import harness as hn
from ..session import table
from .boards import C as DEAL
from .boards import _games, deals
from .midgame import C, boards

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_R = "['A', '2', '3', '4', '5', '6', '7', '8', '9', 'T', 'J', 'Q', 'K']"
#: Every legal move with its lead card, the columns it leaves and reaches, and its words.
_D = f"""{C}, w AS (SELECT seed, rank, suit FROM top WHERE pile_kind = 'waste' AND size > 0),
d AS (SELECT m.*, row_number() OVER (PARTITION BY m.seed ORDER BY g, m.src, m.k, m.dst) - 1 AS idx, coalesce(l.rank, w.rank) AS lr, coalesce(l.suit, w.suit) AS ls, src.down AS sdown, src.size AS ssize, dst.size AS dsize FROM m
 LEFT JOIN top l0 ON l0.seed = m.seed AND l0.pile_kind = 'tableau' AND l0.pile_idx = m.src LEFT JOIN n src ON src.seed = m.seed AND src.pile_kind = 'tableau' AND src.pile_idx = m.src LEFT JOIN n dst ON dst.seed = m.seed AND dst.pile_kind = 'tableau' AND dst.pile_idx = m.dst AND m.g IN (2, 3)
 LEFT JOIN c l ON l.seed = m.seed AND l.pile_kind = 'tableau' AND l.pile_idx = m.src AND l.pos = CASE WHEN m.g = 0 THEN l0.size - 1 ELSE m.k END LEFT JOIN w ON w.seed = m.seed AND m.g IN (1, 3)),
e AS (SELECT *, ({_R})[lr] || upper(left(ls, 1)) AS code FROM d),
x AS (SELECT *, CASE g WHEN 0 THEN 'Send ' || code || ' from column ' || (src + 1) || ' to the ' || ls || ' foundation' WHEN 1 THEN 'Send ' || code || ' from the waste to the ' || ls || ' foundation' WHEN 3 THEN 'Move ' || code || ' from the waste to column ' || (dst + 1) || CASE WHEN dsize = 0 THEN ' (empty)' ELSE '' END
 WHEN 2 THEN 'Move ' || code || CASE WHEN n > 1 THEN ' plus ' || (n - 1) || ' more' ELSE '' END || ' from column ' || (src + 1) || ' to column ' || (dst + 1) || CASE WHEN dsize = 0 THEN ' (empty)' ELSE '' END || CASE WHEN k > 0 AND k = sdown THEN ' (reveals a hidden card)' ELSE '' END ELSE 'Draw the next card from the stock onto the waste' END AS txt,
 CASE WHEN g IN (0, 1) THEN CASE WHEN lr <= 2 THEN 'found_low' ELSE 'found_high' END WHEN g = 2 THEN CASE WHEN k = 0 THEN 'frees_col' WHEN k = sdown THEN 'reveal_t2t' ELSE 'build' END WHEN g = 3 THEN CASE WHEN dsize = 0 THEN 'to_empty' ELSE 'waste_build' END ELSE 'draw' END AS tag FROM e),
v AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY idx) - 1 AS vi FROM (SELECT seed, g, idx, txt, tag FROM x WHERE g > 1 OR dst = CASE ls WHEN 'hearts' THEN 0 WHEN 'diamonds' THEN 1 WHEN 'clubs' THEN 2 ELSE 3 END UNION ALL SELECT seed, 5, 99, 'Recycle the waste pile back into the stock', 'recycle' FROM z WHERE stock = 0 AND waste > 0))"""


def _moves(spark, sf):
    return boards(spark, sf).select("seed", "board", F.posexplode(hn.visible_moves(F.col("board"))).alias("idx", "m"))


@query(f"WITH {_D} SELECT seed, CAST(idx AS INT) AS idx, txt FROM x")
def move_descriptions(spark, sf):
    """Legal moves in prose with their tags."""
    d = boards(spark, sf).select("seed", "board", F.posexplode(bd.legal_moves(F.col("board"))).alias("idx", "m"))
    return d.select("seed", "idx", bd.describe_move(F.col("board"), F.col("m")).alias("txt"))


@query(f"WITH {_D} SELECT seed, CAST(vi AS INT) AS idx, txt, tag FROM v")
def visible_moves(spark, sf):
    """What the agent sees: one foundation a suit, a recycle behind the others, and what each move is for."""
    return _moves(spark, sf).select("seed", "idx", bd.describe_move(F.col("board"), F.col("m")).alias("txt"), hn.move_tag(F.col("board"), F.col("m")).alias("tag"))


@query(f"""WITH {_D} SELECT seed, CAST(vi AS INT) AS idx, '{{"board_analysis":"' || CASE tag WHEN 'draw' THEN 'Nothing else helps.' ELSE 'Now: ' || txt || '.' END || '","strategic_plan":"plan of ' || CASE tag WHEN 'draw' THEN 'draw' ELSE 'other' END || '","final_decision":{{"move_index":' || vi || '}}}}' AS completion FROM v""")
def taught_completions(spark, sf):
    """A completion for every visible move from templates by tag."""
    t = {"draw": ("Nothing else helps.", "plan of draw"), "other": ("Now: {desc}.", "plan of other")}
    return _moves(spark, sf).select("seed", "idx", hn.completion(F.col("board"), F.col("m"), F.col("idx"), t).alias("completion"))


@query(f"""WITH {C} SELECT z.seed, CAST(z.waste AS INT) AS stock, 0 AS waste, c.rank AS next_rank, 0 AS moves FROM z LEFT JOIN c ON c.seed = z.seed AND c.pile_kind = 'waste' AND c.pos = 0""")
def harness_recycle(spark, sf):
    """The waste turned over: its first card is the next one, the move count stays."""
    b = F.col("b")
    return boards(spark, sf).select("seed", hn.recycled(F.col("board")).alias("b")).select("seed", F.size(b["stock"]).alias("stock"), F.size(b["waste"]).alias("waste"), bd.top(b["stock"])["rank"].alias("next_rank"), b["move_count"].alias("moves"))


_PROMPT = f"""{_D}, t0 AS (SELECT n.seed, string_agg('  col' || (n.pile_idx + 1) || ': ' || coalesce(p.l, '<empty>'), chr(10) ORDER BY n.pile_idx) AS cols FROM n LEFT JOIN (SELECT seed, pile_idx, string_agg(CASE WHEN face_up THEN ({_R})[rank] || upper(left(suit, 1)) ELSE '??' END, ' ' ORDER BY pos) AS l FROM c WHERE pile_kind = 'tableau' GROUP BY ALL) p ON p.seed = n.seed AND p.pile_idx = n.pile_idx WHERE n.pile_kind = 'tableau' GROUP BY n.seed),
f0 AS (SELECT seed, string_agg((['H', 'D', 'C', 'S'])[pile_idx + 1] || ': ' || coalesce(({_R})[rank] || upper(left(suit, 1)), '--'), '   ' ORDER BY pile_idx) AS tops FROM top WHERE pile_kind = 'foundation' GROUP BY seed),
k0 AS (SELECT seed, vi, rpad((['tableau_to_foundation', 'discard_to_foundation', 'tableau_to_tableau', 'discard_to_tableau', 'draw_card', 'recycle_stock'])[g + 1], 24, ' ') AS kind, txt FROM v), l0 AS (SELECT seed, string_agg('  [' || vi || '] ' || kind || '  ' || txt, chr(10) ORDER BY vi) AS legal, string_agg('  [' || vi || '] ' || kind || ' ' || txt, chr(10) ORDER BY vi) AS legal25 FROM k0 GROUP BY seed),
b0 AS (SELECT z.*, tops, cols, legal, legal25, coalesce(({_R})[w.rank] || upper(left(w.suit, 1)), '--') AS wt, CASE WHEN z.stock = 0 AND z.waste > 0 THEN 'yes' ELSE 'no' END AS rec, 'PROGRESS: foundation=' || fnd || '/52, face-down remaining=' || down || ', completion=' || CAST(round(fnd / 52 * 100) AS INT) || '%' AS prog FROM z JOIN t0 ON z.seed = t0.seed JOIN f0 ON z.seed = f0.seed LEFT JOIN l0 ON z.seed = l0.seed LEFT JOIN w ON w.seed = z.seed)"""


@query(f"""WITH {_PROMPT} SELECT seed, 'H' || chr(10) || 'CURRENT GAME:' || chr(10) || 'NOTATION: rank+suit (A 2-9 T J Q K; H D C S). ?? = face-down. In each column the top of the stack is the rightmost card.' || chr(10) || chr(10) || 'FOUNDATIONS:   ' || tops || chr(10) || 'STOCK: ' || stock || ' cards   WASTE top: ' || wt || '   recycle stock: ' || rec || chr(10) || chr(10) || 'TABLEAU:' || chr(10) || cols || chr(10) || chr(10)
 || 'RECENT MOVES (oldest -> newest; review before picking, do not undo your own work):' || chr(10) || '   1. draw 5C' || chr(10) || '   2. recycle stock' || chr(10) || chr(10) || 'SEEN IN WASTE THIS CYCLE: 5C 6D' || chr(10) || chr(10) || 'LEGAL MOVES (respond with the index of your chosen move):' || chr(10) || coalesce(legal || chr(10), '') || chr(10) || prog || chr(10) || chr(10) || 'PRIOR REASONING (may be obsolete; verify against current state):' || chr(10) || '  1. move: draw' || chr(10) || '     why: none' || chr(10) || chr(10) || 'Now choose the best move and reply with only the JSON object.' AS txt FROM b0""")
def full_prompts(spark, sf):
    """The whole prompt of a position."""
    b = F.col("board")
    t = lambda *x: F.array(*[F.lit(y) for y in x])
    prior = F.array(F.struct(F.lit("draw").alias("move"), F.lit("none").alias("why")))
    return boards(spark, sf).select("seed", hn.full_prompt(b, hn.visible_moves(b), t("draw 5C", "recycle stock"), t("5C", "6D"), prior, F.array().cast("array<string>"), "H\n").alias("txt"))


@query(f"""WITH {_PROMPT}, s0 AS (SELECT seed, string_agg('???', ' ') AS ahead FROM c WHERE pile_kind = 'stock' GROUP BY seed), q0 AS (SELECT c.seed, string_agg(CASE WHEN c.pos = b0.waste - 1 THEN '{{' || ({_R})[rank] || upper(left(suit, 1)) || '}}' ELSE ({_R})[rank] || upper(left(suit, 1)) END, ' ' ORDER BY pos DESC) AS line FROM c JOIN b0 ON b0.seed = c.seed WHERE pile_kind = 'waste' GROUP BY c.seed)
SELECT b0.seed, 'CURRENT GAME:' || chr(10) || 'FOUNDATIONS:   ' || tops || chr(10) || 'STOCK: ' || stock || ' cards   CYCLE: 2   WASTE top: ' || wt || '   recycle stock: ' || rec || chr(10) || chr(10) || 'TABLEAU:' || chr(10) || cols || chr(10) || chr(10) || 'RECENT MOVES (oldest -> newest; review before picking, do not undo your own work):' || chr(10) || '  1. draw 5C' || chr(10) || chr(10)
 || CASE WHEN waste > 0 THEN 'DRAW TIMELINE:' || chr(10) || '  ' || coalesce(ahead || ' ', '') || line || chr(10) || chr(10) ELSE '' END || 'LEGAL MOVES (respond with the index of your chosen move):' || chr(10) || coalesce(legal25 || chr(10), '') || chr(10) || prog || ', turns since foundation grew: 3, turns since a card was revealed: 4' || chr(10) || chr(10) || 'Now choose the best move and reply with only the JSON object.' AS txt
 FROM b0 LEFT JOIN s0 ON s0.seed = b0.seed LEFT JOIN q0 ON q0.seed = b0.seed""")
def timeline_prompts(spark, sf):
    """The later prompt with its timeline of draws; no card has been seen before."""
    b = F.col("board")
    return boards(spark, sf).select("seed", hn.timeline_prompt(b, hn.visible_moves(b), F.array(F.lit("draw 5C")), F.lit(2), F.array().cast("array<string>"), F.lit(3), F.lit(4)).alias("txt"))


_SYM = "(['A', '2', '3', '4', '5', '6', '7', '8', '9', '10', 'J', 'Q', 'K'])[{0}rank] || CASE {0}suit WHEN 'hearts' THEN '♥' WHEN 'diamonds' THEN '♦' WHEN 'clubs' THEN '♣' ELSE '♠' END"


@query(f"""WITH {C}, g0 AS (SELECT seed, string_agg('  ' || (['Hearts', 'Diamonds', 'Clubs', 'Spades'])[pile_idx + 1] || ': ' || CASE WHEN size = 0 THEN 'Empty' ELSE {_SYM.format('')} || ' (' || size || ' cards)' END, chr(10) ORDER BY pile_idx) AS goal FROM top WHERE pile_kind = 'foundation' GROUP BY seed),
p0 AS (SELECT seed, pile_idx, string_agg({_SYM.format('')}, ' -> ' ORDER BY pos) FILTER (WHERE face_up) AS up FROM c WHERE pile_kind = 'tableau' GROUP BY ALL), t0 AS (SELECT n.seed, string_agg('  Pile ' || (n.pile_idx + 1) || ': ' || CASE WHEN n.size = 0 THEN 'Empty (can place King here)' ELSE CASE WHEN n.down > 0 THEN '[' || n.down || ' face-down] ' ELSE '' END || coalesce(p0.up, '[no face-up cards]') END, chr(10) ORDER BY n.pile_idx) AS cols FROM n LEFT JOIN p0 ON p0.seed = n.seed AND p0.pile_idx = n.pile_idx WHERE n.pile_kind = 'tableau' GROUP BY n.seed),
o0 AS (SELECT seed, string_agg(i || '. ' || CASE g WHEN 0 THEN 'Move card from tableau ' || src || ' to foundation ' || dst WHEN 1 THEN 'Move card from waste to foundation ' || dst WHEN 2 THEN 'Move ' || n || ' card(s) from tableau ' || src || ' to tableau ' || dst WHEN 3 THEN 'Move card from waste to tableau ' || dst ELSE 'Draw from stock' END, chr(10) ORDER BY i) AS mv FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY g, src, k, dst) - 1 AS i FROM m) GROUP BY seed)
SELECT z.seed, '=== Current Solitaire Game State ===' || chr(10) || chr(10) || 'FOUNDATIONS (Goal):' || chr(10) || goal || chr(10) || chr(10) || 'TABLEAU (Main Playing Area):' || chr(10) || cols || chr(10) || chr(10) || 'DRAW PILE:' || chr(10) || '  Stock: ' || z.stock || ' cards remaining' || chr(10) || CASE WHEN z.waste = 0 THEN '  Waste: Empty' ELSE '  Waste (top card): ' || {_SYM.format('w.')} END || chr(10) || chr(10) || 'Current Score: 0' || chr(10) || 'Moves Made: 0' AS txt, coalesce(o0.mv, '') AS moves
 FROM z JOIN g0 ON z.seed = g0.seed JOIN t0 ON z.seed = t0.seed JOIN top w ON w.seed = z.seed AND w.pile_kind = 'waste' LEFT JOIN o0 ON o0.seed = z.seed""")
def spoken_boards(spark, sf):
    """Boards and moves in words."""
    b = F.col("board")
    return boards(spark, sf).select("seed", hn.spoken_board(b).alias("txt"), hn.spoken_moves(bd.legal_moves(b)).alias("moves"))


@query(f"""WITH {C}, k0 AS (SELECT m.seed, row_number() OVER (PARTITION BY m.seed ORDER BY g, m.src, m.k, m.dst) - 1 AS i, 100 * (fnd + CASE WHEN g < 2 THEN 1 ELSE 0 END) + 10 * (tab + CASE g WHEN 0 THEN -1 WHEN 3 THEN 1 ELSE 0 END - z.down + CASE WHEN g IN (0, 2) AND s.size - m.n > 0 AND s.size - m.n <= s.down THEN 1 ELSE 0 END) + 20 * (empties + CASE WHEN g IN (0, 2) AND s.size = m.n THEN 1 ELSE 0 END - CASE WHEN g IN (2, 3) AND d.size = 0 THEN 1 ELSE 0 END)
 - 2 * (waste + CASE g WHEN 4 THEN 1 WHEN 1 THEN -1 WHEN 3 THEN -1 ELSE 0 END) - 5 * (stock - CASE WHEN g = 4 THEN 1 ELSE 0 END) AS score FROM m JOIN z ON z.seed = m.seed LEFT JOIN n s ON s.seed = m.seed AND s.pile_kind = 'tableau' AND s.pile_idx = m.src LEFT JOIN n d ON d.seed = m.seed AND d.pile_kind = 'tableau' AND d.pile_idx = m.dst AND g IN (2, 3)),
r0 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, i) AS r, count(*) OVER (PARTITION BY seed) AS considered FROM k0) SELECT seed, CAST(i AS INT) AS idx, CAST(score AS DOUBLE) AS score, CAST(considered AS INT) AS considered FROM r0 WHERE r = 1""")
def best_of_all(spark, sf):
    """The move whose board scores best, every candidate counted once though proposed twice."""
    b = F.col("board")
    choose = lambda m: let(hn.best_of(b, F.concat(m, m)), lambda x: F.when(x.isNotNull(), F.struct((F.array_position(m, x["move"]) - 1).cast("int").alias("idx"), x["score"].alias("score"), x["considered"].alias("considered"))))
    d = boards(spark, sf).select("seed", F.explode(F.array_compact(F.array(let(bd.legal_moves(b), choose)))).alias("x"))
    return d.select("seed", "x.idx", "x.score", "x.considered")


@query(f"""WITH {_D}, r0 AS (SELECT x.*, row_number() OVER (PARTITION BY x.seed ORDER BY idx DESC) AS b FROM x) SELECT r0.seed, CAST(z.fnd AS INT) AS foundation_cards, CAST(z.down AS INT) AS face_down, CAST(idx AS INT) AS chosen, CASE WHEN g < 2 THEN 1 ELSE 0 END AS foundation_delta, CAST(CASE WHEN g IN (0, 2) AND ssize - n > 0 AND ssize - n <= sdown THEN -1 ELSE 0 END AS INT) AS face_down_delta FROM r0 JOIN z ON z.seed = r0.seed WHERE b = 1""")
def turn_records(spark, sf):
    """Training records of the last legal move of every board."""
    b, m = F.col("board"), bd.legal_moves(F.col("board"))
    d = boards(spark, sf).select("seed", F.explode(F.array_compact(F.array(let(m, lambda x: F.when(F.size(x) > 0, hn.turn_records(b, x, F.element_at(x, -1))))))).alias("r"))
    return d.select("seed", F.col("r.metrics.foundationCards").alias("foundation_cards"), F.col("r.metrics.faceDownTotal").alias("face_down"), F.col("r.chosenMoveIndex").cast("int").alias("chosen"), F.col("r.moveEffect.foundationDelta").alias("foundation_delta"), F.col("r.moveEffect.faceDownDelta").alias("face_down_delta"))


@query(f"""WITH {C} SELECT seed, CAST(fnd AS INT) AS foundation_cards, CAST(down AS INT) AS face_down_cards, CAST((SELECT count(*) FROM m WHERE m.seed = z.seed) AS INT) AS moves, false AS won FROM z""")
def move_reports(spark, sf):
    """Move reports as documents, read back."""
    v = F.from_json(hn.move_report(F.col("board")), "current_state struct<foundation_cards:int,face_down_cards:int,game_won:boolean>, all_moves array<struct<move:string>>")
    return boards(spark, sf).select("seed", v.alias("v")).select("seed", "v.current_state.foundation_cards", "v.current_state.face_down_cards", F.size("v.all_moves").alias("moves"), F.col("v.current_state.game_won").alias("won"))


@query(f"""WITH {C}, p0 AS (SELECT seed, pile_idx, string_agg(CASE WHEN face_up THEN rank || suit ELSE '?' END, ',' ORDER BY pos) AS l FROM c WHERE pile_kind = 'tableau' GROUP BY ALL), t0 AS (SELECT n.seed, string_agg(coalesce(p0.l, ''), '|' ORDER BY n.pile_idx) AS t FROM n LEFT JOIN p0 ON p0.seed = n.seed AND p0.pile_idx = n.pile_idx WHERE n.pile_kind = 'tableau' GROUP BY n.seed),
f0 AS (SELECT seed, string_agg(CASE WHEN size = 0 THEN '-' ELSE rank || suit END, ',' ORDER BY pile_idx) AS f FROM top WHERE pile_kind = 'foundation' GROUP BY seed) SELECT z.seed, 'T[' || t || ']F[' || f || ']S' || stock || 'W' || waste AS signature FROM z JOIN t0 ON t0.seed = z.seed JOIN f0 ON f0.seed = z.seed""")
def position_signatures(spark, sf):
    """Signatures of positions for finding repeats."""
    from ..operators import documents as doc

    return boards(spark, sf).select("seed", doc.position_signature(F.col("board")).alias("signature"))


@query(f"WITH {C} SELECT seed, CAST(100 * fnd + 10 * (tab - down) + 20 * empties - 2 * waste - 5 * stock AS FLOAT) AS score FROM z")
def tensor_scores(spark, sf):
    """Scores as a feature vector times fixed weights in single precision."""
    return boards(spark, sf).select("seed", bd.tensor_score(F.col("board")).alias("score"))


# ---------------------------------------------------------------- decks
_CARDJ = "(['A', '2', '3', '4', '5', '6', '7', '8', '9', '10', 'J', 'Q', 'K'])[rank]"


@query(f"""WITH {DEAL} SELECT s.seed, c.rank AS next_rank, c.suit AS next_suit, l.rank AS last_rank, 28 - 7 AS hidden, true AS stock_up FROM s JOIN c ON c.seed = s.seed AND c.pile_kind = 'stock' AND c.pos = 23 JOIN c l ON l.seed = s.seed AND l.pile_kind = 'stock' AND l.pos = 0 WHERE s.seed % 5 > 0""")
def decks_to_boards(spark, sf):
    """Decks of won games as documents with the next card first, hydrated to boards; games not won or broken give none."""
    ranks = F.array(*[F.lit(r) for r in ("A", *map(str, range(2, 11)), "J", "Q", "K")])
    plain = lambda c, up: F.struct(F.get(ranks, c["rank"] - 1).alias("rank"), c["suit"].alias("suit"), up.alias("faceUp"))
    b = F.col("board")
    setup = F.struct(F.transform(b["tableau"], lambda p: F.transform(p, lambda c: plain(c, c["face_up"]))).alias("tableau"), F.transform(F.slice(F.reverse(b["stock"]), F.lit(1), F.when(F.col("seed") % 10 == 5, 23).otherwise(24)), lambda c: plain(c, F.lit(False))).alias("drawPile"))
    d = deals(spark, sf).select("seed", hn.deck_record(F.col("seed") % 10 != 0, setup, F.col("seed")).alias("deck")).filter("deck IS NOT NULL")
    x = F.col("x")
    d = d.select("seed", hn.deck_to_board(F.col("deck")).alias("x"))
    return d.select("seed", bd.top(x["stock"])["rank"].alias("next_rank"), bd.top(x["stock"])["suit"].alias("next_suit"), F.get(x["stock"], F.lit(0))["rank"].alias("last_rank"), bd.face_down(x).alias("hidden"), F.forall(x["stock"], lambda c: c["face_up"]).alias("stock_up"))


@query("WITH s AS (SELECT DISTINCT deck_seed AS seed FROM run_summary WHERE deck_seed IS NOT NULL) SELECT seed, CASE WHEN seed % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM s")
def deck_lookup(spark, sf):
    """The deck of each seed in the first source that has it."""
    s = table(spark, sf, "run_summary", "deck_seed").filter("deck_seed IS NOT NULL").select(F.col("deck_seed").alias("seed")).distinct()
    decks = s.filter(F.col("seed") % 2 == 0).withColumn("source", F.lit("a")).unionByName(s.withColumn("source", F.lit("b")))
    return hn.find_deck(decks, s, "seed", "source").select("seed", "deck.source")


@query()
def mersenne_deals(spark, sf):
    """Deals by the Mersenne Twister's shuffle, card by card."""
    s = table(spark, sf, "run_summary", "deck_seed").filter("deck_seed IS NOT NULL").select(F.col("deck_seed").alias("seed")).distinct()
    return bd.cells(hn.mersenne_deals(s))


@query()
def best_of_n_games(spark, sf):
    """Thirty turns of best-of-all play per deal."""
    return hn.play_best_of(_games(spark, sf), "exhaustive", 0, 30)


@query(f"""WITH {DEAL}, n0 AS (SELECT seed, count(*) AS k FROM m WHERE g <> 0 OR dst = (SELECT i FROM (VALUES ('hearts', 0), ('diamonds', 1), ('clubs', 2), ('spades', 3)) q(t, i) WHERE t = (SELECT suit FROM tops WHERE tops.seed = m.seed AND tops.pile_idx = m.src)) GROUP BY seed), r0 AS (SELECT seed, i, CASE WHEN seed % 3 = 0 AND i = 2 THEN 'drift' WHEN seed % 3 = 0 AND i > 2 THEN 'skipped' WHEN seed % 3 = 1 AND i = 1 THEN 'illegal' WHEN seed % 3 = 1 AND i > 1 THEN 'skipped' ELSE 'ok' END AS state FROM n0, range(4) t(i))
SELECT seed AS game, CAST(i AS INT) AS turn, 0 AS fc, 21 AS fd, state FROM r0""")
def replay_drift(spark, sf):
    """Four recorded draws per deal replayed; counts that do not fit and impossible moves are reported."""
    rec = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.struct(F.when((F.col("game") % 3 == 1) & (i == 1), 99).otherwise(hn.LAST).alias("index"), F.lit(0).alias("fc"), F.when((F.col("game") % 3 == 0) & (i == 2), 20).otherwise(21).alias("fd")))
    return hn.replay_checked(_games(spark, sf).withColumn("moves", rec))
