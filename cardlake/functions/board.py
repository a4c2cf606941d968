"""Boards as nested rows: deals, rules, legal moves, moves applied, scores, views. Column expressions only.

A card is STRUCT<rank, suit, face_up>; the end of a pile is its top. A board is STRUCT<tableau (7), foundations (4),
stock, waste, move_count, score>. A move is STRUCT<move_type, source_pile, dest_pile, num_cards, score_delta>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .actions import let

SUITS = ("hearts", "diamonds", "clubs", "spades")
RANKS = ("A", "2", "3", "4", "5", "6", "7", "8", "9", "T", "J", "Q", "K")
CARD = "struct<rank:int,suit:string,face_up:boolean>"
BOARD = f"struct<tableau:array<array<{CARD}>>,foundations:array<array<{CARD}>>,stock:array<{CARD}>,waste:array<{CARD}>,move_count:int,score:int>"
MOVE = "struct<move_type:string,source_pile:int,dest_pile:int,num_cards:int,score_delta:int>"


def _seq(n: int) -> Column:
    return F.array(*[F.lit(i) for i in range(n)])


def card(rank: Column, suit: Column, face_up: Column) -> Column:
    return F.struct(rank.cast("int").alias("rank"), suit.alias("suit"), face_up.alias("face_up"))


def turned(c: Column, up: bool = True) -> Column:
    return card(c["rank"], c["suit"], F.lit(up))


def is_red(c: Column) -> Column:
    return c["suit"].isin("hearts", "diamonds")


def can_stack(c: Column, onto: Column) -> Column:
    """A king on an empty pile, else one rank lower and the other colour. False when there is no card."""
    return F.coalesce(F.when(onto.isNull(), c["rank"] == 13).otherwise((is_red(c) != is_red(onto)) & (c["rank"] == onto["rank"] - 1)), F.lit(False))


def can_found(c: Column, top: Column) -> Column:
    """An ace on an empty foundation, else the next rank of the suit. False when there is no card."""
    return F.coalesce(F.when(top.isNull(), c["rank"] == 1).otherwise((c["suit"] == top["suit"]) & (c["rank"] == top["rank"] + 1)), F.lit(False))


def top(pile: Column) -> Column:
    return F.try_element_at(pile, F.lit(-1))


def deal(seed: Column) -> Column:
    """The board of a seed: 52 cards in the order of sha256(seed:card), 28 in seven piles with the last card up, the
    rest in the stock."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(51)), lambda k: F.struct(F.sha2(F.concat_ws(":", seed.cast("string"), k.cast("string")), 256).alias("h"), k.alias("k"))))
    suits = F.array(*[F.lit(s) for s in SUITS])
    return laid_out(F.transform(order, lambda x: card(x["k"] % 13 + 1, F.get(suits, F.floor(x["k"] / 13).cast("int")), F.lit(False))))


def laid_out(cards: Column) -> Column:
    """The opening board of 52 face-down cards in their order."""

    def lay(c: Column) -> Column:
        piles = [F.concat(F.slice(c, i * (i + 1) // 2 + 1, i), F.array(turned(F.get(c, F.lit(i * (i + 1) // 2 + i))))) for i in range(7)]
        none = F.array().cast(f"array<{CARD}>")
        return F.struct(F.array(*piles).alias("tableau"), F.array(none, none, none, none).alias("foundations"), F.slice(c, 29, 24).alias("stock"), none.alias("waste"), F.lit(0).alias("move_count"), F.lit(0).alias("score"))

    return let(cards, lay)


def _move(kind: str, source: Column | None, dest: Column | None, n: Column | int = 1, score: int = 0) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(F.lit(kind).alias("move_type"), (none if source is None else source.cast("int")).alias("source_pile"), (none if dest is None else dest.cast("int")).alias("dest_pile"), (F.lit(n) if isinstance(n, int) else n).cast("int").alias("num_cards"), F.lit(score).alias("score_delta"))


def _some(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def legal_moves(b: Column) -> Column:
    """All moves in their fixed order: tableau to foundation, waste to foundation, tableau to tableau, waste to
    tableau, draw. A run moves as a unit whatever its order; a whole pile is not moved to an empty one."""
    tab, fnd, waste = b["tableau"], b["foundations"], b["waste"]
    t2f = F.flatten(F.transform(tab, lambda p, i: F.transform(fnd, lambda f, j: _some(F.coalesce(top(p)["face_up"], F.lit(False)) & can_found(top(p), top(f)), _move("tableau_to_foundation", i, j, 1, 10)))))
    w2f = F.transform(fnd, lambda f, j: _some(can_found(top(waste), top(f)), _move("waste_to_foundation", None, j, 1, 10)))

    def from_pile(p: Column, i: Column) -> Column:
        hidden = F.size(F.filter(p, lambda c: ~c["face_up"]))
        starts = F.when(F.size(p) > hidden, F.sequence(hidden, F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        onto = lambda k: F.transform(tab, lambda q, j: _some((i != j) & can_stack(F.get(p, k), top(q)) & ~((F.size(q) == 0) & (k == 0)), _move("tableau_to_tableau", i, j, F.size(p) - k)))
        return F.flatten(F.transform(starts, onto))

    t2t = F.flatten(F.transform(tab, from_pile))
    w2t = F.transform(tab, lambda q, j: _some(can_stack(top(waste), top(q)), _move("waste_to_tableau", None, j, 1, 5)))
    draw = F.array(_some(F.size(b["stock"]) > 0, _move("stock_to_waste", None, None)))
    return F.array_compact(F.concat(t2f, w2f, t2t, w2t, draw))


def _flipped(p: Column) -> Column:
    """The pile with its top card turned up."""
    return F.when(F.size(p) > 0, F.concat(F.slice(p, F.lit(1), F.size(p) - 1), F.array(turned(top(p))))).otherwise(p)


def _without(p: Column, n: Column) -> Column:
    return F.slice(p, F.lit(1), F.greatest(F.lit(0), F.size(p) - n))


def is_valid(b: Column, m: Column) -> Column:
    """Whether a move may be made. A number of cards below one is never valid."""
    kind, src, dst, n = m["move_type"], m["source_pile"], m["dest_pile"], m["num_cards"]
    sp, dp, fp = F.get(b["tableau"], src), F.get(b["tableau"], dst), F.get(b["foundations"], dst)
    run = F.slice(sp, F.greatest(F.lit(1), F.size(sp) - n + 1), F.greatest(F.lit(0), n))
    w = top(b["waste"])
    t2t = (src != dst) & (n >= 1) & (F.size(sp) >= n) & F.forall(run, lambda c: c["face_up"]) & can_stack(F.get(run, F.lit(0)), top(dp)) & dp.isNotNull()
    return F.coalesce(
        F.when(kind == "stock_to_waste", F.size(b["stock"]) > 0)
        .when(kind == "tableau_to_foundation", top(sp)["face_up"] & fp.isNotNull() & can_found(top(sp), top(fp)))
        .when(kind == "waste_to_foundation", fp.isNotNull() & can_found(w, top(fp)))
        .when(kind == "tableau_to_tableau", t2t)
        .when(kind == "waste_to_tableau", dp.isNotNull() & can_stack(w, top(dp)))
        .when(kind == "flip_tableau_card", ~top(sp)["face_up"]),
        F.lit(False),
    )


def apply_move(b: Column, m: Column) -> Column:
    """The board after a move; null when it is not valid. An exposed card turns up by itself; an explicit flip scores 5
    more. A plain draw moves one card and leaves it as it lies."""
    kind, src, dst, n = m["move_type"], m["source_pile"], m["dest_pile"], m["num_cards"]
    from_tab = kind.isin("tableau_to_foundation", "tableau_to_tableau")
    taken = F.when(kind == "tableau_to_foundation", 1).otherwise(n)
    sp = F.get(b["tableau"], src)
    run = F.slice(sp, F.greatest(F.lit(1), F.size(sp) - taken + 1), taken)
    w = F.array(top(b["waste"]))
    moved = F.when(from_tab, run).when(kind.isin("waste_to_foundation", "waste_to_tableau"), w)

    def pile(p: Column, i: Column) -> Column:
        return (
            F.when(from_tab & (i == src), _flipped(_without(p, taken)))
            .when(kind.isin("tableau_to_tableau", "waste_to_tableau") & (i == dst), F.concat(p, moved))
            .when((kind == "flip_tableau_card") & (i == src), _flipped(p))
            .otherwise(p)
        )

    tableau = F.transform(b["tableau"], pile)
    found = F.transform(b["foundations"], lambda f, j: F.when(kind.isin("tableau_to_foundation", "waste_to_foundation") & (j == dst), F.concat(f, moved)).otherwise(f))
    draw = kind == "stock_to_waste"
    stock = F.when(draw, _without(b["stock"], F.lit(1))).otherwise(b["stock"])
    waste = F.when(draw, F.concat(b["waste"], F.array(top(b["stock"])))).when(kind.isin("waste_to_foundation", "waste_to_tableau"), _without(b["waste"], F.lit(1))).otherwise(b["waste"])
    score = b["score"] + m["score_delta"] + F.when(kind == "flip_tableau_card", 5).otherwise(0)
    return F.when(is_valid(b, m), F.struct(tableau.alias("tableau"), found.alias("foundations"), stock.alias("stock"), waste.alias("waste"), (b["move_count"] + 1).alias("move_count"), score.cast("int").alias("score")))


def session_draw(b: Column, n: Column) -> Column:
    """Draw up to ``n`` cards face up, as a session does; null when the stock is empty."""
    k = F.least(n, F.size(b["stock"]))
    drawn = F.transform(F.reverse(F.slice(b["stock"], F.size(b["stock"]) - k + 1, k)), lambda c: turned(c))
    return F.when(F.size(b["stock"]) > 0, _piles(b, _without(b["stock"], k), F.concat(b["waste"], drawn)))


def session_recycle(b: Column) -> Column:
    """Turn the waste over into the stock, face down; null unless the stock is empty and the waste is not."""
    none = F.array().cast(f"array<{CARD}>")
    return F.when((F.size(b["stock"]) == 0) & (F.size(b["waste"]) > 0), _piles(b, F.transform(F.reverse(b["waste"]), lambda c: turned(c, False)), none))


def _piles(b: Column, stock: Column, waste: Column) -> Column:
    return F.struct(b["tableau"].alias("tableau"), b["foundations"].alias("foundations"), stock.alias("stock"), waste.alias("waste"), (b["move_count"] + 1).alias("move_count"), b["score"].alias("score"))


def state_key(b: Column) -> Column:
    """Equality of boards: tableau and stock with the side that is up, foundations and waste without; no counters."""
    plain = lambda piles: F.transform(piles, lambda c: F.concat_ws("", c["rank"].cast("string"), F.substring(c["suit"], 1, 1)))
    sided = lambda pile: F.transform(pile, lambda c: F.concat_ws("", c["rank"].cast("string"), F.substring(c["suit"], 1, 1), F.when(c["face_up"], "+").otherwise("-")))
    tab = F.array_join(F.transform(b["tableau"], lambda p: F.array_join(sided(p), " ")), "/")
    fnd = F.array_join(F.transform(b["foundations"], lambda p: F.array_join(plain(p), " ")), "/")
    return F.sha2(F.concat_ws("|", tab, fnd, F.array_join(sided(b["stock"]), " "), F.array_join(plain(b["waste"]), " ")), 256)


def count_cards(piles: Column) -> Column:
    return F.aggregate(piles, F.lit(0), lambda a, p: a + F.size(p))


def face_down(b: Column) -> Column:
    return F.aggregate(b["tableau"], F.lit(0), lambda a, p: a + F.size(F.filter(p, lambda c: ~c["face_up"])))


def empty_piles(b: Column) -> Column:
    return F.size(F.filter(b["tableau"], lambda p: F.size(p) == 0))


def is_won(b: Column) -> Column:
    return F.forall(b["foundations"], lambda f: F.size(f) == 13)


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def progression(b: Column) -> Column:
    """0..1: foundations 60 %, revealed cards 20 % (of 28), empty piles 10 %, cards out of stock and waste 10 %."""
    part = F.lit(0.6) * (count_cards(b["foundations"]) / 52) + F.lit(0.2) * _unit(1 - face_down(b) / 28) + F.lit(0.1) * _unit(empty_piles(b) / 7) + F.lit(0.1) * _unit(1 - (F.size(b["stock"]) + F.size(b["waste"])) / 24)
    return F.when(is_won(b), 1.0).otherwise(_unit(part))


def heuristic(b: Column) -> Column:
    """Search score: 100 a foundation card, 10 a face-up tableau card, 20 an empty pile, less 2 a waste and 5 a stock card."""
    up = count_cards(b["tableau"]) - face_down(b)
    return (100 * count_cards(b["foundations"]) + 10 * up + 20 * empty_piles(b) - 2 * F.size(b["waste"]) - 5 * F.size(b["stock"])).cast("int")


def sequence_score(b: Column, length: Column) -> Column:
    """Value of a move sequence that ends in ``b``."""
    v = 100 * count_cards(b["foundations"]) + 20 * (28 - face_down(b)) + 5 * F.size(legal_moves(b)) - F.lit(0.1) * length + b["score"]
    return F.when(is_won(b), 10000.0).otherwise(v)


def dead_end(b: Column, strict: bool = False) -> Column:
    """STRUCT: is_dead_end, no_moves, has_blocking_cards, has_unreachable_cards (never), available_moves,
    face_down_cards, foundation_progress, risk_score."""

    def ordered(run: Column) -> Column:
        return F.forall(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(run) - 2)), lambda k: (F.size(run) < 2) | can_stack(F.get(run, k + 1), F.get(run, k)))

    def blocked(p: Column) -> Column:
        hidden = F.size(F.filter(p, lambda c: ~c["face_up"]))
        return (hidden > 0) & (F.size(p) > hidden) & ~ordered(F.slice(p, hidden + 1, F.size(p)))

    def build(moves: Column) -> Column:
        n = F.size(moves)
        none = (n == 0) | ((n == 1) & (F.size(b["stock"]) == 0))
        block = F.exists(b["tableau"], blocked)
        up = count_cards(b["tableau"]) - face_down(b)
        poor = (up > 20) & (count_cards(b["foundations"]) < 4) & (n < 3) if strict else F.lit(False)
        risk = F.when(none, 0.5).otherwise(0.0) + F.when(block, 0.3).otherwise(0.0)
        risk = F.when(n == 0, 1.0).when(n < 3, F.least(F.lit(1.0), risk + 0.2)).otherwise(risk)
        return F.struct((~is_won(b) & (none | block | poor)).alias("is_dead_end"), none.alias("no_moves"), block.alias("has_blocking_cards"), F.lit(False).alias("has_unreachable_cards"), n.alias("available_moves"), face_down(b).alias("face_down_cards"), (count_cards(b["foundations"]) / 52).alias("foundation_progress"), risk.alias("risk_score"))

    return let(legal_moves(b), build)


def card_code(c: Column) -> Column:
    """``7h``, ``Ts``."""
    return F.concat(F.get(F.array(*[F.lit(r) for r in RANKS]), c["rank"] - 1), F.substring(c["suit"], 1, 1))


def observation(b: Column, face_down_level: str = "count", stock: str = "count", waste: str = "top") -> Column:
    """The board as a player may see it, as JSON text; hidden parts are left out."""
    piles = F.transform(b["tableau"], lambda p: F.struct(
        (F.size(F.filter(p, lambda c: ~c["face_up"]))).alias("faceDownCount"),
        F.transform(F.filter(p, lambda c: c["face_up"]), card_code).alias("faceUp"),
        (F.transform(F.filter(p, lambda c: ~c["face_up"]), card_code) if face_down_level == "revealed" else F.lit(None).cast("array<string>")).alias("faceDown"),
    ))
    st = {"hidden": F.lit(None).cast("int"), "count": F.size(b["stock"]), "revealed": F.size(b["stock"])}[stock]
    cards = F.transform(b["stock"], card_code) if stock == "revealed" else F.lit(None).cast("array<string>")
    ws = F.transform(b["waste"], card_code) if waste == "full" else F.when(F.size(b["waste"]) > 0, F.array(card_code(top(b["waste"])))).otherwise(F.array().cast("array<string>"))
    return F.to_json(F.struct(F.transform(b["foundations"], lambda f: F.size(f)).alias("foundations"), piles.alias("tableau"), st.alias("stockCount"), cards.alias("stock"), ws.alias("waste")))


def render(b: Column) -> Column:
    """Text board: foundations, seven columns with ?? for hidden cards, waste and stock."""
    cell = lambda c: F.when(c["face_up"], card_code(c)).otherwise("??")
    cols = F.transform(b["tableau"], lambda p, i: F.concat(F.lit("col"), (i + 1).cast("string"), F.lit(": "), F.when(F.size(p) == 0, "(empty)").otherwise(F.array_join(F.transform(p, cell), " "))))
    tops = F.transform(b["foundations"], lambda f: F.coalesce(card_code(top(f)), F.lit("--")))
    return F.concat_ws("\n", F.concat(F.lit("FOUNDATIONS: "), F.array_join(tops, " ")), F.array_join(cols, "\n"), F.concat(F.lit("WASTE: "), F.coalesce(card_code(top(b["waste"])), F.lit("--")), F.lit(" STOCK: "), F.size(b["stock"]).cast("string")))


def describe(m: Column) -> Column:
    """A move in words, 1-based columns."""
    src, dst = (m["source_pile"] + 1).cast("string"), (m["dest_pile"] + 1).cast("string")
    return (
        F.when(m["move_type"] == "tableau_to_foundation", F.concat(F.lit("column "), src, F.lit(" to foundation")))
        .when(m["move_type"] == "waste_to_foundation", F.lit("waste to foundation"))
        .when(m["move_type"] == "tableau_to_tableau", F.concat(m["num_cards"].cast("string"), F.lit(" from column "), src, F.lit(" to column "), dst))
        .when(m["move_type"] == "waste_to_tableau", F.concat(F.lit("waste to column "), dst))
        .when(m["move_type"] == "stock_to_waste", F.lit("draw"))
    )


def cells(boards: DataFrame, key: str = "seed", board: str = "board") -> DataFrame:
    """Long form: one row per card (key, pile_kind, pile_idx, pos, rank, suit, face_up)."""
    b = F.col(board)
    pile = lambda kind, i, p: F.transform(p, lambda c, k: F.struct(F.lit(kind).alias("pile_kind"), i.cast("int").alias("pile_idx"), k.cast("int").alias("pos"), c["rank"].alias("rank"), c["suit"].alias("suit"), c["face_up"].alias("face_up")))
    every = F.concat(F.flatten(F.transform(b["tableau"], lambda p, i: pile("tableau", i, p))), F.flatten(F.transform(b["foundations"], lambda p, i: pile("foundation", i, p))), pile("stock", F.lit(0), b["stock"]), pile("waste", F.lit(0), b["waste"]))
    return boards.select(key, F.explode(every).alias("c")).select(key, "c.*")


def move_text(m: Column) -> Column:
    """A move as the log words it: 0-based piles."""
    n = lambda c: m[c].cast("string")
    return (
        F.when(m["move_type"] == "stock_to_waste", "Draw from stock")
        .when(m["move_type"] == "flip_tableau_card", F.concat(F.lit("Flip card on tableau pile "), n("source_pile")))
        .when(m["move_type"] == "tableau_to_tableau", F.concat(F.lit("Move "), n("num_cards"), F.lit(" card(s) from tableau "), n("source_pile"), F.lit(" to tableau "), n("dest_pile")))
        .when(m["move_type"] == "tableau_to_foundation", F.concat(F.lit("Move card from tableau "), n("source_pile"), F.lit(" to foundation "), n("dest_pile")))
        .when(m["move_type"] == "waste_to_tableau", F.concat(F.lit("Move card from waste to tableau "), n("dest_pile")))
        .when(m["move_type"] == "waste_to_foundation", F.concat(F.lit("Move card from waste to foundation "), n("dest_pile")))
        .when(m["move_type"] == "foundation_to_tableau", F.concat(F.lit("Move card from foundation "), n("source_pile"), F.lit(" to tableau "), n("dest_pile")))
        .otherwise(F.concat(F.lit("Unknown move type: "), m["move_type"]))
    )


def card_name(c: Column) -> Column:
    """``7 of hearts``, ``Ace of spades``."""
    rank = F.coalesce(F.try_element_at(F.create_map(F.lit(1), F.lit("Ace"), F.lit(11), F.lit("Jack"), F.lit(12), F.lit("Queen"), F.lit(13), F.lit("King")), c["rank"]), c["rank"].cast("string"))
    return F.concat(rank, F.lit(" of "), c["suit"])


def card_short(c: Column) -> Column:
    """``7H``, ``TS``."""
    return F.upper(card_code(c))


def describe_move(b: Column, m: Column) -> Column:
    """A move in prose with its lead card, 1-based columns, and tags for an empty target and a hidden card it reveals."""
    src, dst = (m["source_pile"] + 1).cast("string"), (m["dest_pile"] + 1).cast("string")
    col, onto, w = F.get(b["tableau"], m["source_pile"]), F.get(b["tableau"], m["dest_pile"]), top(b["waste"])
    lead = F.size(col) - m["num_cards"]
    plus = F.when(m["num_cards"] > 1, F.concat(F.lit(" plus "), (m["num_cards"] - 1).cast("string"), F.lit(" more"))).otherwise("")
    empty = F.when(F.size(onto) == 0, " (empty)").otherwise("")
    reveals = F.when((lead > 0) & ~F.get(col, lead - 1)["face_up"], " (reveals a hidden card)").otherwise("")
    return (
        F.when(m["move_type"] == "stock_to_waste", "Draw the next card from the stock onto the waste")
        .when(m["move_type"] == "recycle_stock", "Recycle the waste pile back into the stock")
        .when(m["move_type"] == "tableau_to_tableau", F.concat(F.lit("Move "), card_short(F.get(col, lead)), plus, F.lit(" from column "), src, F.lit(" to column "), dst, empty, reveals))
        .when(m["move_type"] == "tableau_to_foundation", F.concat(F.lit("Send "), card_short(top(col)), F.lit(" from column "), src, F.lit(" to the "), top(col)["suit"], F.lit(" foundation")))
        .when(m["move_type"] == "waste_to_tableau", F.concat(F.lit("Move "), card_short(w), F.lit(" from the waste to column "), dst, empty))
        .when(m["move_type"] == "waste_to_foundation", F.concat(F.lit("Send "), card_short(w), F.lit(" from the waste to the "), w["suit"], F.lit(" foundation")))
        .otherwise(F.concat(F.lit("("), m["move_type"], F.lit(")")))
    )


def observe(b: Column, face_down_level: str = "count", stock: str = "count", waste: str = "top") -> Column:
    """STRUCT of what a player may see at an information level: face_down count or revealed; stock hidden, count or
    revealed; waste top or full. What a level hides is null."""
    none = F.lit(None).cast(f"array<{CARD}>")
    if face_down_level not in ("count", "revealed") or stock not in ("hidden", "count", "revealed") or waste not in ("top", "full"):
        raise ValueError("unknown information level")
    side = lambda p, up: F.filter(p, lambda c: c["face_up"] == F.lit(up))
    tab = F.transform(b["tableau"], lambda p, i: F.struct(i.cast("int").alias("index"), F.size(p).alias("size"), F.size(side(p, False)).alias("face_down_count"), side(p, True).alias("face_up"), (F.when(F.size(side(p, False)) > 0, side(p, False)) if face_down_level == "revealed" else none).alias("face_down_cards")))
    fnd = F.transform(b["foundations"], lambda f, i: F.struct(i.cast("int").alias("index"), F.size(f).alias("count"), top(f).alias("top")))
    st = F.struct(F.lit(stock == "hidden").alias("hidden"), (F.lit(None).cast("int") if stock == "hidden" else F.size(b["stock"])).alias("count"), (b["stock"] if stock == "revealed" else none).alias("cards"))
    ws = F.struct(F.size(b["waste"]).alias("count"), top(b["waste"]).alias("top"), (b["waste"] if waste == "full" else none).alias("cards"))
    return F.struct(fnd.alias("foundations"), tab.alias("tableau"), st.alias("stock"), ws.alias("waste"), b["move_count"].alias("move_count"), b["score"].alias("score"), is_won(b).alias("won"))


def render_text(b: Column, face_down_level: str = "count", stock: str = "count", waste: str = "top") -> Column:
    """Compact text board at an information level."""
    codes = lambda p: F.array_join(F.transform(p, card_short), " ")
    tops = F.array_join(F.transform(b["foundations"], lambda f: F.coalesce(card_short(top(f)), F.lit("--"))), " ")
    hidden = (lambda c: F.concat(F.lit("("), card_short(c), F.lit(")"))) if face_down_level == "revealed" else (lambda c: F.lit("##"))
    cells = lambda p: F.concat(F.transform(F.filter(p, lambda c: ~c["face_up"]), hidden), F.transform(F.filter(p, lambda c: c["face_up"]), card_short))
    cols = F.transform(b["tableau"], lambda p, i: F.concat(F.lit("  T"), i.cast("string"), F.lit(": "), F.when(F.size(p) == 0, "(empty)").otherwise(F.array_join(cells(p), " "))))
    n, w = F.size(b["stock"]).cast("string"), F.size(b["waste"])
    st = {"hidden": F.lit("Stock: (hidden)"), "revealed": F.concat(F.lit("Stock ("), n, F.lit("): "), codes(b["stock"])), "count": F.concat(F.lit("Stock: "), n, F.lit(" cards"))}[stock]
    ws = F.concat(F.lit("Waste ("), w.cast("string"), F.lit("): "), codes(b["waste"])) if waste == "full" else F.concat(F.lit("Waste: "), card_short(top(b["waste"])), F.lit(" (+"), (w - 1).cast("string"), F.lit(" below)"))
    return F.concat_ws("\n", F.lit("=== Solitaire ==="), F.concat(F.lit("Foundations: "), tops), F.lit("Tableau:"), F.array_join(cols, "\n"), st, F.when(w == 0, "Waste: (empty)").otherwise(ws), F.concat(F.lit("Score: "), b["score"].cast("string"), F.lit("  Moves: "), b["move_count"].cast("string")))


def tensor_score(b: Column) -> Column:
    """Five features times fixed weights, in single precision: foundation cards, face-up cards, empty columns, waste, stock."""
    features = F.array(*[x.cast("float") for x in (count_cards(b["foundations"]), count_cards(b["tableau"]) - face_down(b), empty_piles(b), F.size(b["waste"]), F.size(b["stock"]))])
    weights = F.array(*[F.lit(w).cast("float") for w in (100, 10, 20, -2, -5)])
    return F.aggregate(F.zip_with(features, weights, lambda x, w: x * w), F.lit(0).cast("float"), lambda a, x: a + x)
