"""The playing harness over board rows: visible moves, recycling, move tags, completions, full prompts, best of n,
training records of replayed games, and decks as documents."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import board as bd
from ..functions import prompts as pr
from ..functions.actions import let

#: The harness's name of every engine move.
HARNESS_TYPE = {"stock_to_waste": "draw_card", "recycle_stock": "recycle_stock", "tableau_to_tableau": "tableau_to_tableau", "tableau_to_foundation": "tableau_to_foundation", "waste_to_tableau": "discard_to_tableau", "waste_to_foundation": "discard_to_foundation"}


# ---------------------------------------------------------------- decks


def mersenne_deals(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """(seed, board) dealt from a suit-major deck by the Mersenne Twister's shuffle, whose order no built-in gives: the last
    card of each pile is up, 24 cards stay in the stock. A null seed gives no board."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in pdf[seed].tolist():
                deck = [(r, suit) for suit in bd.SUITS for r in range(1, 14)]
                random.Random(s).shuffle(deck)
                rows.append((s, [x[0] for x in deck], [x[1] for x in deck]))
            yield pd.DataFrame(rows, columns=[seed, "r", "s"])

    d = seeds.filter(F.col(seed).isNotNull()).select(F.col(seed).cast("bigint").alias(seed)).mapInPandas(run, f"{seed} bigint, r array<int>, s array<string>")
    cards = F.zip_with("r", "s", lambda r, s: bd.card(r, s, F.lit(False)))
    return d.select(seed, bd.laid_out(cards).alias("board"))


def deck_record(won: Column, setup: Column, seed: Column) -> Column:
    """STRUCT<seed, tableau, stock, pysol> of a won game's setup STRUCT<tableau, drawPile>; null unless the game was won and
    the setup has 7 columns and 24 cards in the draw pile."""
    fits = F.coalesce(won, F.lit(False)) & (F.size(setup["tableau"]) == 7) & (F.size(setup["drawPile"]) == 24)
    rec = F.struct(seed.alias("seed"), F.transform(setup["tableau"], lambda p: F.transform(p, lambda c: F.struct(c["rank"].alias("rank"), c["suit"].alias("suit"), F.coalesce(c["faceUp"], F.lit(False)).alias("face_up")))).alias("tableau"), F.transform(setup["drawPile"], lambda c: F.struct(c["rank"].alias("rank"), c["suit"].alias("suit"))).alias("stock"))
    return F.when(F.coalesce(fits, F.lit(False)), rec)


def deck_to_board(deck: Column) -> Column:
    """Board of a deck record, whose ranks are A to K as text and whose stock has the next card first: the stock is turned
    round, as the board's next card is the last one, and lies face up."""
    ranks = F.create_map(*[F.lit(x) for i, r in enumerate(("A", *map(str, range(2, 11)), "J", "Q", "K")) for x in (r, i + 1)])
    card = lambda c, up: bd.card(F.try_element_at(ranks, c["rank"]), c["suit"], up)
    none = F.array().cast(f"array<{bd.CARD}>")
    return F.struct(F.transform(deck["tableau"], lambda p: F.transform(p, lambda c: card(c, c["face_up"]))).alias("tableau"), F.array(none, none, none, none).alias("foundations"), F.transform(F.reverse(deck["stock"]), lambda c: card(c, F.lit(True))).alias("stock"), none.alias("waste"), F.lit(0).alias("move_count"), F.lit(0).alias("score"))


def find_deck(decks: DataFrame, seeds: DataFrame, seed: str, source: str) -> DataFrame:
    """The deck of each seed from the first source that has it; a seed without any deck fails the query."""
    first = decks.groupBy(seed).agg(F.min_by(F.struct(*decks.columns), source).alias("d"))
    j = seeds.join(first, seed, "left")
    return j.select(seed, F.when(F.col("d").isNull(), F.raise_error(F.concat(F.lit("no deck for seed "), F.col(seed).cast("string")))).otherwise(F.col("d")).alias("deck"))


# ---------------------------------------------------------------- moves


def visible_moves(b: Column, recycle: bool = True) -> Column:
    """Moves that the agent sees: no flips, foundations only in the order of their suits, and a recycle when the stock is
    empty and the waste is not."""
    suit = F.create_map(*[F.lit(x) for i, s in enumerate(bd.SUITS) for x in (s, i)])
    own = lambda m: F.try_element_at(suit, F.when(m["move_type"] == "tableau_to_foundation", bd.top(F.get(b["tableau"], m["source_pile"]))["suit"]).otherwise(bd.top(b["waste"])["suit"]))
    seen = F.filter(bd.legal_moves(b), lambda m: ~m["move_type"].isin("flip_tableau_card", "foundation_to_tableau") & (~m["move_type"].isin("tableau_to_foundation", "waste_to_foundation") | (m["dest_pile"] == own(m))))
    none = F.lit(None).cast("int")
    turn = F.struct(F.lit("recycle_stock").alias("move_type"), none.alias("source_pile"), none.alias("dest_pile"), F.lit(1).alias("num_cards"), F.lit(0).alias("score_delta"))
    return F.concat(seen, F.when((F.size(b["stock"]) == 0) & (F.size(b["waste"]) > 0), F.array(turn)).otherwise(F.array().cast(f"array<{bd.MOVE}>"))) if recycle else seen


def recycled(b: Column) -> Column:
    """The waste turned back into the stock in its order of drawing; sides and the move count stay."""
    return F.struct(b["tableau"].alias("tableau"), b["foundations"].alias("foundations"), F.reverse(b["waste"]).alias("stock"), F.array().cast(f"array<{bd.CARD}>").alias("waste"), b["move_count"].alias("move_count"), b["score"].alias("score"))


def move_tag(b: Column, m: Column) -> Column:
    """What a move is for: recycle, draw, found_low, found_high, frees_col, reveal_t2t, build, to_empty, waste_build, other."""
    kind = m["move_type"]
    col = F.get(b["tableau"], m["source_pile"])
    lead = F.size(col) - m["num_cards"]
    card = F.when(kind == "tableau_to_foundation", bd.top(col)).otherwise(bd.top(b["waste"]))
    return (
        F.when(kind == "recycle_stock", "recycle")
        .when(kind == "stock_to_waste", "draw")
        .when(kind.isin("tableau_to_foundation", "waste_to_foundation"), F.when(card["rank"] <= 2, "found_low").otherwise("found_high"))
        .when(kind == "tableau_to_tableau", F.when(lead == 0, "frees_col").when(~F.get(col, lead - 1)["face_up"], "reveal_t2t").otherwise("build"))
        .when(kind == "waste_to_tableau", F.when(F.size(F.get(b["tableau"], m["dest_pile"])) == 0, "to_empty").otherwise("waste_build"))
        .otherwise("other")
    )


def completion(b: Column, m: Column, idx: Column, templates: dict[str, tuple[str, str]]) -> Column:
    """A completion for a move as JSON text. ``templates`` has an analysis and a plan by tag, ``{desc}`` in them is the move
    in prose; a tag without its own takes that of other."""
    pairs = [x for tag, (a, p) in templates.items() for x in (F.lit(tag), F.struct(F.lit(a).alias("a"), F.lit(p).alias("p")))]
    t = F.create_map(*pairs)
    chosen = F.coalesce(F.try_element_at(t, move_tag(b, m)), F.try_element_at(t, F.lit("other")))
    fill = lambda x: F.replace(x, F.lit("{desc}"), bd.describe_move(b, m))
    return let(chosen, lambda c: pr.response_text(idx.cast("int"), fill(c["a"]), fill(c["p"])))


# ---------------------------------------------------------------- prompts


def _tops(b: Column) -> Column:
    return F.concat_ws("   ", *[F.concat(F.lit(f"{s[0].upper()}: "), F.coalesce(bd.card_short(bd.top(F.get(b["foundations"], F.lit(i)))), F.lit("--"))) for i, s in enumerate(bd.SUITS)])


def _columns(b: Column) -> Column:
    cell = lambda c: F.when(c["face_up"], bd.card_short(c)).otherwise("??")
    return F.array_join(F.transform(b["tableau"], lambda p, i: F.concat(F.lit("  col"), (i + 1).cast("string"), F.lit(": "), F.when(F.size(p) == 0, "<empty>").otherwise(F.array_join(F.transform(p, cell), " ")))), "\n")


def _legal(b: Column, moves: Column, width: int, gap: str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in HARNESS_TYPE.items() for x in kv])
    return F.array_join(F.transform(moves, lambda m, i: F.concat(F.lit("  ["), i.cast("string"), F.lit("] "), pr.padded(F.coalesce(F.try_element_at(names, m["move_type"]), m["move_type"]), width), F.lit(gap), bd.describe_move(b, m))), "\n")


def _progress(b: Column) -> Column:
    found = bd.count_cards(b["foundations"])
    # half-even rounding of found / 52 in percent; no count of cards falls on a half
    return F.concat(F.lit("PROGRESS: foundation="), found.cast("string"), F.lit("/52, face-down remaining="), bd.face_down(b).cast("string"), F.lit(", completion="), F.round(found / 52 * 100).cast("int").cast("string"), F.lit("%"))


def full_prompt(b: Column, moves: Column, recent: Column, seen: Column, prior: Column, stall: Column, header: str = "") -> Column:
    """The prompt of a position: blocks of the board, the last ten moves (``recent``, compact lines), cards ``seen`` in the
    waste, legal moves, progress, ``stall`` lines and the last five entries of ``prior`` (STRUCT<move, why>)."""
    last = F.slice(recent, F.greatest(F.lit(1), F.size(recent) - 9), F.lit(10))
    lines = F.transform(last, lambda x, i: F.concat(F.lit("  "), F.lpad((i + 1).cast("string"), 2, " "), F.lit(". "), x))
    why = F.transform(F.slice(prior, F.greatest(F.lit(1), F.size(prior) - 4), F.lit(5)), lambda p, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". move: "), p["move"], F.lit("\n     why: "), p["why"]))
    block = lambda title, body, cond: F.when(cond, F.concat(F.lit(title), body, F.lit("\n")))
    recycle = F.when((F.size(b["stock"]) == 0) & (F.size(b["waste"]) > 0), "yes").otherwise("no")
    return F.concat(F.lit(header), F.concat_ws(
        "\n",
        F.lit("CURRENT GAME:\nNOTATION: rank+suit (A 2-9 T J Q K; H D C S). ?? = face-down. In each column the top of the stack is the rightmost card.\n"),
        F.concat(F.lit("FOUNDATIONS:   "), _tops(b)),
        F.concat(F.lit("STOCK: "), F.size(b["stock"]).cast("string"), F.lit(" cards   WASTE top: "), F.coalesce(bd.card_short(bd.top(b["waste"])), F.lit("--")), F.lit("   recycle stock: "), recycle, F.lit("\n")),
        F.concat(F.lit("TABLEAU:\n"), _columns(b), F.lit("\n")),
        block("RECENT MOVES (oldest -> newest; review before picking, do not undo your own work):\n", F.array_join(lines, "\n"), F.size(recent) > 0),
        block("SEEN IN WASTE THIS CYCLE: ", F.array_join(seen, " "), F.size(seen) > 0),
        F.concat(F.lit("LEGAL MOVES (respond with the index of your chosen move):\n"), F.when(F.size(moves) > 0, F.concat(_legal(b, moves, 24, "  "), F.lit("\n"))).otherwise("")),
        F.concat(_progress(b), F.lit("\n")),
        block("", F.array_join(stall, "\n"), F.size(stall) > 0),
        block("PRIOR REASONING (may be obsolete; verify against current state):\n", F.array_join(why, "\n"), F.size(prior) > 0),
        F.lit("Now choose the best move and reply with only the JSON object."),
    ))


def timeline_prompt(b: Column, moves: Column, recent: Column, cycle: Column, ever_seen: Column, since_foundation: Column, since_reveal: Column, header: str = "") -> Column:
    """The later prompt: the cycle beside the stock, a timeline of draws around the waste's top while there is a waste,
    cards never drawn as ???, and two stall counters behind the progress."""
    last = F.slice(recent, F.greatest(F.lit(1), F.size(recent) - 9), F.lit(10))
    lines = F.transform(last, lambda x, i: F.concat(F.lit("  "), F.lpad((i + 1).cast("string"), F.length(F.size(last).cast("string")), F.lit(" ")), F.lit(". "), x))
    recycle = F.when((F.size(b["stock"]) == 0) & (F.size(b["waste"]) > 0), "yes").otherwise("no")
    ahead = F.transform(b["stock"], lambda c: F.when(F.array_contains(ever_seen, bd.card_short(c)), bd.card_short(c)).otherwise("???"))
    behind = F.transform(F.reverse(F.slice(b["waste"], F.lit(1), F.greatest(F.lit(0), F.size(b["waste"]) - 1))), bd.card_short)
    line = F.array_join(F.concat(ahead, F.array(F.concat(F.lit("{"), bd.card_short(bd.top(b["waste"])), F.lit("}"))), behind), " ")
    return F.concat(F.lit(header), F.concat_ws(
        "\n",
        F.concat(F.lit("CURRENT GAME:\nFOUNDATIONS:   "), _tops(b)),
        F.concat(F.lit("STOCK: "), F.size(b["stock"]).cast("string"), F.lit(" cards   CYCLE: "), cycle.cast("string"), F.lit("   WASTE top: "), F.coalesce(bd.card_short(bd.top(b["waste"])), F.lit("--")), F.lit("   recycle stock: "), recycle, F.lit("\n")),
        F.concat(F.lit("TABLEAU:\n"), _columns(b), F.lit("\n")),
        F.when(F.size(recent) > 0, F.concat(F.lit("RECENT MOVES (oldest -> newest; review before picking, do not undo your own work):\n"), F.array_join(lines, "\n"), F.lit("\n"))),
        F.when(F.size(b["waste"]) > 0, F.concat(F.lit("DRAW TIMELINE:\n  "), line, F.lit("\n"))),
        F.concat(F.lit("LEGAL MOVES (respond with the index of your chosen move):\n"), F.when(F.size(moves) > 0, F.concat(_legal(b, moves, 25, ""), F.lit("\n"))).otherwise("")),
        F.concat(_progress(b), F.lit(", turns since foundation grew: "), since_foundation.cast("string"), F.lit(", turns since a card was revealed: "), since_reveal.cast("string"), F.lit("\n")),
        F.lit("Now choose the best move and reply with only the JSON object."),
    ))


def symbol_card(c: Column) -> Column:
    """``10♥``, ``A♠``."""
    rank = F.coalesce(F.try_element_at(F.create_map(F.lit(1), F.lit("A"), F.lit(11), F.lit("J"), F.lit(12), F.lit("Q"), F.lit(13), F.lit("K")), c["rank"]), c["rank"].cast("string"))
    return F.concat(rank, F.try_element_at(F.create_map(*[F.lit(x) for kv in zip(bd.SUITS, "♥♦♣♠") for x in kv]), c["suit"]))


def spoken_board(b: Column) -> Column:
    """A board in words for a language model: goal piles, columns, draw pile, score."""
    n = lambda c: c.cast("string")
    goal = [F.coalesce(F.concat(F.lit(f"  {s.capitalize()}: "), symbol_card(bd.top(F.get(b["foundations"], F.lit(i)))), F.lit(" ("), n(F.size(F.get(b["foundations"], F.lit(i)))), F.lit(" cards)")), F.lit(f"  {s.capitalize()}: Empty")) for i, s in enumerate(bd.SUITS)]

    def column(p: Column, i: Column) -> Column:
        hidden, up = F.size(F.filter(p, lambda c: ~c["face_up"])), F.filter(p, lambda c: c["face_up"])
        cards = F.when(F.size(up) > 0, F.array_join(F.transform(up, symbol_card), " -> ")).otherwise("[no face-up cards]")
        return F.concat(F.lit("  Pile "), n(i + 1), F.lit(": "), F.when(F.size(p) == 0, "Empty (can place King here)").otherwise(F.concat(F.when(hidden > 0, F.concat(F.lit("["), n(hidden), F.lit(" face-down] "))).otherwise(""), cards)))

    waste = F.coalesce(F.concat(F.lit("  Waste (top card): "), symbol_card(bd.top(b["waste"]))), F.lit("  Waste: Empty"))
    return F.concat_ws("\n", F.lit("=== Current Solitaire Game State ===\n\nFOUNDATIONS (Goal):"), *goal, F.lit("\nTABLEAU (Main Playing Area):"), F.array_join(F.transform(b["tableau"], column), "\n"), F.concat(F.lit("\nDRAW PILE:\n  Stock: "), n(F.size(b["stock"])), F.lit(" cards remaining")), waste, F.concat(F.lit("\nCurrent Score: "), n(b["score"])), F.concat(F.lit("Moves Made: "), n(b["move_count"])))


def spoken_moves(moves: Column) -> Column:
    return F.array_join(F.transform(moves, lambda m, i: F.concat(i.cast("string"), F.lit(". "), bd.move_text(m))), "\n")


# ---------------------------------------------------------------- choosing and recording


def best_of(b: Column, candidates: Column) -> Column:
    """STRUCT<move, score, considered>: candidates without repetitions, scored by the board after them; the first best one.
    Moves that cannot be made score lowest. Null without candidates."""
    distinct = F.array_distinct(candidates)
    value = lambda m: let(bd.apply_move(b, m), lambda a: F.coalesce(bd.heuristic(a).cast("double"), F.lit(float("-inf"))))
    scored = F.transform(distinct, lambda m, i: F.struct((-value(m)).alias("s"), i.alias("i"), m.alias("m")))
    return let(F.array_sort(scored), lambda a: F.when(F.size(a) > 0, F.struct(F.get(a, F.lit(0))["m"].alias("move"), (-F.get(a, F.lit(0))["s"]).alias("score"), F.size(a).alias("considered"))))


#: Proposers by name: a board's candidate moves. ``n`` is how many a proposer may give.
PROPOSERS = {
    "first_legal": lambda b, n, seed: F.slice(bd.legal_moves(b), 1, 1),
    "exhaustive": lambda b, n, seed: bd.legal_moves(b),
    "random_n": lambda b, n, seed: let(bd.legal_moves(b), lambda m: F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.get(m, F.pmod(F.xxhash64(seed, i), F.size(m)).cast("int")))).otherwise(m)),
}


def play_best_of(games: DataFrame, proposer: str, n: int, turns: int) -> DataFrame:
    """(game, turns_played, foundation, hidden, won, stuck): best-of-n play folded inside one row per game; it stops when the
    game is won, nothing is proposed or a move changes nothing."""
    propose = PROPOSERS[proposer]
    start = F.struct(F.col("board").alias("board"), F.lit(0).alias("n"), F.lit(False).alias("stuck"))

    def step(z: Column, i: Column) -> Column:
        over = z["stuck"] | bd.is_won(z["board"])

        def go(c: Column) -> Column:
            after = F.when(c.isNotNull(), bd.apply_move(z["board"], c["move"]))
            return let(after, lambda a: F.struct(F.coalesce(a, z["board"]).alias("board"), (z["n"] + F.when(c.isNotNull(), 1).otherwise(0)).alias("n"), (a.isNull() | (bd.state_key(a) == bd.state_key(z["board"]))).alias("stuck")))

        return F.when(over, z).otherwise(let(best_of(z["board"], propose(z["board"], n, i)), go))

    d = games.select("game", F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, step).alias("z"))
    b = F.col("z.board")
    return d.select("game", F.col("z.n").alias("turns_played"), bd.count_cards(b["foundations"]).alias("foundation"), bd.face_down(b).alias("hidden"), bd.is_won(b).alias("won"), F.col("z.stuck").alias("stuck"))


def turn_records(b: Column, moves: Column, chosen: Column) -> Column:
    """STRUCT: a training record of one turn: metrics before, legal moves, the chosen one, and what it changes."""
    metrics = F.struct(bd.count_cards(b["foundations"]).alias("foundationCards"), bd.face_down(b).alias("faceDownTotal"), F.size(b["stock"]).alias("stockRemaining"), F.size(b["waste"]).alias("wasteSize"))
    effect = let(bd.apply_move(b, chosen), lambda after: F.struct((bd.count_cards(after["foundations"]) - bd.count_cards(b["foundations"])).alias("foundationDelta"), (bd.face_down(after) - bd.face_down(b)).alias("faceDownDelta")))
    return F.struct(metrics.alias("metrics"), F.transform(moves, lambda m, i: F.struct(i.alias("index"), bd.move_text(m).alias("describe"))).alias("legalMoves"), (F.array_position(moves, chosen) - 1).alias("chosenMoveIndex"), bd.move_text(chosen).alias("chosenMove"), effect.alias("moveEffect"))


#: Stands for the last visible move in a recorded line.
LAST = -7


def replay_checked(games: DataFrame) -> DataFrame:
    """(game, turn, fc, fd, state): recorded decisions folded onto the deal and held against the recorded foundation and
    hidden counts before each of them. ``moves`` is ARRAY<STRUCT<index, fc, fd>> (the index ``LAST`` is the last visible
    move); state is ok, drift (the counts differ,
    nothing is applied from there on) or illegal (no such visible move)."""
    out = "array<struct<turn:int,fc:int,fd:int,state:string>>"
    start = F.struct(F.col("board").alias("board"), F.lit(True).alias("ok"), F.array().cast(out).alias("log"))

    def step(z: Column, x: Column) -> Column:
        b = z["board"]

        def go(m: Column) -> Column:
            fc, fd = bd.count_cards(b["foundations"]), bd.face_down(b)
            drift = (fc != x["fc"]) | (fd != x["fd"])
            state = F.when(~z["ok"], "skipped").when(F.coalesce(drift, F.lit(False)), "drift").when(m.isNull(), "illegal").otherwise("ok")
            after = F.when(m["move_type"] == "recycle_stock", recycled(b)).otherwise(bd.apply_move(b, m))
            return let(state, lambda s: F.struct(F.when(s == "ok", F.coalesce(after, b)).otherwise(b).alias("board"), (z["ok"] & (s == "ok")).alias("ok"), F.concat(z["log"], F.array(F.struct((F.size(z["log"])).alias("turn"), fc.alias("fc"), fd.alias("fd"), s.alias("state")))).alias("log")))

        moves = visible_moves(b)
        return let(F.when(x["index"] == LAST, F.try_element_at(moves, F.lit(-1))).otherwise(F.get(moves, F.when(x["index"] >= 0, x["index"]))), go)

    return games.select("game", F.explode(F.aggregate("moves", start, step)["log"]).alias("l")).select("game", "l.*")


def move_report(b: Column) -> Column:
    """JSON text: the state in numbers and every legal move with the figures of the board after it."""
    def entry(m: Column, i: Column) -> Column:
        return let(bd.apply_move(b, m), lambda a: F.struct(i.alias("index"), bd.move_text(m).alias("move"), bd.progression(a).alias("progression_score"), bd.count_cards(a["foundations"]).alias("foundation_cards"), bd.face_down(a).alias("face_down_cards"), bd.is_won(a).alias("game_won")))

    state = F.struct(b["move_count"].alias("move_count"), b["score"].alias("score"), bd.count_cards(b["foundations"]).alias("foundation_cards"), bd.face_down(b).alias("face_down_cards"), bd.is_won(b).alias("game_won"))
    return F.to_json(F.struct(state.alias("current_state"), F.transform(bd.legal_moves(b), entry).alias("all_moves")))
