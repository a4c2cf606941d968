"""Log documents assembled from rows and taken apart again: decision records, play logs, session logs, decks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import board as bd


def decision_record(decision: Column, meta: Column) -> tuple[Column, Column]:
    """(decision, thinkingText) of a harvested record: thinkingText is lifted out of the meta map, its other keys are
    merged into the decision map and win over equal keys there."""
    rest = F.map_filter(meta, lambda k, _: k != "thinkingText")
    kept = F.map_filter(decision, lambda k, _: ~F.map_contains_key(rest, k))
    return F.map_concat(kept, rest), F.try_element_at(meta, F.lit("thinkingText"))


def session_log(actions: DataFrame, session: str, order: str, fields: list[str]) -> DataFrame:
    """One document per session with its actions in order, as JSON text."""
    a = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return actions.groupBy(session).agg(F.to_json(F.struct(F.col(session).alias("session_id"), F.transform(a, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("actions"))).alias("doc"))


def play_log(doc: Column) -> Column:
    """STRUCT<enabled, move_count, moves> of a play log's JSON; a disabled log is a stub without moves."""
    v = F.from_json(doc, "enabled boolean, move_count int, moves array<struct<timestamp:double,move:string>>")
    on = F.coalesce(v["enabled"], F.lit(False))
    return F.struct(on.alias("enabled"), F.when(on, F.coalesce(v["move_count"], F.size(v["moves"]))).alias("move_count"), F.when(on, v["moves"]).alias("moves"))


def play_log_document(enabled: Column, metadata: Column, initial: Column, moves: Column, start_time: Column) -> Column:
    """A play log as JSON text; without logging or before the start it is a stub that says so."""
    on = F.coalesce(enabled, F.lit(False)) & initial.isNotNull()
    full = F.struct(F.lit(True).alias("enabled"), metadata.alias("metadata"), initial.alias("initial_state"), moves.alias("moves"), F.size(moves).alias("move_count"), start_time.alias("start_time"))
    stub = F.struct(F.lit(False).alias("enabled"), F.lit("Logging was not enabled or no game was recorded").alias("message"))
    return F.when(on, F.to_json(full)).otherwise(F.to_json(stub))


def board_from_json(doc: Column) -> Column:
    """A board from its JSON text: tableau cards are up unless they say otherwise, stock cards down, waste and foundation
    cards always up."""
    b = F.from_json(doc, bd.BOARD)
    side = lambda p, default, force: F.transform(F.coalesce(p, F.array().cast(f"array<{bd.CARD}>")), lambda c: bd.card(c["rank"], c["suit"], F.lit(True) if force else F.coalesce(c["face_up"], F.lit(default))))
    return F.struct(F.transform(b["tableau"], lambda p: side(p, True, False)).alias("tableau"), F.transform(b["foundations"], lambda p: side(p, True, True)).alias("foundations"), side(b["stock"], False, False).alias("stock"), side(b["waste"], True, True).alias("waste"), F.coalesce(b["move_count"], F.lit(0)).alias("move_count"), F.coalesce(b["score"], F.lit(0)).alias("score"))


def board_to_json(b: Column) -> Column:
    """JSON text of a board; foundations and waste leave out the side that is up."""
    plain = lambda p: F.transform(p, lambda c: F.struct(c["rank"].alias("rank"), c["suit"].alias("suit")))
    return F.to_json(F.struct(b["tableau"].alias("tableau"), F.transform(b["foundations"], plain).alias("foundations"), b["stock"].alias("stock"), plain(b["waste"]).alias("waste"), b["move_count"].alias("move_count"), b["score"].alias("score")))


def text_board(b: Column) -> Column:
    """Piles as lines of card codes, hidden cards in angle brackets, the stock first."""
    code = lambda c: F.when(c["face_up"], bd.card_code(c)).otherwise(F.concat(F.lit("<"), bd.card_code(c), F.lit(">")))
    return F.concat_ws("\n", F.concat(F.lit("Talon: "), F.array_join(F.transform(F.reverse(b["stock"]), bd.card_code), " ")), F.array_join(F.transform(b["tableau"], lambda p: F.array_join(F.transform(p, code), " ")), "\n"))


def board_signature(b: Column) -> Column:
    """A weaker key than equality: hidden cards count as ?, foundations by their top, stock and waste by their size."""
    cols = F.transform(b["tableau"], lambda p: F.array_join(F.transform(p, lambda c: F.when(c["face_up"], bd.card_code(c)).otherwise("?")), ""))
    return F.concat_ws("|", F.array_join(F.transform(b["foundations"], lambda f: F.coalesce(bd.card_code(bd.top(f)), F.lit("-"))), ""), F.array_join(cols, ","), F.size(b["stock"]).cast("string"), F.size(b["waste"]).cast("string"))


def position_signature(b: Column) -> Column:
    """Text of a position: open cards with rank and suit, ? for hidden ones, tops of the foundations, sizes of stock and
    waste. Equal for a repeated position."""
    name = lambda c: F.concat(c["rank"].cast("string"), c["suit"])
    cols = F.array_join(F.transform(b["tableau"], lambda p: F.array_join(F.transform(p, lambda c: F.when(c["face_up"], name(c)).otherwise("?")), ",")), "|")
    tops = F.array_join(F.transform(b["foundations"], lambda f: F.coalesce(name(bd.top(f)), F.lit("-"))), ",")
    return F.concat(F.lit("T["), cols, F.lit("]F["), tops, F.lit("]S"), F.size(b["stock"]).cast("string"), F.lit("W"), F.size(b["waste"]).cast("string"))


def cross_arms(states: DataFrame, arms: list[str], runs: int) -> DataFrame:
    """Every state in every arm and run: a small fixed product, exploded per row rather than joined."""
    return states.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms]))).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
