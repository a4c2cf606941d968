"""Move-choosing strategies as functions of boards to one chosen move each, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import board as bd
from ..functions.actions import let
from ..session import cut

PRIORITY = {"tableau_to_foundation": 5, "waste_to_foundation": 5, "flip_tableau_card": 4, "tableau_to_tableau": 3, "waste_to_tableau": 2, "stock_to_waste": 1}


@dataclass
class Config:
    """Options of a strategy."""

    know_face_down: bool = False
    depth: int = 3
    priorities: dict[str, int] = field(default_factory=lambda: dict(PRIORITY))
    weights: dict[str, float] = field(default_factory=dict)


Strategy = Callable[[DataFrame, Config], DataFrame]
_KNOWN: dict[str, Strategy] = {}


def register(name: str, strategy: Strategy) -> None:
    _KNOWN[name.casefold()] = strategy


def unregister(name: str) -> None:
    _KNOWN.pop(name.casefold(), None)


def get(name: str) -> Strategy | None:
    return _KNOWN.get(name.casefold())


def names() -> list[str]:
    return sorted(_KNOWN)


def _scored(boards: DataFrame, score) -> DataFrame:
    d = boards.select("game", "board", F.posexplode(bd.legal_moves(F.col("board"))).alias("i", "move"))
    d = d.withColumn("score", score(F.col("board"), F.col("move")))
    k = F.row_number().over(W.partitionBy("game").orderBy(F.desc("score"), "i"))
    return d.withColumn("k", k).filter("k = 1").select("game", F.col("i").alias("idx"), "move", "score")


def simple(boards: DataFrame, config: Config) -> DataFrame:
    """The first move of the highest priority."""
    p = F.create_map(*[F.lit(x) for kv in config.priorities.items() for x in kv])
    return _scored(boards, lambda b, m: p[m["move_type"]].cast("double"))


#: Weights of the weighted strategy: of the move's kind and of what the move brings.
WEIGHTS = {"tableau_to_foundation": 100.0, "waste_to_foundation": 100.0, "flip_tableau_card": 50.0, "waste_to_tableau": 30.0, "tableau_to_tableau": 20.0, "stock_to_waste": 5.0, "score_delta": 1.0, "reveals_card": 25.0, "foundation_progress": 10.0, "move_flexibility": 2.0}


def weighted(boards: DataFrame, config: Config) -> DataFrame:
    """Weighs a move by its kind, its score, a card it reveals, cards it brings to the foundations and, without knowledge
    of hidden cards, the replies it leaves. A move that cannot be made counts by kind and score alone. ``config.weights``
    overrides single weights."""
    w = {**WEIGHTS, **config.weights}
    kinds = F.create_map(*[F.lit(x) for k in WEIGHTS if k in PRIORITY for x in (k, w[k])])

    def score(b, m):
        def after(a):
            gain = F.when(bd.face_down(a) < bd.face_down(b), w["reveals_card"]).otherwise(0.0) + w["foundation_progress"] * (bd.count_cards(a["foundations"]) - bd.count_cards(b["foundations"]))
            return F.when(a.isNull(), 0.0).otherwise(gain + (0.0 if config.know_face_down else w["move_flexibility"] * F.size(bd.legal_moves(a))))

        return kinds[m["move_type"]] + w["score_delta"] * m["score_delta"] + let(bd.apply_move(b, m), after)

    return _scored(boards, score)


def lookahead(boards: DataFrame, config: Config) -> DataFrame:
    """The first move of the best sequence of up to ``depth`` moves; lines that end early for want of moves count too."""
    from .search import best_sequences

    best = best_sequences(boards, config.depth, 1, with_path=True, dead_ends=True)
    return best.select("game", F.lit(None).cast("int").alias("idx"), F.get("path", F.lit(0)).alias("move"), "score")


def model(boards: DataFrame, config: Config) -> DataFrame:
    """A language model's choice; without a client it is the simple one."""
    return simple(boards, config)


for _n, _s in {"simple": simple, "weighted": weighted, "lookahead": lookahead, "llm": model}.items():
    register(_n, _s)


def choose(boards: DataFrame, name: str, config: Config | None = None) -> DataFrame:
    """(game, idx, move, score) by the named strategy; an unknown name is an error."""
    s = get(name)
    if s is None:
        raise KeyError(name)
    return s(boards, config or Config())


def sequence(boards: DataFrame, name: str, length: int, config: Config | None = None) -> DataFrame:
    """(game, moves, board): the named strategy's move made ``length`` times over; a board without a move stays."""
    d = boards.select("game", "board", F.array().cast(f"array<{bd.MOVE}>").alias("moves"))
    for _ in range(length):
        pick = choose(d.select("game", "board"), name, config).select("game", "move")
        d = d.join(pick, "game", "left").select("game", bd.apply_move(F.col("board"), F.col("move")).alias("after"), "board", "moves", "move")
        d = cut(d.select("game", F.coalesce("after", "board").alias("board"), F.when(F.col("after").isNotNull(), F.concat("moves", F.array("move"))).otherwise(F.col("moves")).alias("moves")))
    return d
