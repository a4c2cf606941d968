"""Search over boards as a level-by-level frontier of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import board as bd
from ..session import cut
from . import solver


def expand(frontier: DataFrame) -> DataFrame:
    """(game, board, path, ord, move): every legal move of every board applied."""
    f = frontier.select("game", "board", "path", "ord", F.posexplode(bd.legal_moves(F.col("board"))).alias("i", "move"))
    f = f.select("game", bd.apply_move(F.col("board"), F.col("move")).alias("board"), F.concat("path", F.array("move")).alias("path"), "ord", "i")
    return f.filter("board IS NOT NULL")


def beam(boards: DataFrame, depth: int, width: int) -> DataFrame:
    """(game, solved, explored, length, level): beam search of every board, one board a unit of work.

    Children are counted before duplicates go, up to the first win. A board that is won already is not reported as
    solved. A search holds the boards that it has reached (a byte a card), at most depth * width * branching of them.
    """
    return solver.beam_boards(boards, depth, width)


def best_sequences(boards: DataFrame, depth: int, keep: int, branch: int = 5, with_path: bool = False, dead_ends: bool = False) -> DataFrame:
    """(game, rank, score, moves): the best move sequences of exactly ``depth`` moves, or shorter when they win
    or, with ``dead_ends``, when no move is left.

    At most ``branch`` moves of a board are followed, by the priority of their kind when there are more.
    """
    prio = F.create_map(*[F.lit(x) for kv in {"tableau_to_foundation": 5, "waste_to_foundation": 5, "flip_tableau_card": 4, "tableau_to_tableau": 3, "waste_to_tableau": 2, "stock_to_waste": 1}.items() for x in kv])
    f = cut(boards.select("game", "board", F.array().cast(f"array<{bd.MOVE}>").alias("path"), F.array().cast("array<int>").alias("ord")))
    done = None
    for level in range(1, depth + 1):
        moves = F.transform(bd.legal_moves(F.col("board")), lambda m, i: F.struct((-prio[m["move_type"]]).alias("p"), i.alias("i"), m.alias("m")))
        follow = F.when(F.size(moves) > branch, F.slice(F.array_sort(moves), 1, branch)).otherwise(moves)
        f = f.select("game", "board", "path", "ord", F.posexplode(follow).alias("k", "x"))
        f = f.select("game", bd.apply_move(F.col("board"), F.col("x.m")).alias("board"), F.concat("path", F.array("x.m")).alias("path"), F.concat("ord", F.array("k")).alias("ord")).filter("board IS NOT NULL")
        f = cut(f.withColumn("won", bd.is_won(F.col("board"))))
        ends = f if level == depth else f.filter(F.col("won") | (F.size(bd.legal_moves(F.col("board"))) == 0) if dead_ends else F.col("won"))
        ends = ends.select("game", "path", "ord", bd.sequence_score(F.col("board"), F.size("path")).alias("score"))
        done = ends if done is None else done.unionByName(ends)
        f = f.filter("NOT won").drop("won")
    r = done.withColumn("rank", F.row_number().over(W.partitionBy("game").orderBy(F.desc("score"), "ord"))).filter(F.col("rank") <= keep)
    if with_path:
        return r.select("game", "rank", "score", "path")
    return r.select("game", "rank", "score", F.array_join(F.transform("path", bd.describe), "; ").alias("moves"))


def greedy_game(boards: DataFrame, steps: int) -> DataFrame:
    """(game, step, board): the first legal move made again and again, folded inside one row per game."""
    b = F.col("board")

    def step(s, _):
        return F.coalesce(bd.apply_move(s, F.get(bd.legal_moves(s), F.lit(0))), s)

    return boards.select("game", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), b, step).alias("board"))


def replay(games: DataFrame) -> DataFrame:
    """(game, board, applied, ok): recorded moves folded onto the starting board in order. From the first move that is
    not valid on, nothing is applied and ``ok`` is false, so a drifting record shows."""
    start = F.struct(F.col("board").alias("board"), F.lit(0).alias("applied"), F.lit(True).alias("ok"))

    def step(s, m):
        after = bd.apply_move(s["board"], m)
        good = s["ok"] & after.isNotNull()
        return F.struct(F.when(good, after).otherwise(s["board"]).alias("board"), F.when(good, s["applied"] + 1).otherwise(s["applied"]).alias("applied"), good.alias("ok"))

    return games.select("game", F.aggregate("moves", start, step).alias("r")).select("game", "r.board", "r.applied", "r.ok")
