"""Game sessions as rows: legal actions, one action applied, whole action logs folded, and sessions as the state of a
stream of commands.

A session is STRUCT<board, draw_count, redeals>; its rules run as Column expressions. The stream keeps all sessions in one
table per batch in the shared folder: a batch joins its commands to the state of the batch before by session, folds
them in order, and writes the new state and the events under its own number, so a batch that runs twice writes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import board as bd
from ..functions.actions import let
from ..session import shared_place
from .decisions import ordinal

SESSION = f"struct<board:{bd.BOARD},draw_count:int,redeals:int>"
ACTION = f"struct<index:int,kind:string,description:string,move:{bd.MOVE}>"
LOG = "struct<seq:int,kind:string,description:string,score:int,move_count:int,won:boolean,stuck:boolean,ok:boolean>"
STEP_PRIORITY = {"tableau_to_foundation": 5, "waste_to_foundation": 5, "flip_tableau_card": 4, "tableau_to_tableau": 3, "waste_to_tableau": 2, "stock_to_waste": 1}


def session(board: Column, draw_count: Column) -> Column:
    return F.struct(board.alias("board"), draw_count.cast("int").alias("draw_count"), F.lit(0).alias("redeals"))


def legal_actions(board: Column, draw_count: Column) -> Column:
    """ARRAY<STRUCT<index, kind, description, move>>: the moves in their order, a draw of as many cards as are left, and the
    recycle when the stock is empty and the waste is not."""
    drawn = F.least(draw_count, F.size(board["stock"])).cast("string")
    none = F.lit(None).cast(bd.MOVE)
    of = lambda m: F.when(m["move_type"] == "stock_to_waste", F.struct(F.lit("draw").alias("kind"), F.concat(F.lit("Draw "), drawn, F.lit(" card(s) from stock")).alias("description"), m.alias("move"))).otherwise(F.struct(F.lit("move").alias("kind"), bd.move_text(m).alias("description"), m.alias("move")))
    turn = F.when((F.size(board["stock"]) == 0) & (F.size(board["waste"]) > 0), F.array(F.struct(F.lit("recycle").alias("kind"), F.lit("Recycle the waste pile back into the stock").alias("description"), none.alias("move")))).otherwise(F.array().cast(f"array<struct<kind:string,description:string,move:{bd.MOVE}>>"))
    every = F.concat(F.transform(bd.legal_moves(board), of), turn)
    return F.transform(every, lambda a, i: F.struct(i.cast("int").alias("index"), a["kind"].alias("kind"), a["description"].alias("description"), a["move"].alias("move")))


def is_stuck(board: Column) -> Column:
    """No legal action is left and the game is not won."""
    return ~bd.is_won(board) & (F.size(bd.legal_moves(board)) == 0) & ((F.size(board["stock"]) > 0) | (F.size(board["waste"]) == 0))


def after(s: Column, action: Column) -> Column:
    """The session after a legal action; null for a null action."""
    b = F.when(action["kind"] == "draw", bd.session_draw(s["board"], s["draw_count"])).when(action["kind"] == "recycle", bd.session_recycle(s["board"])).otherwise(bd.apply_move(s["board"], action["move"]))
    return let(b, lambda x: F.when(x.isNotNull(), F.struct(x.alias("board"), s["draw_count"].alias("draw_count"), (s["redeals"] + F.when(action["kind"] == "recycle", 1).otherwise(0)).alias("redeals"))))


def play(s: Column, indexes: Column) -> Column:
    """STRUCT<session, log>: actions given by index (or, where negative, by kind: -1 draw, -2 recycle) applied in order. An
    index beyond the list changes nothing and is logged with ok false."""
    start = F.struct(s.alias("session"), F.array().cast(f"array<{LOG}>").alias("log"))

    def step(z: Column, i: Column) -> Column:
        now = z["session"]

        def choose(acts: Column) -> Column:
            by_kind = lambda k: F.get(F.filter(acts, lambda a: a["kind"] == k), F.lit(0))
            a = F.when(i == -1, by_kind("draw")).when(i == -2, by_kind("recycle")).otherwise(F.get(acts, F.when(i >= 0, i)))
            return let(a, lambda a: let(after(now, a), lambda n: let(F.coalesce(n, now), lambda m: F.struct(m.alias("session"), F.concat(z["log"], F.array(entry(a, m, n.isNotNull(), F.size(z["log"])))).alias("log")))))

        return let(legal_actions(now["board"], now["draw_count"]), choose)

    def entry(a: Column, m: Column, ok: Column, seq: Column) -> Column:
        b = m["board"]
        return F.struct((seq + 1).alias("seq"), a["kind"].alias("kind"), a["description"].alias("description"), b["score"].alias("score"), b["move_count"].alias("move_count"), bd.is_won(b).alias("won"), is_stuck(b).alias("stuck"), ok.alias("ok"))

    return F.aggregate(indexes, start, step)


def session_document(seed: Column, s: Column, log: Column, initial: Column) -> Column:
    """The session log as JSON text: seed, draw_count, initial_state, actions and result."""
    b = s["board"]
    result = F.struct(bd.is_won(b).alias("won"), is_stuck(b).alias("stuck"), b["score"].alias("score"), b["move_count"].alias("move_count"), s["redeals"].alias("redeal_count"), F.size(log).alias("total_actions"))
    return F.to_json(F.struct(seed.alias("seed"), s["draw_count"].alias("draw_count"), initial.alias("initial_state"), log.alias("actions"), result.alias("result")))


def suggest(board: Column, draw_count: int = 1) -> Column:
    """STRUCT<index, reason>: the greedy strategy's first best move looked up among the legal actions; without one the
    recycle, else the first action, else nothing."""
    prio = F.create_map(*[F.lit(x) for kv in STEP_PRIORITY.items() for x in kv])
    say = lambda i, why: F.struct(i.cast("int").alias("index"), F.lit(why).alias("reason"))

    def pick(acts: Column) -> Column:
        ranked = F.array_sort(F.transform(F.filter(acts, lambda a: a["move"].isNotNull()), lambda a: F.struct((-prio[a["move"]["move_type"]]).alias("p"), a["index"].alias("i"))))
        recycle = F.get(F.filter(acts, lambda a: a["kind"] == "recycle"), F.lit(0))["index"]
        return F.when(F.size(acts) == 0, say(F.lit(None), "No legal moves; the game is over.")).when(F.size(ranked) > 0, say(F.get(ranked, F.lit(0))["i"], "Greedy strategy pick.")).when(recycle.isNotNull(), say(recycle, "Recycle the waste pile.")).otherwise(say(F.get(acts, F.lit(0))["index"], "Fallback to first legal move."))

    return let(legal_actions(board, F.lit(draw_count)), pick)


# ---------------------------------------------------------------- sessions as stream state
#: Commands: new_game (seed, draw_count), play_move (move_index) and end_session, in the order of seq.
COMMAND = "session_id string, seq bigint, command string, seed bigint, draw_count int, move_index int"
STATE = f"session_id string, seed bigint, session {SESSION}, open boolean"
EVENTS = "session_id string, seq bigint, event string, kind string, description string, score int, move_count int, result string, redeal_count int"


def _event(seq: Column, name, kind=None, description=None, score=None, moves=None, result=None, redeals=None) -> Column:
    text = lambda c: (F.lit(c) if c is None or isinstance(c, str) else c).cast("string")
    num = lambda c: (F.lit(None) if c is None else c).cast("int")
    return F.struct(seq.alias("seq"), text(name).alias("event"), text(kind).alias("kind"), text(description).alias("description"), num(score).alias("score"), num(moves).alias("move_count"), text(result).alias("result"), num(redeals).alias("redeal_count"))


def step_sessions(state: DataFrame, commands: DataFrame, may_open: DataFrame | None = None) -> DataFrame:
    """(session_id, seed, session, open, events): every session of the state or the commands after its commands.

    new_game opens a session that is not open and gives game_started; play_move gives move and, when it ends the game,
    game_ended; end_session closes and gives game_abandoned when the game was unfinished. A command for a session that
    is not open, a second new_game and an index beyond the list give an error event and change nothing. ``may_open`` has
    the session_ids that may be opened; others are refused.
    """
    c = commands.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "command", "seed", "draw_count", "move_index"))).alias("commands"))
    if may_open is not None:
        c = c.join(may_open.select("session_id", F.lit(True).alias("room")), "session_id", "left").withColumn("room", F.coalesce("room", F.lit(False)))
    else:
        c = c.withColumn("room", F.lit(True))
    j = state.join(c, "session_id", "full_outer")
    ev = "array<struct<seq:bigint,event:string,kind:string,description:string,score:int,move_count:int,result:string,redeal_count:int>>"
    start = F.struct(F.col("seed").alias("seed"), F.col("session").alias("session"), F.coalesce("open", F.lit(False)).alias("open"), F.array().cast(ev).alias("events"))
    room = F.coalesce("room", F.lit(False))

    def step(z: Column, x: Column) -> Column:
        def keep(*e: Column) -> Column:
            return F.struct(z["seed"].alias("seed"), z["session"].alias("session"), z["open"].alias("open"), F.concat(z["events"], F.array(*e)).alias("events"))

        def made(seed: Column, s: Column, is_open: Column, more: Column) -> Column:
            return F.struct(seed.alias("seed"), s.alias("session"), is_open.alias("open"), F.concat(z["events"], more).alias("events"))

        fresh = session(bd.deal(x["seed"]), F.coalesce(x["draw_count"], F.lit(1)))
        opened = made(x["seed"], fresh, F.lit(True), F.array(_event(x["seq"], "game_started")))
        b = z["session"]["board"]
        done = bd.is_won(b) | is_stuck(b)
        left = _event(x["seq"], "game_abandoned", score=b["score"], moves=b["move_count"])
        closed = made(z["seed"], z["session"], F.lit(False), F.when(done, F.array().cast(ev)).otherwise(F.array(left)))

        def moved(r: Column) -> Column:
            e = F.get(r["log"], F.lit(0))
            said = _event(x["seq"], "move", e["kind"], e["description"], e["score"], e["move_count"])
            over = _event(x["seq"], "game_ended", score=e["score"], moves=e["move_count"], result=F.when(e["won"], "won").otherwise("stuck"), redeals=r["session"]["redeals"])
            return F.when(~e["ok"], keep(_event(x["seq"], "error", description="invalid move index"))).otherwise(made(z["seed"], r["session"], z["open"], F.when(e["won"] | e["stuck"], F.array(said, over)).otherwise(F.array(said))))

        return (
            F.when((x["command"] == "new_game") & ~z["open"] & room, opened)
            .when(x["command"] == "new_game", keep(_event(x["seq"], "error", description=F.when(z["open"], "session is open").otherwise("registry full"))))
            .when(~z["open"], keep(_event(x["seq"], "error", description="unknown session")))
            .when(x["command"] == "end_session", closed)
            .when(x["command"] == "play_move", let(play(z["session"], F.array(F.coalesce(x["move_index"], F.lit(1_000_000)))), moved))
            .otherwise(keep(_event(x["seq"], "error", description="unknown command")))
        )

    folded = F.when(F.col("commands").isNull(), start).otherwise(F.aggregate(F.col("commands"), start, step))
    return j.select("session_id", folded.alias("z")).select("session_id", "z.seed", "z.session", "z.open", "z.events")


def run_sessions(commands: DataFrame, place: str | None = None, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(state, events) after a stream of commands is drained. At most ``cap`` sessions are open at a time: a batch opens as
    many as there is room for at its start, in the order of session_id; the others are refused."""
    spark: SparkSession = commands.sparkSession
    place = place or shared_place(spark, "sessions")
    last = {"n": -1}

    def batch(df: DataFrame, n: int) -> None:
        prior = spark.read.schema(STATE).parquet(f"{place}/state/{n - 1}") if n > 0 else spark.createDataFrame([], STATE)
        room = cap - prior.filter("open").count()
        new = df.filter("command = 'new_game'").select("session_id").distinct().join(prior.filter("open").select("session_id"), "session_id", "left_anti")
        out = f"{place}/step/{n}"
        first = ordinal(new, ["session_id"], F.substring("session_id", 1, 3), "__k").filter(F.col("__k") < max(0, room)).select("session_id")
        step_sessions(prior, df, first).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out)
        done.select("session_id", "seed", "session", "open").write.mode("overwrite").parquet(f"{place}/state/{n}")
        done.select("session_id", F.explode("events").alias("e")).select("session_id", "e.*").write.mode("overwrite").parquet(f"{place}/events/batch={n}")
        last["n"] = n

    q = commands.writeStream.foreachBatch(batch).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    if last["n"] < 0:
        return spark.createDataFrame([], STATE), spark.createDataFrame([], EVENTS)
    return spark.read.schema(STATE).parquet(f"{place}/state/{last['n']}"), spark.read.schema(EVENTS).parquet(*[f"{place}/events/batch={i}" for i in range(last["n"] + 1)])


def list_sessions(state: DataFrame) -> DataFrame:
    """A snapshot of the open sessions."""
    b = F.col("session.board")
    return state.filter("open").select("session_id", b["move_count"].alias("move_count"), b["score"].alias("score"), bd.is_won(b).alias("won"), is_stuck(b).alias("stuck"), F.col("session.draw_count").alias("draw_count"), "seed")
