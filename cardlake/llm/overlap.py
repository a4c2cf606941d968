"""Positions that stand in an evaluation split and in the training split, equal or nearly so.

A prompt is canonicalised by what it shows, not by how it says so: case, punctuation, white space, card and suit signs
are normalised, words are dropped, and what stays is the sequence of cards, hidden-card marks and numbers with the
places where piles and clauses end. The board read from that sequence (foundations, seven columns, waste, stock) is
hashed, and evaluation hashes are joined with training hashes. Labels, wording, typing slips, notes at the end and cut
endings do not reach the hash. Prompts that show no whole board are hashed as canonical text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import let
from ..session import cut

#: What stands for a pile without cards.
NONE = r"--|\([A-Za-z]+\)|<[A-Za-z]+>|\b(?i:null|none|nothing|empty)\b"
#: Cards; the second form leaves out the small words "as", "ad" and "ah".
CARD = r"(?<![A-Za-z0-9])(?:10|[2-9ATJQKatjqk])[HDCShdcs♥♦♣♠](?![A-Za-z0-9])"
CAPITAL_CARD = r"(?<![A-Za-z0-9])(?!a[sdh]|A[sdh])(?:10|[2-9ATJQKatjqk])[HDCShdcs♥♦♣♠](?![A-Za-z0-9])"
#: Content tokens: cards, marks of hidden cards, numbers that are no list numbers in brackets, and marks of nothing.
_TOKEN = r"(?=[0-9AaTtJjQqKk?*#xX(<nNeE-])(?:%s|(?<![A-Za-z0-9*#?])(?:\?\?|[xX][xX]|\*\*|##)(?![A-Za-z0-9*#?])|\d+(?![\d\])])|" + NONE + ")"
#: The four foundations in the order of their suits: suit initial (or a word that starts with it), then what lies there.
_PLACE = r"[a-z]*\"?\s*:\s*\"?([^\s\",}.;]*)[\",.;]*\s*\"?"
FOUNDATIONS = r"(?i)(?<![a-z])h" + _PLACE + "d" + _PLACE + "c" + _PLACE + r"s[a-z]*\"?\s*:\s*\"?([^\s\",}.;]*)"
_PILE = r"(?:\?\?|--|[2-9atjqk][hdcs])(?: (?:\?\?|--|[2-9atjqk][hdcs]))*"
#: Columns that are numbered 1 to 7, each with an optional count of hidden cards and an optional pile.
NUMBERED = "".join(rf"[|/ ]{i}(?:\|(\d+))?(?:\|({_PILE}))?(?=[|/ ]|$)" for i in range(1, 8))
#: Columns that come in order without a number: a count of hidden cards each and an optional pile.
UNNUMBERED = "".join(rf"/(\d+)(?:\|({_PILE}))?(?=[|/ ]|$)" for _ in range(7))
#: The waste's pile or nothing, then the stock's count.
REST = rf"(?:[|/ ]({_PILE}))?[|/](\d+)"


def _plain_cards(c: Column) -> Column:
    """Lower case, suits as letters, tens as t, hidden cards as ??; for short texts of tokens."""
    x = F.translate(F.lower(c), "♥♦♣♠", "hdcs")
    for suit in "hdcs":
        x = F.replace(x, F.lit(f"10{suit}"), F.lit(f"t{suit}"))
    for hidden in ("xx", "**", "##"):
        x = F.replace(x, F.lit(hidden), F.lit("??"))
    return x


def content_stream(text: Column) -> Column:
    """Cards, hidden marks, numbers and empty marks of a text in order. A token is led by a blank where only white space,
    commas or quotes stand before it, by ``/`` where a clause ends (full stop, semicolon, brace), else by ``|``.

    Where cards are written in capitals, the small words "as", "ad" and "ah" are no cards.
    """
    capitals = text.rlike(r"(?<![A-Za-z0-9])(?:(?:10|[2-9])[HDCS]|[TJQK][HDCS♥♦♣♠])(?![A-Za-z0-9])")
    x = F.when(capitals, F.regexp_replace(text, _TOKEN % CAPITAL_CARD, "\u0001$0\u0002")).otherwise(F.regexp_replace(text, _TOKEN % CARD, "\u0001$0\u0002"))
    x = F.regexp_replace(F.concat(F.lit("\u0002"), x), "\u0002[\\s\\p{Z}\\p{Cf},\"]*+\u0001", " ")
    x = F.regexp_replace(x, "\u0002[^\u0001;.{}\\]]*+\u0001", "|")
    x = F.regexp_replace(x, "\u0002[^\u0001]*+\u0001", "/")
    x = _plain_cards(F.substring_index(x, "\u0002", 1))
    return F.regexp_replace(x, r"\([a-z]+\)|<[a-z]+>|null|none|nothing|empty", "--")


def _rank(c: Column) -> Column:
    """Rank of a foundation's top card or its count of cards; 0 for anything else."""
    return F.when(c.rlike("^[2-9atjqk][hdcs]$"), F.instr(F.lit("a23456789tjqk"), F.substring(c, 1, 1)).cast("string")).when(c.rlike(r"^\d+$"), c).otherwise("0")


def _column(hidden: Column, pile: Column) -> Column:
    """One spelling of a column: a ?? for every hidden card, then the open cards."""
    return F.trim(F.concat(F.repeat(F.lit("?? "), F.coalesce(hidden.try_cast("int"), F.lit(0))), F.when(pile == "--", "").otherwise(pile)))


def board_of(p: Column) -> Column:
    """STRUCT<key, tail>: the board that a prompt shows as one key (foundations, seven columns, waste, stock) and the
    cards and numbers after it in order. ``key`` is null when no whole board stands there; a board needs its
    foundations, seven columns and the stock's count in this order, however they are named."""

    def read(found: Column) -> Column:
        rest = F.substr(p, F.position(found, p) + F.length(found))
        top = F.concat_ws(",", *[_rank(_plain_cards(F.regexp_extract(found, FOUNDATIONS, i))) for i in (1, 2, 3, 4)])
        return F.when(found != "", let(content_stream(rest), lambda s: let(top, lambda t: _whole(t, s))))

    def _whole(top: Column, s: Column) -> Column:
        def by(pattern: str) -> Column:
            whole = pattern + REST

            def made(m: Column) -> Column:
                parts = F.split(F.regexp_replace(m, whole, ",".join(f"${i}" for i in range(1, 17))), ",")

                def board(x: Column) -> Column:
                    cols = [_column(F.get(x, F.lit(2 * i)), F.get(x, F.lit(2 * i + 1))) for i in range(7)]
                    waste = F.get(x, F.lit(14))
                    # the waste joins the last column, so a misspelt word for an empty column cannot shift it
                    last = F.trim(F.concat_ws(" ", cols[6], F.when(waste == "--", "").otherwise(waste)))
                    key = F.concat_ws("|", top, F.concat_ws("/", *cols[:6], last), F.get(x, F.lit(15)))
                    tail = F.filter(F.split(F.substr(s, F.position(m, s) + F.length(m)), r"[ |/]"), lambda t: ~t.isin("", "--", "??"))
                    return F.struct(key.alias("key"), tail.alias("tail"))

                return F.when(m != "", let(parts, board))

            return let(F.regexp_extract(s, whole, 0), made)

        return F.coalesce(by(NUMBERED), by(UNNUMBERED))

    return let(F.regexp_extract(p, FOUNDATIONS, 0), read)


def positions(examples: DataFrame) -> DataFrame:
    """(exampleId, split, origin, seed, key, hash, tail): the canonical record of every prompt that is not blank.

    ``key`` is the board, or for a prompt without a whole board its letters and digits. ``tail`` has the cards and
    numbers of the recent and legal moves in order, without the numbers of lists. A seed of 0 is missing. Null prompts and
    splits and blank prompts give no row; of columns with the same name in another letter case none is read.
    """
    e = examples.select("exampleId", "split", "origin", F.when(F.col("seed") != 0, F.col("seed")).alias("seed"), "prompt").filter("prompt IS NOT NULL AND split IS NOT NULL")
    b = let(board_of(F.col("prompt")), lambda x: F.struct(
        F.coalesce(x["key"], F.concat(F.lit("text:"), F.lower(F.regexp_replace("prompt", r"[^\p{L}\p{N}]", "")))).alias("key"),
        F.coalesce(x["tail"], F.array().cast("array<string>")).alias("tail"),
    ))
    return e.withColumn("b", b).select("exampleId", "split", "origin", "seed", F.col("b.key").alias("key"), F.sha2("b.key", 256).alias("hash"), F.col("b.tail").alias("tail")).filter("key <> 'text:'")


def _agree(a: str, b: str) -> Column:
    """Equal keys, seeds that do not differ when both are known, and moves that agree as far as both prompts go (an ending
    may be cut, its last item broken off)."""
    n = F.least(F.size(f"{a}_tail"), F.size(f"{b}_tail")) - 1
    same = (F.col(f"{a}_key") == F.col(f"{b}_key")) & F.coalesce(F.col(f"{a}_seed") == F.col(f"{b}_seed"), F.lit(True))
    return same & ((n <= 0) | (F.slice(f"{a}_tail", F.lit(1), F.greatest(n, F.lit(0))) == F.slice(f"{b}_tail", F.lit(1), F.greatest(n, F.lit(0)))))


def cross_split_pairs(examples: DataFrame) -> DataFrame:
    """(exampleIdA, exampleIdB, evalId, split, origin) of one training and one evaluation example that show the same
    position. Joined on the hash, checked on the canonical record itself. Copies of one record are joined once and their
    ids listed afterwards, so a hot position costs its distinct records and its asked-for pairs. Split and origin are
    those of the evaluation example. An empty table gives an empty result."""
    ev, tr, matches = _classes(examples)
    e = matches.join(ev, "e_class").join(tr, "t_class")
    return e.select(F.least("e_id", "t_id").alias("exampleIdA"), F.greatest("e_id", "t_id").alias("exampleIdB"), F.col("e_id").alias("evalId"), F.col("e_split").alias("split"), F.col("e_origin").alias("origin"))


def _classes(examples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members of evaluation classes, members of training classes, matching classes). A class is one canonical record
    with its seed and moves; its id is a hash of these."""
    p = positions(examples)
    p = cut(p.withColumn("class", F.sha2(F.to_json(F.struct("key", F.coalesce(F.col("seed").cast("string"), F.lit("")).alias("seed"), "tail")), 256)))
    ev, tr = p.filter("split <> 'train'"), p.filter("split = 'train'")

    def distinct(d: DataFrame, x: str) -> DataFrame:
        return d.groupBy("class").agg(*[F.first(c).alias(f"{x}_{c}") for c in ("hash", "key", "seed", "tail")]).withColumnRenamed("class", f"{x}_class")

    de, dt = distinct(ev, "e"), distinct(tr, "t")
    matches = de.join(dt, (de["e_hash"] == dt["t_hash"]) & _agree("e", "t")).select("e_class", "t_class")
    members = lambda d, x: d.select(F.col("class").alias(f"{x}_class"), F.col("exampleId").alias(f"{x}_id"), F.col("split").alias(f"{x}_split"), F.col("origin").alias(f"{x}_origin"))
    return members(ev, "e"), members(tr, "t"), matches


def overlap_report(examples: DataFrame) -> DataFrame:
    """Per evaluation split and origin: examples, how many also stand in training, and the pairs. Counted by classes of
    equal records; no pair of examples is made."""
    ev, tr, matches = _classes(examples)
    size = tr.groupBy("t_class").agg(F.count("*").alias("n"))
    per = matches.join(size, "t_class").groupBy("e_class").agg(F.sum("n").alias("partners"))
    found = ev.join(per, "e_class").groupBy(F.col("e_split").alias("split"), F.col("e_origin").alias("origin")).agg(F.count("*").alias("overlapping"), F.sum("partners").alias("pairs"))
    every = examples.filter("split <> 'train'").groupBy("split", "origin").agg(F.count("*").alias("examples"))
    cond = every["split"].eqNullSafe(found["split"]) & every["origin"].eqNullSafe(found["origin"])
    return every.join(found, cond, "left").select(every["split"], every["origin"], "examples", F.coalesce("overlapping", F.lit(0)).alias("overlapping"), F.coalesce("pairs", F.lit(0)).alias("pairs"))
