"""What action a description names, however it is worded. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANK_WORDS = {"ace": "a", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "jack": "j", "queen": "q", "king": "k"}
SUIT_SIGNS = {"♥": "h", "♦": "d", "♣": "c", "♠": "s"}
_RANKS = "|".join(RANK_WORDS)
#: ``7 of hearts``, ``seven of hearts``, ``7H``, ``7♥``, ``TH``, ``10H`` in lower case.
CARD = rf"(?<![\p{{L}}\d])(?:({_RANKS}|10|[2-9atjqk]) of (heart|diamond|club|spade)s?|(10|[2-9atjqk])([hdcs♥♦♣♠]))(?![\p{{L}}\d])"
PLACE = r"(?:columns?|cols?|piles?|tableau)\s*#?\s*(\d+)"
DRAW = r"^(?:draw\b|take next stock|take (?:a|one|the next) card|deal from (?:the )?stock|stock\s*(?:→|->|=>|to)\s*waste)"
RECYCLE = r"recycle|waste (?:pile )?back (?:in)?to (?:the )?stock|turn the waste|waste\s*(?:→|->|=>|to)\s*stock|redeal"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a plain reuse of a Column repeats its work)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_description(c: Column) -> Column:
    """Lower case, single spaces, no outer space, no closing full stop or exclamation mark."""
    return F.rtrim(F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}\p{Cf}]+", " ")), F.lit(" .!"))


def _card(found: Column) -> Column:
    """``7 of hearts``, ``seven of hearts``, ``7h`` or ``7♥`` as ``7h``."""
    ranks = F.create_map(*[F.lit(x) for kv in {**RANK_WORDS, "t": "10"}.items() for x in kv])
    spelled = F.contains(found, F.lit(" of "))
    rank = F.when(spelled, F.substring_index(found, " of ", 1)).otherwise(F.expr("''"))
    suit = F.when(spelled, F.substring(F.substring_index(found, " of ", -1), 1, 1)).otherwise(F.translate(F.right(found, F.lit(1)), "".join(SUIT_SIGNS), "".join(SUIT_SIGNS.values())))
    rank = F.when(spelled, rank).otherwise(F.left(found, F.length(found) - 1))
    return let(rank, lambda r: F.concat(F.coalesce(F.try_element_at(ranks, r), r), suit))


def card_code(plain: Column) -> Column:
    """First card of a plain description as rank and suit letter (``10h``), '' when it names none."""
    return let(F.regexp_extract(plain, CARD, 0), lambda f: F.when(f == "", "").otherwise(_card(f)))


def _parts(p: Column, found: Column, places: Column) -> Column:
    waste = F.contains(p, F.lit("waste"))
    source = F.when(waste, F.lit("waste")).otherwise(F.get(places, F.lit(0)))
    target = F.when(F.contains(p, F.lit("foundation")), F.lit("foundation")).when(waste, F.get(places, F.lit(0))).otherwise(F.get(places, F.lit(1)))
    blank = F.lit(None).cast("string")
    make = lambda k, c, s, t: F.struct(F.lit(k).alias("kind"), c.alias("card"), s.alias("source"), t.alias("target"))
    return (
        F.when(p.isNull() | (p == ""), F.lit(None))
        .when((found != "") & source.isNotNull() & target.isNotNull(), make("move", _card(found), source, target))
        .when((found == "") & p.rlike(RECYCLE), make("recycle", blank, blank, blank))
        .when((found == "") & p.rlike(DRAW), make("draw", blank, blank, blank))
        .otherwise(make("other", p, blank, blank))
    )


def action_parts(description: Column) -> Column:
    """STRUCT<kind, card, source, target> of a description; null for null or blank.

    ``kind`` is draw, recycle, move or other. Other keeps the plain text in ``card``, so unknown wordings are equal
    only to themselves. ``source`` is a column number or ``waste``; ``target`` a column number or ``foundation``.
    """
    return let(
        plain_description(description),
        lambda p: let(F.regexp_extract(p, CARD, 0), lambda f: let(F.regexp_extract_all(p, F.lit(PLACE), F.lit(1)), lambda pl: _parts(p, f, pl))),
    )


def action_key(description: Column) -> Column:
    """One text per action; equal for two wordings of one action. Null for null or blank."""
    return let(action_parts(description), lambda a: F.when(a.isNotNull(), F.concat_ws(":", a["kind"], a["card"], a["source"], a["target"])))
