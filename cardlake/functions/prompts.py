"""Prompts and model answers to values, and values to prompts, as Column expressions.

A parsed state is STRUCT<legal ARRAY<STRUCT<type, describe>>, recent ARRAY<STRING>>. Nothing here raises on broken text:
what cannot be read is null. Only the matching of nested braces needs Python, over Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .actions import let

MARKER = "CURRENT GAME (JSON):"
MOVES = "array<struct<type:string,describe:string>>"
STATE = f"struct<legal:{MOVES},recent:array<string>>"
BLOCK = r"(?s)\{(?:[^{}]|\{[^{}]*\})*\}"
RANKS = "A23456789TJQK"
TIER_RANK = {"foundation": 6, "reveal": 5, "waste_play": 4, "shuffle": 2, "draw": 1, "recycle": 1, "illegal": 0}


# ---------------------------------------------------------------- prompts to states


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def strict_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null otherwise (the plain parser stops at the first
    value's end and takes what follows)."""
    v = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))


def _after(text: Column, marker: str) -> Column:
    """What follows the first marker; null where it is missing."""
    at = F.position(F.lit(marker), text)
    return F.when(at > 0, F.substr(text, at + len(marker)))


@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    """The first {...} with balanced braces."""

    def one(t):
        if not isinstance(t, str) or (start := t.find("{")) < 0:
            return None
        depth = 0
        for i in range(start, len(t)):
            if t[i] == "{":
                depth += 1
            elif t[i] == "}":
                depth -= 1
                if depth == 0:
                    return t[start : i + 1]
        return None

    return texts.map(one)


def legacy_state(prompt: Column) -> Column:
    """State of a prompt with a JSON board: the balanced object behind the marker; null when it is no JSON."""
    blob = _first_object(_after(prompt, MARKER))
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json(blob)).startswith("OBJECT"), F.lit(False))
    v = F.from_json(blob, f"legalMoves {MOVES}, recentMoves array<string>")
    return F.when(ok, F.struct(F.coalesce(v["legalMoves"], _empty(MOVES)).alias("legal"), F.coalesce(v["recentMoves"], _empty("array<string>")).alias("recent")))


def _lines(block: Column, pattern: str, build) -> Column:
    """``build(line)`` of the lines of a block that begin with a pattern."""
    return F.transform(F.filter(F.split(block, "\n"), lambda x: x.rlike("^" + pattern)), build)


_LEGAL_LINE = r"\s*\[(\d+)\]\s+(\S+)\s+(.+)"


def _legal_of(block: Column) -> Column:
    move = lambda x: F.struct(F.regexp_extract(x, "^" + _LEGAL_LINE, 2).alias("type"), F.trim(F.regexp_extract(x, "^" + _LEGAL_LINE, 3)).alias("describe"))
    return _lines(block, _LEGAL_LINE, move)


def hybrid_state(prompt: Column) -> Column:
    """State of a prompt in text blocks; null without foundations or without a legal move."""
    legal = _legal_of(F.regexp_extract(prompt, r"LEGAL MOVES \(respond[^\n]*\):\s*\n((?:\s*\[\d+\][^\n]+\n?)+)", 1))
    block = F.regexp_extract(prompt, r"RECENT MOVES \(oldest -> newest[^\n]*\):\s*\n((?:\s*\d+\.\s+[^\n]+\n?)+)", 1)
    recent = _lines(block, r"\s*\d+\.\s+(.+)", lambda x: F.trim(F.regexp_extract(x, r"^\s*\d+\.\s+(.+)", 1)))
    return let(legal, lambda m: F.when(F.contains(prompt, F.lit("FOUNDATIONS:")) & (F.size(m) > 0), F.struct(m.alias("legal"), recent.alias("recent"))))


def state(prompt: Column) -> Column:
    """The JSON board where its marker stands, else the text blocks."""
    return F.when(F.contains(prompt, F.lit(MARKER)), legacy_state(prompt)).otherwise(hybrid_state(prompt))


def listed_moves(prompt: Column) -> Column:
    """Legal moves line by line behind the line that begins LEGAL MOVES (respond, up to a blank line or the next block. Such
    a state has neither a tableau nor recent moves."""
    body = F.regexp_extract(prompt, r"(?s)(?:^|\n)LEGAL MOVES \(respond[^\n]*\n(.*)", 1)
    ends = lambda x: (F.trim(x) == "") | x.rlike("^(?:PROGRESS|PRIOR REASONING|Now choose)")
    zero = F.struct(_empty(MOVES).alias("moves"), F.lit(False).alias("done"))
    move = lambda x: F.struct(F.regexp_extract(x, "^" + _LEGAL_LINE, 2).alias("type"), F.trim(F.regexp_extract(x, "^" + _LEGAL_LINE, 3)).alias("describe"))

    def step(a: Column, x: Column) -> Column:
        hit = ~a["done"] & x.rlike("^" + _LEGAL_LINE)
        return F.struct(F.when(hit, F.concat(a["moves"], F.array(move(x)))).otherwise(a["moves"]).alias("moves"), (a["done"] | (~hit & (F.size(a["moves"]) > 0) & ends(x))).alias("done"))

    return F.aggregate(F.split(body, "\n"), zero, step)["moves"]


def json_board(prompt: Column) -> Column:
    """Text of the JSON behind the marker, greedy to the last brace; null when it is no JSON."""
    blob = F.regexp_extract(prompt, r"(?s)CURRENT GAME \(JSON\):\s*(\{.*\})", 1)
    return F.when(strict_json(blob).isNotNull(), blob)


def legal_move_count(prompt: Column) -> Column:
    """Entries of the list behind "legalMoves":, brackets matched; null when there is none or it is no JSON."""
    found = F.regexp_extract(prompt, r'(?s)"legalMoves"\s*:.*?(\[.*)', 1)

    @F.pandas_udf(T.StringType())
    def balanced(texts: pd.Series) -> pd.Series:
        def one(t):
            depth = 0
            for i, c in enumerate(t or ""):
                depth += (c == "[") - (c == "]")
                if depth == 0:
                    return t[: i + 1] if c == "]" else None
            return None

        return texts.map(one)

    return F.json_array_length(F.get_json_object(F.concat(F.lit('{"a":'), balanced(found), F.lit("}")), "$.a"))


GAME = f"struct<foundations:map<string,string>,tableau:array<struct<faceDownCount:int>>,legalMoves:{MOVES},completion:int>"


def text_game(prompt: Column) -> Column:
    """Board of a prompt in text blocks from its first FOUNDATIONS: on; null when no block says anything."""
    at = F.position(F.lit("FOUNDATIONS:"), prompt)
    body = F.substr(prompt, at)
    end = r"(?=\n[A-Z][A-Z ]+(?::|\b)|\z)"

    def read(b: Column) -> Column:
        line = F.substring_index(b, "\n", 1)
        pair = r"\b([HDCS]):\s*(--|[AKQJT2-9][HDCS])"
        tops = F.filter(F.arrays_zip(F.regexp_extract_all(line, F.lit(pair), F.lit(1)).alias("s"), F.regexp_extract_all(line, F.lit(pair), F.lit(2)).alias("c")), lambda x: x["c"] != "--")
        # of a suit named twice the last card counts
        last = F.aggregate(tops, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["s"]), F.create_map(x["s"], x["c"])))
        tab = F.regexp_extract_all(F.regexp_extract(b, r"(?s)TABLEAU:\s*\n(.+?)" + end, 1), F.lit(r"(?dm)^\s*col\d+:\s*(.*)$"), F.lit(1))
        tab = F.transform(tab, lambda x: F.struct(((F.length(x) - F.length(F.replace(x, F.lit("??"), F.lit("")))) / 2).cast("int").alias("faceDownCount")))
        legal = _legal_of(F.regexp_extract(b, r"(?s)LEGAL MOVES[^\n]*:\s*\n(.+?)" + end, 1))
        done = F.regexp_extract(b, r"PROGRESS:\s*foundation=(\d+)/52,\s*face-down remaining=(\d+),\s*completion=(\d+)%", 3).try_cast("int")
        return let(F.struct(last.alias("foundations"), tab.alias("tableau"), legal.alias("legalMoves"), done.alias("completion")), lambda g: F.when((F.size(g["foundations"]) > 0) | (F.size(g["tableau"]) > 0) | (F.size(g["legalMoves"]) > 0) | g["completion"].isNotNull(), g))

    return F.when(at > 0, let(body, read))


def game(prompt: Column) -> Column:
    """Board of a prompt as GAME: the JSON behind the marker up to "Now choose"; where that is no JSON, the text blocks."""
    rest = _after(prompt, MARKER)
    blob = F.trim(F.regexp_replace(F.substring_index(rest, "Now choose", 1), r"^\s+|\s+$", ""))
    v = F.from_json(blob, f"foundations map<string,string>, tableau array<struct<faceDownCount:int>>, legalMoves {MOVES}, metrics struct<completionProgress:int>")
    full = F.struct(F.coalesce(v["foundations"], F.create_map().cast("map<string,string>")).alias("foundations"), F.coalesce(v["tableau"], _empty("array<struct<faceDownCount:int>>")).alias("tableau"), F.coalesce(v["legalMoves"], _empty(MOVES)).alias("legalMoves"), v["metrics"]["completionProgress"].alias("completion"))
    return F.when(strict_json(blob).isNotNull(), full).otherwise(text_game(prompt))


def progress_components(g: Column) -> Column:
    """STRUCT<fc, fd>: ranks on the foundations and hidden cards. fc is null when a value begins with no rank letter (10 is
    written T); empty values count nothing. Both are null without a board."""
    values = F.filter(F.map_values(g["foundations"]), lambda v: F.coalesce(~v.isin("", "0"), F.lit(False)))
    fc = F.aggregate(values, F.lit(0), lambda a, v: a + F.nullif(F.instr(F.lit(RANKS), F.substring(v, 1, 1)), F.lit(0)))
    fd = F.aggregate(g["tableau"], F.lit(0), lambda a, c: a + F.coalesce(c["faceDownCount"], F.lit(0)))
    return F.when(g.isNotNull(), F.struct(fc.alias("fc"), fd.alias("fd")))


def board(prompt: Column) -> Column:
    """STRUCT<foundations, tableau ARRAY<STRUCT<faceUp, faceDownCount>>, discardTop, drawPileCount, canRecycleStock,
    legalMoves> of a prompt of either layout; null when it shows no board."""
    cards = lambda x: F.regexp_extract_all(x, F.lit(r"(?:10|[AKQJT2-9])[HDCS♥♦♣♠]"), F.lit(0))
    blob = json_board(prompt)
    v = F.from_json(blob, f"foundations map<string,string>, tableau array<struct<faceUp:string,faceDownCount:int>>, discardTop string, waste string, drawPileCount int, stock int, canRecycleStock boolean, legalMoves {MOVES}")
    from_json = F.struct(
        v["foundations"].alias("foundations"), F.transform(v["tableau"], lambda c: F.struct(cards(c["faceUp"]).alias("faceUp"), F.coalesce(c["faceDownCount"], F.lit(0)).alias("faceDownCount"))).alias("tableau"),
        F.coalesce(v["discardTop"], v["waste"]).alias("discardTop"), F.coalesce(v["drawPileCount"], v["stock"]).alias("drawPileCount"), v["canRecycleStock"].alias("canRecycleStock"), F.coalesce(v["legalMoves"], _empty(MOVES)).alias("legalMoves"),
    )

    def from_text(g: Column) -> Column:
        body = _after(prompt, "FOUNDATIONS:")
        cols = F.regexp_extract_all(body, F.lit(r"(?dm)^ *col\d+: ?(.*)$"), F.lit(1))
        waste = F.regexp_extract(body, rf"WASTE(?: top)?: *((?:10|[{RANKS}])[HDCS♥♦♣♠])", 1)
        return F.struct(
            g["foundations"].alias("foundations"), F.transform(cols, lambda x: F.struct(cards(x).alias("faceUp"), ((F.length(x) - F.length(F.replace(x, F.lit("??"), F.lit("")))) / 2).cast("int").alias("faceDownCount"))).alias("tableau"),
            F.nullif(waste, F.lit("")).alias("discardTop"), F.regexp_extract(body, r"STOCK: *(\d+)", 1).try_cast("int").alias("drawPileCount"), F.when(body.rlike("recycle stock: *(?:yes|no)"), body.rlike("recycle stock: *yes")).alias("canRecycleStock"), g["legalMoves"].alias("legalMoves"),
        )

    return let(blob, lambda b: F.when(b.isNotNull(), from_json).otherwise(let(text_game(prompt), lambda g: F.when(g.isNotNull(), from_text(g)))))


def board_key(prompt: Column) -> Column:
    """Text that is equal for equal observable boards, history left out; null without a board."""
    return let(board(prompt), lambda b: F.when(b.isNotNull(), F.to_json(F.struct(F.array_sort(F.map_entries(b["foundations"])).alias("f"), b["tableau"].alias("t"), b["discardTop"].alias("w"), b["drawPileCount"].alias("s"), b["canRecycleStock"].alias("r")))))


def state_hash(prompt: Column) -> Column:
    """First 12 hexadecimal digits of the hash of a board with the texts of its legal moves."""
    return let(board(prompt), lambda b: F.when(b.isNotNull(), F.substring(F.sha2(F.to_json(F.struct(F.array_sort(F.map_entries(b["foundations"])).alias("f"), F.transform(b["legalMoves"], lambda m: m["describe"]).alias("lm"), b["drawPileCount"].alias("s"), b["tableau"].alias("t"), b["discardTop"].alias("w"))), 256), 1, 12)))


# ---------------------------------------------------------------- answers to decisions


def _objects(text: Column) -> Column:
    """The parseable objects of a text in order, as variants."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), lambda x: F.try_parse_json(x)), lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def _int(v: Column, path: str) -> Column:
    """A JSON integer at a path; texts, fractions and other values are none."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "BIGINT", F.try_variant_get(v, path, "bigint")).cast("int")


NESTED, FLAT = "$.final_decision.move_index", "$.move_index"


def move_index(text: Column, paths: tuple[str, ...] = (NESTED, FLAT)) -> Column:
    """Index of the last object that has one; within an object the first of ``paths`` counts."""
    return F.try_element_at(F.filter(F.transform(_objects(text), lambda v: F.coalesce(*[_int(v, p) for p in paths])), lambda i: i.isNotNull()), F.lit(-1))


def move_index_flat_first(text: Column) -> Column:
    return move_index(text, (FLAT, NESTED))


def _number(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, path, "double"))


def move_and_confidence(text: Column) -> Column:
    """STRUCT<idx, confidence, ok> of the last object with an index; the confidence stands beside the index."""

    def one(v: Column) -> Column:
        nested, flat = _int(v, NESTED), _int(v, FLAT)
        return F.when(nested.isNotNull(), F.struct(nested.alias("idx"), _number(v, "$.final_decision.confidence").alias("confidence"), F.lit(True).alias("ok"))).when(flat.isNotNull(), F.struct(flat.alias("idx"), _number(v, "$.confidence").alias("confidence"), F.lit(True).alias("ok")))

    none = F.struct(F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("ok"))
    return F.coalesce(F.try_element_at(F.filter(F.transform(_objects(text), one), lambda s: s.isNotNull()), F.lit(-1)), none)


def repaired_quotes(text: Column) -> Column:
    """Unescaped double quotes inside one-line JSON string values escaped."""

    def line(x: Column) -> Column:
        pattern = r'^(\s*"[A-Za-z_]+"\s*:\s*")(.*)(",?\s*)$'
        body = F.regexp_extract(x, pattern, 2)
        fixed = F.replace(F.replace(F.replace(body, F.lit('\\"'), F.lit("\u0000")), F.lit('"'), F.lit('\\"')), F.lit("\u0000"), F.lit('\\"'))
        return F.when(x.rlike(pattern) & F.contains(body, F.lit('"')), F.concat(F.regexp_extract(x, pattern, 1), fixed, F.regexp_extract(x, pattern, 3))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\r\n|\r|\n"), line), "\n")


def decision(text: Column) -> Column:
    """STRUCT<idx, confidence, board_analysis, strategic_plan, ok, via> in three tiers: the last object with a final
    decision as it stands (strict), the same with inner quotes repaired (repair), the last "move_index": n anywhere
    (field). A negative index is a resignation and counts at every tier."""

    def tier(t: Column, via: str) -> Column:
        plan = lambda v: F.coalesce(F.nullif(F.try_variant_get(v, "$.strategic_plan", "string"), F.lit("")), F.try_variant_get(v, "$.strategicPlan", "string"))
        one = lambda v: F.when(_int(v, NESTED).isNotNull(), F.struct(_int(v, NESTED).alias("idx"), _number(v, "$.final_decision.confidence").alias("confidence"), F.try_variant_get(v, "$.board_analysis", "string").alias("board_analysis"), plan(v).alias("strategic_plan"), F.lit(True).alias("ok"), F.lit(via).alias("via")))
        return F.try_element_at(F.filter(F.transform(_objects(t), one), lambda s: s.isNotNull()), F.lit(-1))

    s = lambda idx, ok, via: F.struct(idx.alias("idx"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("board_analysis"), F.lit(None).cast("string").alias("strategic_plan"), F.lit(ok).alias("ok"), F.lit(via).cast("string").alias("via"))
    loose = F.try_element_at(F.regexp_extract_all(text, F.lit(r'"move_index"\s*:\s*(-?\d+)'), F.lit(1)), F.lit(-1)).try_cast("int")
    return F.coalesce(tier(text, "strict"), tier(repaired_quotes(text), "repair"), let(loose, lambda i: F.when(i.isNotNull(), s(i, True, "field"))), s(F.lit(None).cast("int"), False, None))


def fenced_move_index(text: Column) -> Column:
    """Index of the widest {...} of a text without its code fence, flat key first; texts of digits count."""
    t = F.trim(text)
    t = F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")).otherwise(t)
    v = strict_json(F.regexp_extract(t, r"(?s)\{.*\}", 0))
    digits = lambda p: F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.regexp_extract(F.try_variant_get(v, p, "string"), r"^\d+$", 0)).try_cast("int")
    return F.coalesce(_int(v, FLAT), digits(FLAT), _int(v, NESTED), digits(NESTED))


def evaluated(text: Column) -> Column:
    """STRUCT<idx, ok>: index of the final decision of a whole text or of its widest {...}; ok when the object has the
    three keys of a full answer."""
    v = F.coalesce(strict_json(text), strict_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    return F.struct(_int(v, NESTED).alias("idx"), F.coalesce(has("board_analysis") & has("strategic_plan") & has("final_decision"), F.lit(False)).alias("ok"))


def response_prose(raw: Column, decision_json: Column) -> Column:
    """STRUCT<analysis, plan>: both from the raw answer, else both from the parsed decision under its several names."""
    full = lambda v, *keys: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys])
    r, d = strict_json(raw), strict_json(decision_json)
    pair = lambda a, p: F.when(a.isNotNull() & p.isNotNull(), F.struct(a.alias("analysis"), p.alias("plan")))
    return F.coalesce(pair(full(r, "board_analysis"), full(r, "strategic_plan")), pair(full(d, "boardAnalysis", "board_analysis"), full(d, "reasoning", "strategic_plan", "strategicPlan")))


def response_text(idx: Column, analysis: Column, plan: Column) -> Column:
    return F.to_json(F.struct(analysis.alias("board_analysis"), plan.alias("strategic_plan"), F.struct(idx.alias("move_index")).alias("final_decision")))


# ---------------------------------------------------------------- moves


def _latest(recent: Column, anchored: bool) -> Column:
    """ARRAY<from, to> of the latest column-to-column entry, empty when there is none."""
    move = ("^" if anchored else "") + r"(?i)move\s+[A-Z0-9]{2}\s+col\s+(\d+)\s+->\s+col\s+(\d+)"
    last = F.try_element_at(F.filter(recent, lambda x: (F.trim(x) if anchored else x).rlike(move)), F.lit(-1))
    last = F.trim(last) if anchored else last
    return F.array(F.regexp_extract(last, move, 1), F.regexp_extract(last, move, 2))


def _undoes(describe: Column, latest: Column, bare: bool) -> Column:
    d = F.lower(F.coalesce(describe, F.lit("")))
    a, b = F.get(latest, F.lit(0)), F.get(latest, F.lit(1))
    says = lambda head, mid: F.contains(d, F.concat(F.lit(head), b, F.lit(mid), a))
    out = says("from column ", " to column ") | says("col ", " to col ")
    return F.coalesce(out | says("column ", " to column ") if bare else out, F.lit(False))


def is_reversal(st: Column, idx: Column, typed: bool = True, anchored: bool = False, bare: bool = True) -> Column:
    """Whether a chosen move takes the latest column-to-column move back. ``typed``: only moves of type
    tableau_to_tableau; ``anchored``: the entry must begin with the move; ``bare``: "column b to column a" counts too."""
    m = F.get(st["legal"], F.when(idx >= 0, idx))
    ok = F.coalesce(m["type"].startswith("tableau_to_tableau"), F.lit(False)) if typed else F.lit(True)
    return F.coalesce(m.isNotNull() & ok & _undoes(m["describe"], _latest(st["recent"], anchored), bare), F.lit(False))


def looks_like_oscillation(st: Column) -> Column:
    """Whether the latest column-to-column move could be taken back."""
    both = F.struct(_latest(st["recent"], True).alias("latest"), st["legal"].alias("legal"))
    return let(both, lambda z: F.coalesce(F.exists(z["legal"], lambda m: _undoes(m["describe"], z["latest"], False)), F.lit(False)))


def classify_pick(legal: Column, idx: Column, tableau: Column) -> Column:
    """Tier of a chosen move. ``tableau``: ARRAY<STRUCT<column, faceDownCount, faceUp ARRAY>>. A move between columns
    reveals when it takes all open cards off hidden ones; a state without its tableau can tell no reveal."""
    m = F.get(legal, F.when(idx >= 0, idx))

    def tier(m: Column) -> Column:
        t, d = F.coalesce(m["type"], F.lit("")), F.coalesce(m["describe"], F.lit(""))
        src = F.regexp_extract(d, r"from column (\d+) to column (\d+)", 1).try_cast("int")
        n = F.coalesce(F.regexp_extract(d, r"plus (\d+) more", 1).try_cast("int") + 1, F.lit(1))
        col = F.get(F.filter(tableau, lambda c: c["column"] == src), F.lit(0))
        reveals = F.coalesce((F.coalesce(col["faceDownCount"], F.lit(0)) > 0) & (n >= F.size(F.coalesce(col["faceUp"], _empty("array<string>")))), F.lit(False))
        return (
            F.when(m.isNull(), "illegal").when(F.contains(t, F.lit("foundation")), "foundation").when(t == "draw_card", "draw").when(F.contains(t, F.lit("recycle")), "recycle")
            .when(t == "discard_to_tableau", "waste_play").when((t == "tableau_to_tableau") & src.isNotNull() & reveals, "reveal").otherwise("shuffle")
        )

    return let(m, tier)


def tier_rank(tier: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TIER_RANK.items() for x in kv]), tier)


def is_quality(tier: Column) -> Column:
    return tier.isin("foundation", "reveal", "waste_play")


def move_kind(legal: Column, completion: Column) -> Column:
    """What a completion's move does: resign, foundation, draw, recycle, tableau, or ? when it names no listed move."""
    v = strict_json(completion)
    i = _int(v, NESTED)
    d = F.lower(F.get(legal, F.when(i >= 0, i))["describe"])
    return F.when(i == -1, "resign").when(i.isNull() | d.isNull(), "?").when(F.contains(d, F.lit("foundation")), "foundation").when(F.contains(d, F.lit("draw")), "draw").when(F.contains(d, F.lit("recycle")), "recycle").otherwise("tableau")


def preference_moves(st: Column) -> Column:
    """STRUCT<chosen, rejected>: the first foundation move, else the first revealing one, against a plain move between
    columns, a reversal first; null when either is missing."""
    tagged = F.transform(st["legal"], lambda m, i: F.struct(i.alias("i"), F.lower(F.coalesce(m["describe"], F.lit(""))).alias("d"), F.lower(F.coalesce(m["type"], F.lit(""))).alias("t")))
    found = lambda x: F.contains(x["d"], F.lit("foundation")) | F.contains(x["t"], F.lit("foundation"))
    reveal = lambda x: ~found(x) & F.contains(x["d"], F.lit("reveals a hidden card"))

    def pick(z: Column) -> Column:
        t, s = z["t"], z["s"]
        first = lambda cond: F.get(F.filter(t, cond), F.lit(0))["i"]
        plain = lambda x: ~found(x) & ~reveal(x) & (x["t"] == "tableau_to_tableau")
        back = F.get(F.filter(t, lambda x: plain(x) & is_reversal(s, x["i"])), F.lit(0))["i"]
        chosen, rejected = F.coalesce(first(found), first(reveal)), F.coalesce(back, first(plain))
        return F.when(chosen.isNotNull() & rejected.isNotNull(), F.struct(chosen.alias("chosen"), rejected.alias("rejected")))

    return let(F.struct(tagged.alias("t"), st.alias("s")), pick)


# ---------------------------------------------------------------- buckets of positions


def bench_bucket(st: Column, hidden: Column) -> Column:
    """Nothing to choose gives null; then oscillation, endgame, early, midgame; hidden counts between give null."""
    h = F.coalesce(hidden, F.lit(0))
    return F.when(F.size(st["legal"]) < 2, None).when(looks_like_oscillation(st), "oscillation").when(h <= 4, "endgame").when(h >= 18, "early").when(h.between(10, 15), "midgame")


def has_min_history(st: Column, least: int = 3) -> Column:
    return F.size(st["recent"]) >= least


def prompt_state(prompt: Column) -> Column:
    """STRUCT<fd, prog, n_recent, stall_ratio, reversal, has_foundation> of a prompt in text blocks; null without the
    progress line. A reversal is a swap among the last eight that takes an earlier one of them back."""
    body = F.regexp_extract(prompt, r"RECENT MOVES \(oldest[^\n]*\n((?:\s+\d+\.[^\n]+\n)+)", 1)
    fd, prog = F.regexp_extract(prompt, r"face-down remaining=(\d+)", 1).try_cast("int"), F.regexp_extract(prompt, r"completion=(\d+)%", 1).try_cast("int")

    def build(b: Column) -> Column:
        lines = F.filter(F.split(b, "\n"), lambda x: F.trim(x) != "")
        idle = F.size(F.filter(lines, lambda x: x.rlike(r"(?i)^\s*\d+\.\s*(?:draw|recycle)\b")))
        pat = r"(?i)col\s+(\d+)\s*->\s*col\s+(\d+)"
        swaps = F.arrays_zip(F.regexp_extract_all(b, F.lit(pat), F.lit(1)), F.regexp_extract_all(b, F.lit(pat), F.lit(2)))
        last = F.slice(swaps, F.greatest(F.lit(1), F.size(swaps) - 7), F.lit(8))
        back = lambda s: F.exists(F.transform(s, lambda x, i: F.exists(F.slice(s, F.lit(1), i), lambda y: (y["0"] == x["1"]) & (y["1"] == x["0"]))), lambda z: z)
        n = F.size(lines)
        return F.struct(fd.alias("fd"), prog.alias("prog"), n.alias("n_recent"), F.when(n > 0, idle / n).otherwise(0.0).alias("stall_ratio"), F.when(F.size(swaps) > 0, let(last, back)).otherwise(False).alias("reversal"), (F.contains(prompt, F.lit("tableau_to_foundation")) | F.contains(prompt, F.lit("discard_to_foundation"))).alias("has_foundation"))

    return F.when(fd.isNotNull() & prog.isNotNull(), let(body, build))


def spaced_bucket(s: Column) -> Column:
    """Bucket of a ``prompt_state``: idle or swinging play is oscillation, then early, midgame and endgame."""
    swing = ((s["n_recent"] >= 6) & (s["stall_ratio"] >= 0.7)) | s["reversal"]
    return F.when(s.isNull(), None).when(swing, "oscillation").when(s["fd"] >= 18, "early").when(s["fd"] >= 10, "midgame").otherwise("endgame")


# ---------------------------------------------------------------- values to prompts


def without_prior_reasons(prompt: Column) -> Column:
    """The entries of PRIOR REASONING without their multi-line why."""
    whole = r"(?s)(PRIOR REASONING[^\n]*\n)(.*?)(\nNow choose|\z)"
    found = F.regexp_extract(prompt, whole, 0)

    def cut(f: Column) -> Column:
        head, body, tail = (F.regexp_extract(f, whole, i) for i in (1, 2, 3))
        short = F.regexp_replace(body, r"(?s)\n     why:.*?(?=(?:\n  \d+\. move:)|\z)", "")
        return F.when(f == "", prompt).otherwise(F.replace(prompt, f, F.concat(head, short, tail)))

    return let(found, cut)


def hybrid_text(b: Column) -> Column:
    """Text blocks of a board STRUCT<foundations MAP, tableau ARRAY<STRUCT<column, faceDownCount, faceUp ARRAY>>,
    discardTop, drawPileCount, canRecycleStock, recent ARRAY, seen ARRAY, legal ARRAY<STRUCT<type, describe>>, fc, fd,
    completion>."""
    tops = F.concat_ws("   ", *[F.concat(F.lit(f"{s[0].upper()}: "), F.coalesce(F.nullif(F.try_element_at(b["foundations"], F.lit(s)), F.lit("")), F.lit("--"))) for s in ("hearts", "diamonds", "clubs", "spades")])
    cols = F.array_join(F.transform(b["tableau"], lambda c: F.concat(F.lit("  col"), c["column"].cast("string"), F.lit(": "), tableau_cells(c))), "\n")
    numbered = F.array_join(F.transform(b["recent"], lambda x, i: F.concat(F.lit("  "), F.lpad((i + 1).cast("string"), 2, " "), F.lit(". "), x)), "\n")
    legal = F.array_join(F.transform(b["legal"], lambda m, i: F.concat(F.lit("  ["), i.cast("string"), F.lit("] "), padded(F.coalesce(m["type"], F.lit("")), 24), F.lit(" "), F.coalesce(m["describe"], F.lit("")))), "\n")
    parts = [
        F.lit("NOTATION: rank+suit (A 2-9 T J Q K; H D C S). ?? = face-down. In each column the top of the stack is the rightmost card."), F.lit(""),
        F.concat(F.lit("FOUNDATIONS: "), tops),
        F.concat(F.lit("STOCK: "), F.coalesce(b["drawPileCount"], F.lit(0)).cast("string"), F.lit(" cards   WASTE top: "), F.coalesce(F.nullif(b["discardTop"], F.lit("")), F.lit("--")), F.lit("   recycle stock: "), F.when(F.coalesce(b["canRecycleStock"], F.lit(False)), "yes").otherwise("no")), F.lit(""),
        F.lit("TABLEAU:"), cols, F.lit(""),
        F.when(F.size(b["recent"]) > 0, F.concat(F.lit("RECENT MOVES (oldest -> newest; review before picking, do not undo your own work):\n"), numbered, F.lit("\n"))),
        F.when(F.size(b["seen"]) > 0, F.concat(F.lit("SEEN IN WASTE THIS CYCLE: "), F.array_join(b["seen"], " "), F.lit("\n"))),
        F.lit("LEGAL MOVES (respond with the index of your chosen move):"), F.when(F.size(b["legal"]) > 0, legal), F.lit(""),
        F.concat(F.lit("PROGRESS: foundation="), b["fc"].cast("string"), F.lit("/52, face-down remaining="), b["fd"].cast("string"), F.lit(", completion="), b["completion"].cast("string"), F.lit("%")),
    ]
    return F.concat_ws("\n", *parts)


def padded(c: Column, width: int) -> Column:
    """Filled with blanks up to a width, never cut."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(c))))


def tableau_cells(c: Column) -> Column:
    """Cells of one column: ?? for hidden cards, then the open ones; <empty> when there are none."""
    cells = F.concat(F.array_repeat(F.lit("??"), F.coalesce(c["faceDownCount"], F.lit(0))), F.coalesce(c["faceUp"], _empty("array<string>")))
    return F.when(F.size(cells) == 0, "<empty>").otherwise(F.array_join(cells, " "))


#: Fixed value: the response format section of a prompt.
RESPONSE = r"(?s)RESPONSE FORMAT:\s*\n.*?Produce the keys in the order above:.*?then decide\."


def render_arm(name: str, prompt: Column, short_format: str = "", preamble: str = "") -> Column:
    """A prompt in one of the arms: C0 as it is; A1 without the JSON board's reasoningTrail; A2 with another response
    format; A3 both; A4 with the board's notation moved before the rules. Fails where the section to change is missing."""
    missing = lambda what: F.raise_error(F.lit(f"{what} not found"))

    def without_key(p: Column, key: str) -> Column:
        string = rf'(?s)(CURRENT GAME \(JSON\):.*?)(?:, *"{key}": *(?:"(?:[^"\\]|\\.)*"|\[[^\]]*\])|"{key}": *(?:"(?:[^"\\]|\\.)*"|\[[^\]]*\]), *)'
        return F.regexp_replace(p, string, "$1")

    def a2(p: Column) -> Column:
        found = F.regexp_extract(p, RESPONSE, 0)
        at = F.position(found, p)
        return F.when(found != "", F.concat(F.substr(p, F.lit(1), at - 1), F.lit(short_format), F.substr(p, at + F.length(found)))).otherwise(missing("RESPONSE FORMAT"))

    def a4(p: Column) -> Column:
        q = without_key(p, "notation")
        at = F.position(F.lit("KLONDIKE SOLITAIRE RULES"), q)
        return F.when(at > 0, F.concat(F.substr(q, F.lit(1), at - 1), F.lit(preamble), F.substr(q, at))).otherwise(missing("KLONDIKE SOLITAIRE RULES"))

    arms = {"C0": lambda p: p, "A1": lambda p: without_key(p, "reasoningTrail"), "A2": a2, "A3": lambda p: a2(without_key(p, "reasoningTrail")), "A4": a4}
    if name not in arms:
        raise ValueError(f"unknown arm: {name}")
    return arms[name](prompt)


#: Arm renderers by name.
ARMS = ("C0", "A1", "A2", "A3", "A4")


def delta_text(new: Column, old: Column) -> Column:
    """`` (+3)``, `` (-2)``; empty when nothing changed."""
    d = new - old
    return F.when(d == 0, "").otherwise(F.concat(F.lit(" ("), F.when(d > 0, "+").otherwise(""), d.cast("string"), F.lit(")")))


def recent_line(h: Column) -> Column:
    """One past move in compact form. ``h``: STRUCT<engine_move_type, card, from_col, to_col, foundation_suit>."""
    n = lambda c: h[c].cast("string")
    return (
        F.when(h["engine_move_type"] == "stock_to_waste", F.concat(F.lit("draw "), F.coalesce(h["card"], F.lit("?"))))
        .when(h["engine_move_type"] == "recycle_stock", "recycle stock")
        .when(h["engine_move_type"] == "tableau_to_tableau", F.concat(F.lit("move "), h["card"], F.lit(" col "), n("from_col"), F.lit(" -> col "), n("to_col")))
        .when(h["engine_move_type"] == "tableau_to_foundation", F.concat(h["card"], F.lit(" col "), n("from_col"), F.lit(" -> "), h["foundation_suit"], F.lit(" foundation")))
        .when(h["engine_move_type"] == "waste_to_tableau", F.concat(h["card"], F.lit(" waste -> col "), n("to_col")))
        .when(h["engine_move_type"] == "waste_to_foundation", F.concat(h["card"], F.lit(" waste -> "), h["foundation_suit"], F.lit(" foundation")))
        .otherwise(F.concat(F.lit("("), h["engine_move_type"], F.lit(")")))
    )


def stall_lines(no_progress: Column, seen_before: Column) -> Column:
    """ARRAY of none, one or two lines that state a stall and a repeated position."""
    return F.array_compact(F.array(
        F.when(no_progress > 0, F.concat(F.lit("STALL: no foundation play and no new card revealed in the last "), no_progress.cast("string"), F.lit(" moves."))),
        F.when(seen_before > 0, F.concat(F.lit("REPEAT: this exact board position has already occurred "), seen_before.cast("string"), F.lit(" time(s) earlier this game."))),
    ))
