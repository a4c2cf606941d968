"""Searches that follow one priority queue or one stack per board: best-first solving and depth-first trees.

Their order is sequential within a board, so a board is the unit of work; boards are spread over the cluster and
travel as text. A card is ``rank * 8 + suit * 2 + up``.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import board as bd
from . import native

State = tuple  # (tableau, foundations, stock, waste), tuples of card numbers


def _stacks(c: int, onto: int | None) -> bool:
    if onto is None:
        return c >> 3 == 13
    return ((c >> 1 & 3) < 2) != ((onto >> 1 & 3) < 2) and c >> 3 == (onto >> 3) - 1


def _founds(c: int, top: int | None) -> bool:
    if top is None:
        return c >> 3 == 1
    return c >> 1 & 3 == top >> 1 & 3 and c >> 3 == (top >> 3) + 1


def children(s: State) -> Iterator[tuple[tuple, State]]:
    """(move, state) in the order of the legal moves; moves that the rules refuse are left out."""
    tab, fnd, stock, waste = s
    tops = [p[-1] if p else None for p in tab]
    ftops = [f[-1] if f else None for f in fnd]

    def put(seq: tuple, i: int, v: tuple) -> tuple:
        return (*seq[:i], v, *seq[i + 1 :])

    def opened(p: tuple) -> tuple:
        return (*p[:-1], p[-1] | 1) if p else p

    for i, c in enumerate(tops):
        if c is not None and c & 1:
            for j, f in enumerate(ftops):
                if _founds(c, f):
                    yield ("tf", i, j, 1), (put(tab, i, opened(tab[i][:-1])), put(fnd, j, (*fnd[j], c)), stock, waste)
    if waste:
        for j, f in enumerate(ftops):
            if _founds(waste[-1], f):
                yield ("wf", None, j, 1), (tab, put(fnd, j, (*fnd[j], waste[-1])), stock, waste[:-1])
    for i, p in enumerate(tab):
        up = next((k for k, c in enumerate(p) if c & 1), len(p))
        for k in range(up, len(p)):
            if not all(c & 1 for c in p[k:]):
                continue
            for j, t in enumerate(tops):
                if j != i and _stacks(p[k], t) and (t is not None or k):
                    yield ("tt", i, j, len(p) - k), (put(put(tab, i, opened(p[:k])), j, (*tab[j], *p[k:])), fnd, stock, waste)
    if waste:
        for j, t in enumerate(tops):
            if _stacks(waste[-1], t):
                yield ("wt", None, j, 1), (put(tab, j, (*tab[j], waste[-1])), fnd, stock, waste[:-1])
    if stock:
        yield ("draw", None, None, 1), (tab, fnd, stock[:-1], (*waste, stock[-1] | 1))
    elif waste:
        yield ("recycle", None, None, 1), (tab, fnd, tuple(c & ~1 for c in reversed(waste)), ())


def won(s: State) -> bool:
    return all(len(f) == 13 for f in s[1])


def badness(s: State) -> int:
    """Lower is better: the negative search score."""
    tab, fnd, stock, waste = s
    up = sum(c & 1 for p in tab for c in p)
    return -(100 * sum(map(len, fnd)) + 10 * up + 20 * sum(not p for p in tab) - 2 * len(waste) - 5 * len(stock))


#: A board as one text of bytes: seven piles, four foundations, stock and waste, a byte per card. Foundation cards are
#: stored without their side, which nothing depends on any more.
_SEP = b"\0"
_ONE = [bytes([c]) for c in range(128)]
_EVEN = bytes(range(0, 256, 2))
_DOWN = bytes(c & 254 for c in range(256))
#: By card without side: the tops it may be laid on, and the foundation top it needs; -1 is an empty place.
_ONTO = [frozenset([-1] if c >> 2 == 13 else [o for o in range(4, 56) if o >> 2 == (c >> 2) + 1 and ((o & 3) < 2) != ((c & 3) < 2)]) for c in range(56)]
_NEEDS = [c - 4 if c >> 2 > 1 else -1 for c in range(56)]


def packed(s: State) -> bytes:
    tab, fnd, stock, waste = s
    return _SEP.join([*map(bytes, tab), *(bytes(c & 254 for c in f) for f in fnd), bytes(stock), bytes(waste)])


def _finished(key: bytes) -> bool:
    return all(len(f) == 13 for f in key.split(_SEP)[7:11])


def steps(key: bytes, plain: bool = False) -> Iterator[tuple[tuple, int, bytes]]:
    """(move, search score, board) like ``children``, over packed boards. ``plain`` are the rules of the board functions: a
    drawn card stays as it lies and the waste is not recycled."""
    p = key.split(_SEP)
    tops = [x[-1] >> 1 if x else -1 for x in p[:11]]
    stock, waste = p[11], p[12]
    base = 100 * sum(map(len, p[7:11])) + 10 * len(b"".join(p[:7]).translate(None, _EVEN)) + 20 * tops[:7].count(-1) - 2 * len(waste) - 5 * len(stock)
    join = _SEP.join

    def opened(x: bytes) -> tuple[bytes, int]:
        if not x:
            return x, 20
        return (x, 0) if x[-1] & 1 else (x[:-1] + _ONE[x[-1] | 1], 10)

    for i in range(7):
        x = p[i]
        if x and x[-1] & 1:
            for j in range(7, 11):
                if tops[j] == _NEEDS[tops[i]]:
                    q = p[:]
                    q[i], gain = opened(x[:-1])
                    q[j] += _ONE[x[-1] & 254]
                    yield ("tf", i, j - 7, 1), base + 90 + gain, join(q)
    if waste:
        w = waste[-1] >> 1
        for j in range(7, 11):
            if tops[j] == _NEEDS[w]:
                q = p[:]
                q[j] += _ONE[waste[-1] & 254]
                q[12] = waste[:-1]
                yield ("wf", None, j - 7, 1), base + 102, join(q)
    for i in range(7):
        x = p[i]
        n = k = len(x)
        while k and x[k - 1] & 1:
            k -= 1
        for k in range(k, n):
            onto = _ONTO[x[k] >> 1]
            for j in range(7):
                if tops[j] in onto and j != i and (tops[j] >= 0 or k):
                    q = p[:]
                    q[i], gain = opened(x[:k])
                    q[j] += x[k:]
                    yield ("tt", i, j, n - k), base + gain - (20 if tops[j] < 0 else 0), join(q)
    if waste:
        for j in range(7):
            if tops[j] in _ONTO[w]:
                q = p[:]
                q[j] += waste[-1:]
                q[12] = waste[:-1]
                yield ("wt", None, j, 1), base + 2 + 10 * (waste[-1] & 1) - (20 if tops[j] < 0 else 0), join(q)
    if stock:
        q = p[:]
        q[11], q[12] = stock[:-1], waste + (stock[-1:] if plain else _ONE[stock[-1] | 1])
        yield ("draw", None, None, 1), base + 3, join(q)
    elif waste and not plain:
        q = p[:]
        q[11], q[12] = waste[::-1].translate(_DOWN), b""
        yield ("recycle", None, None, 1), base - 3 * len(waste), join(q)


def solve(start: State, cap: int) -> tuple[str, int, list[tuple]]:
    """(SOLVED, UNSOLVABLE or UNKNOWN, nodes, moves) by best-first search with at most ``cap`` expanded nodes."""
    first = packed(start)
    heap, seen, nodes = [(badness(start), 0, first)], {first}, 0
    up, by, same = array("q", [-1]), [()], {}
    while heap:
        _, at, s = heapq.heappop(heap)
        if _finished(s):
            path = []
            while at:
                path.append(by[at])
                at = up[at]
            return "SOLVED", nodes, path[::-1]
        nodes += 1
        if nodes > cap:
            return "UNKNOWN", nodes - 1, []
        for m, score, t in steps(s):
            if t not in seen:
                seen.add(t)
                heapq.heappush(heap, (-score, len(by), t))
                up.append(at)
                by.append(same.setdefault(m, m))
    return "UNSOLVABLE", nodes, []


def beam(start: State, depth: int, width: int) -> tuple[bool, int, int | None]:
    """(solved, explored, level) of one board by beam search under the plain rules, as the reference solver goes: it ends
    at the first win, a board once reached on any level is not followed again, and only a level of more than ``width``
    boards is sorted by score (ties in order of expansion) and cut."""
    queue, explored = [packed(start)], 0
    seen = set(queue)
    for level in range(1, depth + 1):
        new = []
        for s in queue:
            for m, score, t in steps(s, plain=True):
                explored += 1
                if m[0] in ("tf", "wf") and _finished(t):
                    return True, explored, level
                if t not in seen:
                    seen.add(t)
                    new.append((score, t))
        if len(new) > width:
            new.sort(key=lambda x: -x[0])
            del new[width:]
        queue = [t for _, t in new]
        if not queue:
            break
    return False, explored, None


def tree(start: State, depth: int, max_nodes: int) -> list[tuple[int, int | None, int, bool, str]]:
    """Preorder nodes (id, parent, depth, won, move) with a visited set over the whole tree. The node budget is looked at
    before a node is opened, so the last opened node still gets all its children."""
    out: list[tuple[int, int | None, int, bool, str]] = [(0, None, 0, won(start), "")]
    seen = {start}

    def visit(s: State, me: int, d: int) -> None:
        if d >= depth or len(out) >= max_nodes or won(s):
            return
        for m, t in children(s):
            if m[0] == "recycle" or t in seen:
                continue
            seen.add(t)
            kid = len(out)
            out.append((kid, me, d + 1, won(t), " ".join("" if x is None else str(x) for x in m)))
            visit(t, kid, d + 1)

    visit(start, 0, 0)
    return out


def tree_figures(start: State, depth: int, max_nodes: int) -> tuple[int, int, int, int]:
    """(nodes, deepest level, leaves, won leaves) of ``tree``, without its rows."""
    nodes, deepest, leaves, winning = 1, 0, 0, 0
    seen = {packed(start)}

    def visit(s: bytes, d: int) -> None:
        nonlocal nodes, deepest, leaves, winning
        kids, done = 0, _finished(s)
        deepest = max(deepest, d)
        if d < depth and nodes < max_nodes and not done:
            for m, _, t in steps(s):
                if m[0] != "recycle" and t not in seen:
                    seen.add(t)
                    nodes += 1
                    kids += 1
                    visit(t, d + 1)
        if not kids:
            leaves += 1
            winning += done

    visit(packed(start), 0)
    return nodes, deepest, leaves, winning


def as_text(b):
    """Column: a board as text for the functions here."""
    code = lambda p: F.array_join(F.transform(p, lambda c: (c["rank"] * 8 + (F.array_position(F.array(*[F.lit(x) for x in bd.SUITS]), c["suit"]).cast("int") - 1) * 2 + F.when(c["face_up"], 1).otherwise(0)).cast("string")), ",")
    piles = lambda q: F.array_join(F.transform(q, code), "/")
    return F.concat_ws("|", piles(b["tableau"]), piles(b["foundations"]), code(b["stock"]), code(b["waste"]))


def from_text(t: str) -> State:
    pile = lambda x: tuple(int(c) for c in x.split(",") if c)
    a, b, c, d = t.split("|")
    return tuple(map(pile, a.split("/"))), tuple(map(pile, b.split("/"))), pile(c), pile(d)


def spread(boards: DataFrame) -> DataFrame:
    """(game, t): boards as text over a fixed number of tasks; left to itself Spark packs so few bytes into one task."""
    return boards.select("game", as_text(F.col("board")).alias("t")).repartition(32 * boards.sparkSession.sparkContext.defaultParallelism, "game")


def beam_boards(boards: DataFrame, depth: int, width: int) -> DataFrame:
    """(game, solved, explored, length, level) of every board by ``beam``, run in the JVM."""
    return spread(boards).select("game", native.inlined(boards.sparkSession, "cardlake_beam", F.col("t"), F.lit(depth), F.lit(width)))


def solve_boards(boards: DataFrame, cap: int = 200_000) -> DataFrame:
    """(game, verdict, nodes, length) of every board by ``solve``, run in the JVM; recycling the waste is a move here."""
    return spread(boards).select("game", native.inlined(boards.sparkSession, "cardlake_solve", F.col("t"), F.lit(cap)))


def trees(boards: DataFrame, depth: int = 10, max_nodes: int = 10_000) -> DataFrame:
    """(game, node, parent, depth, won, move): the depth-first move tree of every board."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(g, *x) for g, t in zip(pdf["game"], pdf["t"]) for x in tree(from_text(t), depth, max_nodes)]
            yield pd.DataFrame(rows, columns=["game", "node", "parent", "depth", "won", "move"]).astype({"parent": "Int64"})

    return boards.select("game", as_text(F.col("board")).alias("t")).repartition("game").mapInPandas(run, "game bigint, node bigint, parent bigint, depth bigint, won boolean, move string")


def tree_statistics(nodes: DataFrame) -> DataFrame:
    """Per game: nodes, leaves (nodes without children, by anti-join), won leaves and the deepest level."""
    inner = nodes.filter("parent IS NOT NULL").select("game", F.col("parent").alias("node")).distinct()
    leaf = nodes.join(inner, ["game", "node"], "left_anti").groupBy("game").agg(F.count("*").alias("leaves"), F.count_if("won").alias("winning"))
    return nodes.groupBy("game").agg(F.count("*").alias("nodes"), F.max("depth").alias("deepest")).join(leaf, "game")


def tree_sizes(boards: DataFrame, depth: int = 10, max_nodes: int = 10_000) -> DataFrame:
    """(game, nodes, deepest, leaves, winning): ``tree_statistics`` of ``trees``, counted where a tree is made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(g, *tree_figures(from_text(t), depth, max_nodes)) for g, t in zip(pdf["game"], pdf["t"])]
            yield pd.DataFrame(rows, columns=["game", "nodes", "deepest", "leaves", "winning"])

    return spread(boards).mapInPandas(run, "game bigint, nodes bigint, deepest bigint, leaves bigint, winning bigint")
