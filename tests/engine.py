"""A direct Python engine of the rules, to hold the Column expressions against. Cards are (rank, suit, up)."""

import hashlib

SUITS = ["hearts", "diamonds", "clubs", "spades"]


def deal(seed):
    order = sorted(range(52), key=lambda k: hashlib.sha256(f"{seed}:{k}".encode()).hexdigest())
    cards = [(k % 13 + 1, SUITS[k // 13], False) for k in order]
    tab, at = [], 0
    for i in range(7):
        p = cards[at : at + i + 1]
        tab.append(p[:-1] + [(*p[-1][:2], True)])
        at += i + 1
    return {"tab": tab, "fnd": [[], [], [], []], "stock": cards[28:], "waste": [], "n": 0, "score": 0}


def red(c):
    return c[1] in ("hearts", "diamonds")


def stacks(c, onto):
    return c[0] == 13 if onto is None else red(c) != red(onto) and c[0] == onto[0] - 1


def founds(c, top):
    return c[0] == 1 if top is None else c[1] == top[1] and c[0] == top[0] + 1


def last(p):
    return p[-1] if p else None


def moves(b):
    out = []
    for i, p in enumerate(b["tab"]):
        if p and p[-1][2]:
            out += [("tableau_to_foundation", i, j, 1, 10) for j, f in enumerate(b["fnd"]) if founds(p[-1], last(f))]
    if b["waste"]:
        out += [("waste_to_foundation", None, j, 1, 10) for j, f in enumerate(b["fnd"]) if founds(b["waste"][-1], last(f))]
    for i, p in enumerate(b["tab"]):
        up = next((k for k, c in enumerate(p) if c[2]), None)
        for k in range(up, len(p)) if up is not None else ():
            for j, q in enumerate(b["tab"]):
                if j != i and stacks(p[k], last(q)) and not (not q and k == 0):
                    out.append(("tableau_to_tableau", i, j, len(p) - k, 0))
    if b["waste"]:
        out += [("waste_to_tableau", None, j, 1, 5) for j, q in enumerate(b["tab"]) if stacks(b["waste"][-1], last(q))]
    if b["stock"]:
        out.append(("stock_to_waste", None, None, 1, 0))
    return out


def apply(b, m):
    """None for a run with a hidden card: a drawn card stays hidden, may be laid on a pile, and blocks there."""
    kind, s, d, n, sc = m
    if kind == "tableau_to_tableau" and not all(c[2] for c in b["tab"][s][-n:]):
        return None
    b = {"tab": [list(p) for p in b["tab"]], "fnd": [list(p) for p in b["fnd"]], "stock": list(b["stock"]), "waste": list(b["waste"]), "n": b["n"] + 1, "score": b["score"] + sc}
    if kind == "stock_to_waste":
        b["waste"].append(b["stock"].pop())
    elif kind == "waste_to_foundation":
        b["fnd"][d].append(b["waste"].pop())
    elif kind == "waste_to_tableau":
        b["tab"][d].append(b["waste"].pop())
    else:
        run, b["tab"][s] = b["tab"][s][-n:], b["tab"][s][:-n]
        (b["fnd"] if kind == "tableau_to_foundation" else b["tab"])[d].extend(run)
        if b["tab"][s] and not b["tab"][s][-1][2]:
            b["tab"][s][-1] = (*b["tab"][s][-1][:2], True)
    return b


def of_row(r):
    if r is None:
        return None
    c = lambda p: [(x.rank, x.suit, x.face_up) for x in p]
    return {"tab": [c(p) for p in r.tableau], "fnd": [c(p) for p in r.foundations], "stock": c(r.stock), "waste": c(r.waste), "n": r.move_count, "score": r.score}
