"""Positions in three layouts, written in many ways."""

import itertools
import random

from cardlake.llm import overlap

SCHEMA = "exampleId bigint, split string, origin string, seed bigint, prompt string"
NAMES = dict(zip("A23456789TJQK", "ace two three four five six seven eight nine ten jack queen king".split()))


def position(seed):
    r = random.Random(seed)
    deck = [a + b for a in "A23456789TJQK" for b in "HDCS"]
    r.shuffle(deck)
    return {"f": [r.randint(0, 9) for _ in range(4)], "cols": [(r.randint(0, 4), [deck.pop() for _ in range(r.randint(0, 3))]) for _ in range(7)], "waste": r.choice([None, deck.pop()]), "stock": r.randint(0, 20), "recent": [f"Move {deck.pop()} from waste to col {r.randint(1, 7)}"], "legal": [f"Move {deck.pop()} from col {r.randint(1, 7)} to col {r.randint(1, 7)}" for _ in range(3)]}


def block(p, intro="Read every block.", outro="Reply in JSON.", gap="   ", hidden="??", none="--"):
    f = gap.join(f"{s}: {'A23456789TJQK'[n - 1] + s if n else none}" for s, n in zip("HDCS", p["f"]))
    cols = "\n".join(f"  col{i + 1}: " + (" ".join([hidden] * n + c) or "(empty)") for i, (n, c) in enumerate(p["cols"]))
    legal = "\n".join(f"  [{i}] move   {m}" for i, m in enumerate(p["legal"]))
    return f"{intro}\n\nFOUNDATIONS:   {f}\nTABLEAU:\n{cols}\nWASTE: {p['waste'] or none}   STOCK: {p['stock']}\nRECENT MOVES:\n  - {p['recent'][0]}\nLEGAL MOVES (choose one):\n{legal}\nPROGRESS: foundation={sum(p['f'])}/52\n\n{outro}"


def as_json(p, outro="Now choose."):
    import json

    return "Decide.\nCURRENT GAME (JSON):\n" + json.dumps({"foundations": dict(zip("HDCS", p["f"])), "tableau": [{"faceDownCount": n, "faceUp": " ".join(c)} for n, c in p["cols"]], "waste": p["waste"], "stock": p["stock"], "legalMoves": [{"type": "move", "describe": m} for m in p["legal"]]}) + "\n" + outro


def prose(p):
    f = "  ".join(f"{s}: {'A23456789TJQK'[n - 1] + s if n else '--'}" for s, n in zip("HDCS", p["f"]))
    cols = "; ".join(f"column {i + 1} has {n} hidden" + (f" and shows {', '.join(c)}" if c else "") for i, (n, c) in enumerate(p["cols"]))
    return f"Decide. The foundations stand at {f}. In the tableau, {cols}. The waste shows {p['waste'] or 'nothing'} and the stock holds {p['stock']}. You may: " + "; ".join(f"({i}) {m}" for i, m in enumerate(p["legal"])) + ". Reply."


def pairs(spark, rows):
    return {(r.exampleIdA, r.exampleIdB) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_ways_of_writing_one_position(spark):
    p = position(1)
    b = block(p)
    forms = [b, b.lower(), b.upper(), block(p, gap=" "), block(p, hidden="XX", none="none"), block(p, intro="Other words."), block(p, outro="Answer with one object. (retry)"), b[: b.index("PROGRESS") - 9], b.replace("FOUNDATIONS", "FUONDATIONS").replace("col3", "clo3"), b.replace("TH", "10H").replace("AS", "A♠"), b + "\nLogged by client 3."]
    rows = [(0, "train", "o", 5, b)] + [(i + 1, "test", "o", (5, 0, None)[i % 3], f) for i, f in enumerate(forms)]
    assert pairs(spark, rows) == {(0, i + 1) for i in range(len(forms))}


REWORDED = [
    lambda t: t.replace("col", "pile"),
    lambda t: t.replace("hidden", "covered").replace("shows", "displays"),
    lambda t: t.replace("TABLEAU", "COLUMNS OF THE TABLEAU").replace("WASTE", "TOP OF WASTE").replace("STOCK", "CARDS IN STOCK"),
    lambda t: t.replace("foundations", "ace piles").replace("FOUNDATIONS", "ACE PILES").replace("faceDownCount", "down").replace("faceUp", "up"),
    lambda t: t.replace("Move ", "Shift ").replace(" from ", " off ").replace("col ", "column no. "),
    lambda t: t.replace("column ", "stack ").replace("has ", "keeps ").replace(" and shows ", " face down, face up "),
    lambda t: "Some other opening, as asked for by the player.\n\n" + t[t.index("\n") + 1 :] if t.startswith("Read") else "An opening. " + t,
    lambda t: t[: int(len(t) * 0.9)],
    lambda t: t.replace("\n", " ").replace("  ", " "),
    lambda t: "\n\n".join(t.split("\n")) + "\n(second copy)",
]


def test_recall_under_other_labels_words_and_cuts(spark):
    """Every change alone and two at a time on positions of all layouts: at least 0.9 of the pairs are found."""
    r, rows, want = random.Random(9), [], set()
    for k in range(120):
        t = (block, as_json, prose)[k % 3](position(1000 + k))
        rows.append((2 * k, "train", "o", None, t))
        for f in r.sample(REWORDED, 1 + k % 2):
            t = f(t)
        rows.append((2 * k + 1, "test", "o", None, t))
        want.add((2 * k, 2 * k + 1))
    got = pairs(spark, rows)
    assert got <= want and len(got) >= 0.9 * len(want), (len(got), len(want))


def test_hot_position_is_joined_once_per_record(spark):
    p = block(position(7))
    rows = [(i, "train", "o", 1, p) for i in range(300)] + [(1000 + i, "test", "o", 1, p) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    ev, tr, matches = overlap._classes(df)
    assert matches.count() == 1 and len(pairs(spark, rows)) == 6000
    assert overlap.overlap_report(df).first().asDict() == {"split": "test", "origin": "o", "examples": 20, "overlapping": 20, "pairs": 6000}


def test_other_positions_deals_and_layouts(spark):
    many = [position(s) for s in range(2, 9)]
    near = {**many[0], "stock": many[0]["stock"] + 1}
    rows = [(i, "train", "o", None, f(p)) for i, (p, f) in enumerate(itertools.product(many, (block, as_json, prose)))]
    rows += [(100, "valid", "o", None, block(near)), (101, "valid", "o", None, as_json(position(50)))]
    assert pairs(spark, rows) == set()
    assert pairs(spark, [(1, "train", "o", 3, block(many[0])), (2, "valid", "o", 4, block(many[0]))]) == set()
    for f in (as_json, prose):
        assert pairs(spark, [(2, "train", "o", 3, f(many[0])), (1, "valid", "o", 3, f(many[0]) + " Think first.")]) == {(1, 2)}


def test_train_pairs_and_evaluation_pairs_are_no_cases(spark):
    p = block(position(3))
    assert pairs(spark, [(1, "train", "o", 1, p), (2, "train", "o", 1, p), (3, "test", "o", 1, p), (4, "valid", "o", 1, p)]) == {(1, 3), (2, 3), (1, 4), (2, 4)}


def test_prompts_without_a_board_and_blank_ones(spark):
    rows = [(1, "train", "o", None, "Just say hello, please!"), (2, "test", "o", None, "just  say hello please"), (3, "train", "o", None, None), (4, "test", "o", None, None), (5, "train", "o", None, " ​"), (6, "test", "o", None, ""), (7, None, "o", None, "Just say hello, please!"), (8, "test", "o", None, "x" * 300_000)]
    assert pairs(spark, rows) == {(1, 2)}
    assert pairs(spark, []) == set()


def test_report(spark):
    p = block(position(3))
    rows = [(1, "train", "a", 1, p), (2, "test", "a", 1, p), (3, "test", None, 1, p), (4, "valid", "b", 1, block(position(4)))]
    got = {(r.split, r.origin): (r.examples, r.overlapping, r.pairs) for r in overlap.overlap_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("test", "a"): (1, 1, 1), ("test", None): (1, 1, 1), ("valid", "b"): (1, 0, 0)}
