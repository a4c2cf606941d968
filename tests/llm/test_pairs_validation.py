"""Cutoffs are validated on every sound answer, broken in known ways, however many there are."""

import json
from collections import Counter

from cardlake.llm import pairs
from cardlake.llm.language import guess, points
from tests.llm.test_pairs import EN, ES, SCHEMA, SOUND, decision

GERMAN = "Runde 20: Nenne den besten Zug aus der Liste und erkläre in wenigen Sätzen, warum die anderen schlechter sind."
WORDS = {EN: SOUND, ES: ["La columna 4 todavía esconde 5 cartas, así que abrirla vale más que otra vuelta al mazo."], GERMAN: ["Die Spalte 3 hat noch 4 Karten, also ist es nicht zu früh, sie zu öffnen."]}


def test_every_sound_answer_validates(spark):
    asked = [EN] * 1_500 + [ES] * 600 + [GERMAN] * 400
    rows = [(i, json.dumps({"instruction": a}), decision(), WORDS[a][i % len(WORDS[a])]) for i, a in enumerate(asked)]
    rows += [(9_000, None, None, None), (9_001, json.dumps({"instruction": EN}), decision(""), SOUND[0]), (9_002, json.dumps({"instruction": EN}), decision(), "")]
    v, broken = pairs.vote_table(spark.createDataFrame(rows, SCHEMA))
    assert v.count() == 2_503 and v.filter("ground").count() == 2_500
    total = {d: sum(c.values()) for d, c in broken.items()}
    n, pairs_of_tongues = 2_500, 2_500**2 - 1_500**2 - 600**2 - 400**2
    assert total == {"empty": n, "copy": n, "refusal": 12 * n, "other_language": pairs_of_tongues, "torn_json": 4 * n, "torn_words": n}

    # the same counts by the definition, answer by answer
    code = lambda model, *a: pairs._code(pairs.votes(*a)[0][model])
    copies, foreign = Counter(), Counter()
    texts = Counter((a, w) for (_, _, _, w), a in zip(rows, asked))
    for i, a in enumerate(asked):
        copies[code("copy", a, True, "object", [" ".join(w for k, w in enumerate(a.split()) if k % 9 != i % 9)], False)] += 1
    for a, m in Counter(asked).items():
        for (b, w), k in texts.items():
            if guess(a)[0] != guess(b)[0]:
                foreign[code("other_language", a, True, "object", [w], False)] += m * k
    assert broken["copy"] == copies and broken["other_language"] == foreign
    assert broken["empty"] == {"+++": n} and broken["torn_json"] == {"+++": 3 * n, "++-": n}


def test_cut_words_hold_the_vote_of_all_closed_sentences(spark):
    said = "The draw is the only move left on the board now."
    rows = [(i, json.dumps({"instruction": EN}), decision(), said) for i in range(100)]
    _, broken = pairs.vote_table(spark.createDataFrame(rows, SCHEMA))
    assert sum(broken["torn_words"].values()) == 100 and all(q[0] == q[2] == "+" for q in broken["torn_words"])
    # pieces that are sentences elsewhere are not told as torn by the corpus
    pieces = {pairs.broken_copies(i, EN, said)[4] for i in range(100)}
    more = [(1_000 + 10 * i + k, json.dumps({"instruction": EN}), decision(), p + ".") for i, p in enumerate(sorted(pieces)) for k in range(2)]
    _, broken = pairs.vote_table(spark.createDataFrame(rows + more, SCHEMA))
    assert sum(n for q, n in broken["torn_words"].items() if q[2] == "-") >= 100
    assert not any(pairs.vote_table(spark.createDataFrame([], SCHEMA))[1].values())


def test_language_votes_need_only_what_is_spoken():
    for ins in (EN, ES, GERMAN, "", "7H"):
        want, sure, script = pairs._asked(ins)[3:]
        for parts in ([SOUND[0]], [WORDS[ES][0], SOUND[1]], ["列3にはまだ4枚の伏せ札があるので、山札をめくるより先に開きたい。"], ["-"], []):
            told = pairs.spoken([points(p) for p in parts if any(c.isalnum() for c in p)])
            assert pairs.foreign(want, min(sure, 2), script, *told) == pairs.votes(ins, True, "object", parts, False)[0]["other_language"]
