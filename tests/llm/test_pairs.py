"""Defects of answers on a small labelled corpus, and the label model on its own."""

import json
import random

from cardlake.llm import pairs
from cardlake.llm.language import guess

EN = "Act as a careful solitaire player. Study the tableau, the waste and the stock, then answer with one legal move and your reasons."
ES = "Estás jugando al Klondike robando 3 carta(s) y vas por el turno 4. Mira el tablero, elige una sola jugada legal y explica brevemente tu decisión."
SCHEMA = "rowId bigint, prompt string, decision string, thinkingText string"
SOUND = ["Column 3 still hides 4 cards, so opening it is worth more than another pass through the stock.", "I refuse to bury the 7H under column 2, so the smaller step has to do.", "Sorry to leave the KS behind, but the 4D is worth more right now.", "I am not able to see under column 5, hence the guess is 3 hidden cards.", "It is a kind of Zugzwang: whatever I do, the 8H ends up under column 4."]


def decision(desc="Draw from stock", **more):
    return json.dumps({"moveIndex": 1, "chosenDescribe": desc, **more})


def corpus():
    r = random.Random(2)
    rows, want = [], {}

    def add(defect, decision_, words, ins=EN):
        rows.append((len(rows), json.dumps({"instruction": ins}), decision_, words))
        if defect:
            want[len(rows) - 1] = defect

    for _ in range(400):
        k = r.sample(SOUND, 2)
        add(None, decision(reasoning=k[1]) if r.random() < 0.5 else decision(), k[0] if r.random() < 0.8 else k[0].rstrip("."))
    for _ in range(40):
        add(None, decision(), "El agente ya no puede mover la carta porque la columna todavía esconde otra.", ES)
    for i in range(20):
        add("empty", r.choice([None, "", "{}", "null", decision("", reasoning=" ")]), r.choice([None, "", "​", "-", "..."]))
        add("truncated", decision()[: 12 + i], SOUND[i % 5])
        s = SOUND[i % 5]
        add("truncated", decision(), s[: len(s) * 2 // 3])
        add("refusal", r.choice([None, decision()]), r.choice(["I'm sorry, but I can't pick a move for this game.", "My guidelines do not allow me to take part in card games. Thank you for understanding.", "No comment. I won't be choosing anything from that list."]))
        add("copy", decision(), r.choice([EN, EN.upper(), f'"{EN}"', f"The task: {EN}", EN.replace("the ", "")]))
        add("other_language", decision(), r.choice(["La columna 4 todavía esconde 5 cartas, así que abrirla vale más que otra vuelta al mazo.", "В столбце 4 ещё 5 закрытых карт, поэтому открыть его важнее.", "列3にはまだ4枚の伏せ札があるので、山札をめくるより先に開きたい。"]))
    return rows, want


def test_corpus(spark):
    rows, want = corpus()
    got = {r.rowId: r.defect for r in pairs.broken_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    wrong = {k: (want.get(k), got.get(k)) for k in set(want) | set(got) if want.get(k) != got.get(k)}
    assert len(wrong) <= 2, [(v, rows[k]) for k, v in wrong.items()]


def test_nulls_everywhere_and_empty_table(spark):
    assert pairs.broken_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    got = pairs.broken_pairs(spark.createDataFrame([(1, None, None, None), (2, "{broken", None, "x" * 200_000)], SCHEMA)).collect()
    assert [(r.rowId, r.defect) for r in got if r.rowId == 1] == [(1, "empty")]


def test_any_row_id_is_looked_at(spark):
    rows, want = corpus()
    shifted = [(-r[0] - 1, *r[1:]) for r in rows]
    got = {-r.rowId - 1: r.defect for r in pairs.broken_pairs(spark.createDataFrame(shifted, SCHEMA)).collect()}
    assert sum(want.get(k) != got.get(k) for k in set(want) | set(got)) <= 2


def test_label_model_needs_no_labels():
    r = random.Random(1)
    counts = {}
    for i in range(5000):
        bad = i < 250
        pat = "".join("+" if r.random() < (0.9 if bad else 0.03) else "-" for _ in range(3))
        counts[pat] = counts.get(pat, 0) + 1
    post = pairs.em(counts, 0.02, ((0.8, 0.1),) * 3)
    assert post["+++"] > 0.99 and post["---"] < 0.01 and post["++-"] > 0.5 > post["+--"]
    assert pairs.em({}, 0.1, ()) == {} and pairs.em({"000": 5}, 0.1, ((0.9, 0.1),) * 3) == {"000": 0.0}
    assert post["+--"] < pairs.cutoff(post, {"+++": 9, "++-": 3}, {"---": 90, "+--": 9}, 0.05) <= post["++-"] <= 1


def test_refusals_in_several_languages():
    for t in ("Ich werde hier keinen Zug für dich auswählen.", "Diese Anfrage muss ich leider ablehnen.", "Prefiero no responder a eso.", "Je dois refuser de choisir un coup.", "I'd rather not answer that; please ask a human player instead."):
        assert pairs.votes(EN, True, "object", [t], False)[0]["refusal"][0] == 1, t
    for t in (*SOUND, "Ich kann 7H nicht bewegen, weil 8S darauf liegt.", "Ich werde keine Karte aus Spalte 3 nehmen."):
        assert pairs.votes(EN, True, "object", [t], False)[0]["refusal"][0] == -1, t


def test_language():
    assert guess("The prompt lists the moves and the column is open.")[0] == "en"
    assert guess("Seit drei Zügen hat sich nichts verändert, also nehme ich die kleine Lösung.")[0] == "de"
    assert guess("Nous avons comparé les parties, mais l'écart reste dans le bruit.")[0] == "fr"
    assert guess("Non c'è fretta di svuotare la colonna, perché nessun re è pronto.")[0] == "it"
    assert guess("A coluna ainda esconde cartas, por isso abri-la vale mais.")[0] == "pt"
    assert guess("")[0] is None and guess("7H 8S 12")[0] is None


def test_white_space_behind_the_end_mark_does_not_matter():
    for tail in (" " * 60, "\n" * 41, '")' * 30, " \n\u00a0" * 20):
        for text in ("The draw is the only move left.", "All of it is done…", "The draw is the only move"):
            assert pairs.votes(EN, True, "object", [text + tail], False)[0]["torn_words"] == pairs.votes(EN, True, "object", [text], False)[0]["torn_words"]
    assert pairs.votes(EN, True, "object", ["The draw is the only move left." + " " * 60], False)[0]["torn_words"][0] == -1


def test_declining_with_a_mere_number_keeps_its_vote():
    refusal = lambda *t: pairs.votes(EN, True, "object", list(t), False)[0]["refusal"]
    assert refusal("I cannot help with request 12.")[:4] == (-1, 0, 0, 1)
    assert refusal("I cannot help with request 12.", "I cannot help.")[0] == 1
    assert refusal("I cannot help with the 7H.")[3] == -1


def test_expectation_maximization_decides():
    """Ablation: with the starting rates alone (one round) a pattern falls on the other side than with estimated ones. One
    function of three is a coin; the counts of the patterns say so."""
    r, pats = random.Random(4), {}
    for i in range(20_000):
        bad = i % 20 == 0
        pat = "".join("+" if r.random() < (hit if bad else alarm) else "-" for hit, alarm in ((0.95, 0.01), (0.9, 0.01), (0.95, 0.4)))
        pats[pat] = pats.get(pat, 0) + 1
    first, last = (pairs.em(pats, 0.05, ((pairs.HIT, pairs.ALARM),) * 3, n) for n in (1, 60))
    assert first["++-"] < 0.5 < last["++-"] and last["--+"] < 0.01


def test_several_labels_are_kept(spark):
    rows, _ = corpus()
    rows.append((9000, json.dumps({"instruction": EN}), decision(), "Prefiero no responder a eso, es mejor que lo decidas tú con calma. Me niego a elegir una jugada de la lista que me das para este turno."))
    got = sorted(r.defect for r in pairs.defect_labels(spark.createDataFrame(rows, SCHEMA)).filter("rowId = 9000").collect())
    assert got == ["other_language", "refusal"]


#: Written after the patterns, in one go.
REFUSALS = [
    "I would prefer to sit this one out.", "I'm declining to choose.", "I'd rather you picked for yourself.", "Sorry, no recommendation from me today.", "I don't feel comfortable deciding this.", "That is not a question I am going to answer.", "I'm going to pass on this one.", "As a matter of policy I do not play games.", "I cannot in good conscience suggest anything here.", "You will have to make this decision without me.",
    "I am afraid I can't be of help here.", "My answer is that I give no answer.", "I refuse to take part in this.", "It's not my place to choose for you.", "I won't be making any selection.", "Please ask someone else, I don't want to advise on this.", "I'm not allowed to make decisions of this kind.", "No thanks, I'd rather not play.",
    "Dazu möchte ich keine Empfehlung geben.", "Ich enthalte mich hier.", "Das kann ich leider nicht entscheiden.", "Ich möchte lieber nicht mitspielen.", "Hierbei helfe ich nicht.", "Ich weigere mich, etwas auszuwählen.",
    "No quiero elegir ninguna jugada.", "Lo siento, no puedo ayudarte con esto.", "Prefiero abstenerme.", "Me niego a participar.", "No voy a tomar esa decisión.",
    "Je ne veux pas participer à ce jeu.", "Je préfère m'abstenir.", "Désolé, je ne peux pas vous aider.", "Je refuse de jouer.", "Ce n'est pas à moi de décider.",
]
FINE = [
    "I don't see a better move than this one.", "I can't decide between the two, so the index breaks the tie.", "It would not help to wait any longer.", "I would not call this lucky, but it works.", "There is nothing else to choose from.", "The other option is not worth it.", "We never get a second chance at this.", "I prefer the quiet line because it keeps more doors open.", "I did not expect such an easy answer.", "Nothing has changed since the last turn, so the small gain decides.",
    "I would rather open the long side first.", "Not every ace needs to go up at once.", "Ich sehe keinen besseren Weg.", "Es hilft nicht, noch länger zu warten.", "No veo otra salida mejor.", "Je ne vois rien de mieux ici.",
]


def test_refusals_written_after_the_patterns(spark):
    rows, _ = corpus()
    ask = {"de": "Runde 20: Nenne den besten Zug aus der Liste und erkläre in wenigen Sätzen, warum die anderen schlechter sind.", "es": ES, "fr": "Tour 3 : choisis le meilleur coup de la liste et explique en quelques phrases pourquoi il vaut mieux que les autres.", "en": EN}
    base = len(rows)
    for i, t in enumerate(REFUSALS + FINE):
        rows.append((10_000 + i, json.dumps({"instruction": ask[guess(t)[0] if guess(t)[0] in ask else "en"]}), decision(), t))
    got = {r.rowId - 10_000 for r in pairs.defect_labels(spark.createDataFrame(rows, SCHEMA)).filter("defect = 'refusal' AND rowId >= 10000").collect()}
    n = len(REFUSALS)
    missed, wrong = [REFUSALS[i] for i in range(n) if i not in got], [FINE[i - n] for i in got if i >= n]
    assert base and len(missed) <= 0.1 * n and len(wrong) <= 2, (len(missed), n, missed, wrong)
