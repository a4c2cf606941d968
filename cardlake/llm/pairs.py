"""Broken prompt and response pairs: noisy labelling functions, combined by an expectation-maximization label model."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import action_key
from ..functions.text import is_blank
from ..session import cut
from .language import decide, guess, points

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
#: Label models and the defect each speaks for: an answer can break off in its JSON or in its words.
MODELS = {"empty": "empty", "copy": "copy", "refusal": "refusal", "other_language": "other_language", "torn_json": "truncated", "torn_words": "truncated"}
#: Phrases by which an answer declines, in several languages. Fixed patterns over lower-case text.
DECLINE = re.compile(
    r"\b(?:i(?:'m| am)? (?:can(?:'t|not|no longer)|won't|will not|must refuse|must decline|have to (?:decline|pass|refuse)|refuse|decline|am unable|am not able|do not feel comfortable|don't think i should|'d rather not|would rather not)"
    r"|i'd rather not|i'm (?:unable|not able|not going to|sorry)|must (?:refuse|decline)|unable to (?:fulfil|comply|help|assist)|not (?:able|willing) to (?:help|assist)|not something i (?:can|will|may) do|something i won't do|falls outside of what i"
    r"|no comment|leave it unanswered|give no answer|not be appropriate for me|do not allow me|don't allow me|decline this request|can't (?:help|assist)|cannot (?:help|assist)"
    r"|ablehnen|verweiger\w*|nicht (?:helfen|beantworten)|kann ich (?:leider )?nicht (?:helfen|antworten|beantworten)|dazu (?:sage|äußere) ich|möchte ich (?:nicht|lieber nicht)|ich (?:werde|will|darf|kann) (?:hier |das |dies |dir |dazu |leider )*(?:kein(?:e|en)? (?:zug|entscheidung|antwort|empfehlung)|nicht (?:entscheiden|wählen|auswählen|antworten|mitspielen))"
    r"|no puedo (?:ayudar|responder)|prefiero no|debo negarme|me niego|no voy a (?:responder|elegir)|rechazar (?:esta|la)"
    r"|je ne peux pas (?:répondre|aider|vous aider|t'aider)|je préfère ne pas|je (?:dois )?refuse[rz]?|décliner|je ne (?:souhaite|veux) pas"
    r"|non posso (?:aiutare|rispondere)|não posso (?:ajudar|responder))"
)
_TASK_EN = r"(?:choos\w+|pick\w*|select\w*|decid\w+|answer\w*|respond\w*|repl(?:y|ies|ying)|help\w*|assist\w*|recommend\w*|suggest\w*|advis\w+|take part|taking part|participat\w+|compl(?:y|ies|ying)|engag\w+|play along|weigh in|(?:giv|mak|offer|provid)\w* (?:you |a |an |any |that |this |such )*(?:choices?|decisions?|recommendations?|answers?|suggestions?|opinions?|advice|selections?|moves?)|play\w* (?:games?|along|this|that))"
#: Who, a word of refusing and what the task asks for, close together in this order, in several languages; and ways of
#: staying out. Wider than ``DECLINE``, so more often wrong: a labelling function of its own.
LOOSE = re.compile(
    rf"\b(?:i|we)(?:'m|'d|'ll|'re|'ve)?\b[^.]{{0,30}}(?:\b(?:not|cannot|never|unable|refus\w+|declin\w+|rather|prefer|reluctant|unwilling|against|avoid|stop|avoiding|forbidden|prohibited|nothing)\b|n't\b)[^.]{{0,30}}\b{_TASK_EN}\b"
    r"|\b(?:sit|sitting|stay|staying|opt|opting|bow|bowing|count me|leave me|keep me) (?:this |it |that )?(?:one |round |turn )?out\b|\b(?:i|we)(?:'ll|'d| will| would| must| have to)? (?:rather |prefer to |choose to |have to )?(?:abstain|pass on (?:this|that|it)|pass this time|skip this (?:one|question|request)|withhold|leave (?:this|that|it|the (?:choice|decision)) (?:to|for|open))\b"
    rf"|\b(?:nobody|no one|somebody else|someone else|another)\b[^.]{{0,20}}\b(?:should|must|has to|will have to)\b[^.]{{0,12}}\b{_TASK_EN}\b|\bthis (?:request|question|task) (?:is|goes|lies) (?:not|beyond|outside|against)\b|\b(?:against|outside|beyond) (?:my|our) (?:rules|policy|policies|principles|scope|instructions|purpose)\b"
    r"|\b(?:ich|wir)\b[^.]{0,40}\b(?:nicht|kein\w*|ungern|niemals|lieber|verweiger\w*|weiger\w*|ablehn\w*|lehne\w*|verzicht\w*|enthalte\w*)\b[^.]{0,40}\b(?:wähl\w*|auswähl\w*|auszuwähl\w*|aussuch\w*|entscheid\w*|antwort\w*|beantwort\w*|helf\w*|mitspiel\w*|mitmach\w*|empfehl\w*|teilnehm\w*|raten|vorschlag\w*|vorschlagen|äußern|ab)\b|\b(?:enthalte mich|halte mich (?:da )?(?:heraus|raus)|kann ich (?:nicht|keine) \w*(?:helfen|beantworten|empfehlen|entscheiden))\b"
    r"|\b(?:no (?:quiero|puedo|voy a|deseo|pienso|debo|pienso|me corresponde|estoy dispuest[oa] a)|prefiero (?:no|abstenerme)|me (?:niego|abstengo|rehúso)|rechazo|declino|rehúso)\b[^.]{0,30}\b(?:elegir|escoger|responder|contestar|ayudar\w*|jugar|decidir|recomendar\w*|participar|seguir|opinar|dar)\b|\b(?:me abstengo|prefiero abstenerme|no voy a opinar)\b"
    r"|\bje\b[^.]{0,25}\b(?:pas|refuse|préfère|décline|m'abstiens|m'abstenir|rien|aucun\w*)\b[^.]{0,30}\b(?:choisir|répondre|aider|jouer|décider|recommander|conseiller|participer|prononcer|réponse)\b|\bje (?:m'abstiens|préfère m'abstenir|passe mon tour)\b"
    r"|\b(?:non (?:posso|voglio|intendo)|preferisco non|mi rifiuto di|mi astengo)\b[^.]{0,30}\b(?:scegliere|rispondere|aiutar\w*|giocare|decidere)\b|\b(?:não (?:posso|quero|vou)|prefiro não|recuso-me a|me recuso a)\b[^.]{0,30}\b(?:escolher|responder|ajudar|jogar|decidir)\b"
)
#: Refusals by way of who is not to decide.
ASIDE = re.compile(
    rf"\b(?:not|nothing|no (?:question|task|choice|thing|decision)|never)\b[^.]{{0,30}}\b(?:i|we)\b[^.]{{0,25}}\b{_TASK_EN}\b|\bnot (?:my|our|for me|up to me|mine)\b[^.]{{0,25}}\b{_TASK_EN}\b|\bpass(?:ing)? on (?:this|that|it)\b|\b{_TASK_EN}[^.]{{0,20}}\b(?:without me|yourself|yourselves|on your own)\b|\bno (?:recommendation|answer|decision|advice|selection|suggestion|comment)\b[^.]{{0,20}}\b(?:from|by|with) (?:me|us)\b|\brather (?:you|someone|somebody)\b"
    r"|\b(?:hierbei|dabei|damit|daran|hier) (?:helfe|beteilige|wähle|entscheide|antworte) ich (?:mich )?nicht\b|\b(?:nicht meine|keine) (?:aufgabe|sache)\b|\bich (?:bin|fühle mich) (?:dafür |dazu )?nicht (?:zuständig|befugt|wohl)\b|\b(?:no me corresponde|no es (?:mi|cosa mía)|no voy a (?:tomar|hacer|dar))\b|\bce n'est pas (?:à moi|mon rôle)\b|\bil ne m'appartient pas\b"
)
#: Words of the game and of choosing a move in it; a refusal has few of them.
GAME = re.compile(r"\b(?:kings?|queens?|jacks?|aces?|cards?|stock|waste|moves?|turns?|draws?|piles?|suits?|hearts|spades|clubs|diamonds|hidden|face-down|lines?|options?|gains?|index|deck|recycle|könig\w*|dame|ass|asse|karten?|stapel|züge|zug|ablage|rey|reyes|reina|as|ases|cartas?|mazo|jugadas?|turnos?|roi|rois|dame|carte|cartes|talon|coups?|tours?|re|carta|carte|mossa|mosse|rei|jogadas?)\b")
#: Words that give a reason.
REASON = re.compile(r"\b(?:because|so|since|hence|therefore|thus|but it|as it|weil|denn|da|deshalb|also|porque|pues|así que|por eso|car|parce|donc|puisque|perché|quindi|pois|por isso)\b")
#: Polite frames of a refusal.
FRAME = re.compile(
    r"\b(?:sorry|apologi[sz]e|regrettably|unfortunately|as an? (?:assistant|ai|language model)|my guidelines|thank you for understanding|is there anything else|ask a human|decide for yourself|to be honest|thanks for the question"
    r"|es tut mir leid|leider|lo siento|désolé|desolé|mi dispiace|desculpe|gracias por|merci de)"
)
CARD = re.compile(r"(?<![^\W_])(?:(?:10|[2-9ATJQK])[HDCS♥♦♣♠]|(?:10|[2-9])[hdcs])(?![^\W_])")
BOARD = re.compile(r"\b(?:column|col|spalte|columna|colonne|colonna|coluna|pile|tableau|foundation|waste|stock)s?\b|столб|列", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”’»)]*\s+|(?<=[。！？])|[\r\n]+")
_END = re.compile(r"[.!?。！？][\"'”’»)\s]*$")
_CLOSERS = "\"'”’»)"
_WORDY = re.compile(r"[^\W_]")
_DIGIT = re.compile(r"\d")
_FINAL = re.compile(r"(?i)\s*final\s*:")
_STUMP = re.compile(r"(?:^|\s)[^\W\d_AIaàeyo]$|[,;:]$")
_TOKENS = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"[\s​﻿ ]+")


def masked_sentence(s: str) -> str:
    """A sentence with cards and numbers masked, lower case, single spaces, without closing punctuation."""
    s = CARD.sub("#c", s)
    s = re.sub(r"\d+", "#", s).lower()
    return _SPACE.sub(" ", s).strip(" .!?…\"'”’»。！？")


def sentences(part: str) -> list[str]:
    return [x for x in _SENTENCE.split(part.strip()) if x]


def ending(p: str) -> str:
    """The last three characters before closing quotes, brackets and white space, however many there are."""
    n = len(p)
    while n and (p[n - 1] in _CLOSERS or p[n - 1].isspace()):
        n -= 1
    return p[max(0, n - 3) : n]


def last_of(parts: list[str]) -> str:
    """The last sentence with a letter or digit."""
    return next((x for x in reversed(parts) if _WORDY.search(x)), "")


def _bigrams(t: list[str]) -> set[tuple[str, str]]:
    return set(zip(t, t[1:]))


def _lacks(words: str) -> tuple[int, int]:
    """Votes for a refusal by what an answer lacks: words of the game, and a reason."""
    if not words:
        return -1, -1
    low = words.lower()
    return -1 if GAME.search(low) or CARD.search(words) else 1, -1 if REASON.search(low) else 0


@lru_cache(maxsize=16_384)
def _asked(instruction: str) -> tuple:
    """Tokens, their set and pairs, language, lead and script of an instruction; few instructions recur in many rows."""
    tokens = _TOKENS.findall(instruction.lower())
    return tokens, set(tokens), _bigrams(tokens), *guess(instruction)


def ends(parts: list[str], split: list[list[str]], final_action: bool) -> tuple[tuple[int, int], list[str], list[str]]:
    """Votes for words that break off, and the last sentences of parts without and with an end mark."""
    dots, open_ends, closed = False, [], []
    for p, x in zip(parts, split):
        tail = ending(p)
        torn = tail.endswith(("…", "..."))
        dots = dots or torn
        (open_ends if torn or not tail.endswith((".", "!", "?", "。", "！", "？")) else closed).append(last_of(x))
    if final_action and open_ends:
        open_ends = [s for s in open_ends if not _FINAL.match(s)]
    stump = dots or any(_STUMP.search(s) for s in open_ends)
    return (1 if open_ends else -1, 1 if stump and open_ends else -1), open_ends, closed


def same_words(instruction: str, words: str) -> tuple[int, ...]:
    """Votes for a copy of the instruction."""
    asked, asked_set, asked_pairs = _asked(instruction)[:3]
    answer = _TOKENS.findall(words.lower())
    if not answer or not asked:
        return (-1, -1, -1, 0)
    mine = set(answer)
    inter = len(mine & asked_set)
    into, back = inter / len(mine), inter / len(asked_set)
    near = into >= 0.6
    order = len((pairs := _bigrams(answer)) & asked_pairs) / max(1, min(len(pairs), len(asked_pairs))) if near else 0.0
    ratio = len(answer) / len(asked)
    return (1 if into >= 0.7 else -1, 1 if back >= 0.6 else -1, 1 if order >= 0.5 and near else -1, 1 if 0.5 <= ratio <= 1.6 and near else 0)


def spoken(each: list[tuple[Counter[str], str]]) -> tuple[str | None, int, tuple[str, ...], tuple[str, ...]]:
    """(language, lead up to 4, languages of the parts that tell one, scripts) of an answer by the points of its parts: all
    that ``foreign`` looks at."""
    whole, lead = decide(sum((g for g, _ in each), Counter()))
    hints = {h[0] for h in (decide(g) for g, _ in each) if h[0] and h[1] >= 2}
    return whole, min(lead, 4), tuple(sorted(hints)), tuple(sorted({x for _, x in each}))


def foreign(want: str | None, sure: int, script: str, whole: str | None, lead: int, hints: tuple[str, ...], scripts: tuple[str, ...]) -> tuple[int, ...]:
    """Votes for another language: of what ``spoken`` tells of an answer, against the language and script of its instruction."""
    if not scripts or not want or sure < 2:
        return (0, 0, 0, 0)
    return (
        0 if whole is None else (1 if whole != want and lead >= 2 else (-1 if whole == want else 0)),
        1 if any(x != script for x in scripts) else 0,
        0 if not hints else (1 if all(h != want for h in hints) else -1),
        0 if whole is None or lead < 4 else (1 if whole != want else -1),
    )


def votes(instruction: str | None, action: bool, json_state: str, parts: list[str], final_action: bool, shape: str = "") -> tuple[dict[str, tuple[int, ...]], list[str], list[str]]:
    """Votes (1 for, -1 against, 0 abstains) of every labelling function, by label model, and the masked last sentences
    of parts that end without a full stop (whether these are complete only the corpus can tell) and of those with one."""
    parts = [p for p in parts if p and _WORDY.search(p)]
    split = [sentences(p) for p in parts]
    words = " ".join(parts)
    said = bool(parts)
    want, sure, script = _asked(instruction or "")[3:]
    out: dict[str, tuple[int, ...]] = {}
    bare = 0 if json_state == "broken" else 1
    out["empty"] = (1 if not said and not action and bare else -1, -1 if said else bare, -1 if action else bare)

    # torn JSON: it does not parse; it does not end with its bracket (o in ``shape``); its quotes do not pair up (q)
    broken = json_state == "broken"
    out["torn_json"] = (0, 0, 0) if json_state == "none" else (1 if broken else -1, 1 if "o" in shape else -1, 1 if "q" in shape else -1)
    # torn words: a part that stops without an end mark; a stump or an ellipsis at the very end; the corpus speaks later
    torn, open_ends, closed = ends(parts, split, final_action)
    out["torn_words"] = (0, 0) if not said or broken else torn

    # refusal: a finished declining sentence that names no card or column; polite frames; words without an action; a
    # looser form of declining. Sentences about the board never speak for a refusal, so the long patterns are tried on the
    # few others alone. A sentence with a mere number is not clean, but still declines.
    clean = about = declines = loose = aside = False
    for x in split:
        for s in x:
            low = s.lower()
            if CARD.search(s) or BOARD.search(low):
                about = True
                continue
            number = _DIGIT.search(s) is not None
            plain = low.replace("’", "'")
            if not (declines if number else clean) and _END.search(s) and DECLINE.search(plain):
                declines, clean = True, clean or not number
            loose = loose or (not number and LOOSE.search(plain) is not None)
            aside = aside or (not number and ASIDE.search(plain) is not None)
    silent = said and not action and json_state == "object"
    out["refusal"] = (1 if clean else -1, 1 if silent else 0, 1 if said and not about and FRAME.search(words.lower()) else 0, -1 if about else (1 if declines or silent else 0), 1 if loose else -1, 1 if aside else -1, *_lacks(words))

    # copy: words of the answer in the instruction and the other way round, in the same order
    out["copy"] = same_words(instruction or "", words)

    # language: function words of all words, script, and the parts one by one
    each = [points(p) for p in parts] if said else []
    out["other_language"] = foreign(want, sure, script, *spoken(each))
    return out, [masked_sentence(s) for s in open_ends], [masked_sentence(s) for s in closed]


@lru_cache(maxsize=1024)
def _code(v: tuple[int, ...]) -> str:
    return "".join("-0+"[x + 1] for x in v)


@lru_cache(maxsize=16_384)
def _copy_code(instruction: str, k: int) -> str:
    """The votes on a copy of the instruction that lacks the words k, k + 9, k + 18 and so on."""
    return _code(same_words(instruction, " ".join(w for i, w in enumerate(instruction.split()) if i % 9 != k)))


def broken_copies(row: int, instruction: str, said: str) -> tuple[str, str, str, str, str | None]:
    """What validates the cutoffs, of a sound answer: what its instruction asks and its words speak (for answers in another
    language), the votes on a copy of the instruction, and those on its words cut short with the open sentence, if any."""
    want, sure, script = _asked(instruction)[3:]
    asks = json.dumps((want, min(sure, 2), script))
    speaks = json.dumps(spoken([points(said)] if _WORDY.search(said) else []))
    piece = said[: max(2, int(len(said) * (0.3 + 0.6 * (row * 7919 % 100) / 100)))].rstrip(" .!?…。")
    if not _WORDY.search(piece):
        return asks, speaks, _copy_code(instruction, row % 9), "00", None
    torn, open_ends, _ = ends([piece], [sentences(piece)], False)
    return asks, speaks, _copy_code(instruction, row % 9), _code(torn), masked_sentence(open_ends[0]) if open_ends else None


_VOTES = "rowId bigint, " + ", ".join(f"{d} string" for d in MODELS) + ", open array<string>, closed array<string>, ground boolean, asks string, speaks string, copied string, torn string, piece string"


def _label_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for rid, ins, act, state, think, reason, fin, shape in zip(*(pdf[c].tolist() for c in ("rowId", "instruction", "acts", "state", "thinking", "reasoning", "final", "shape"))):
            parts = [p for p in (think, reason) if isinstance(p, str)]
            v, open_ends, closed = votes(ins if isinstance(ins, str) else None, bool(act), state, parts, bool(fin), shape)
            said = next((p for p in parts if p), None)
            ground = bool(act) and said is not None and isinstance(ins, str) and ins != ""
            rows.append((rid, *(_code(v[d]) for d in MODELS), open_ends, closed, ground, *(broken_copies(rid, ins, said) if ground else (None,) * 5)))
        yield pd.DataFrame(rows, columns=["rowId", *MODELS, "open", "closed", "ground", "asks", "speaks", "copied", "torn", "piece"])


def answers(decisions: DataFrame) -> DataFrame:
    """What the labelling functions read: rowId, instruction, acts, state (object, broken, none), thinking, reasoning,
    final (the thinking closes with an action's description), shape (o: the decision does not end with its bracket, q: its
    quotes do not pair up)."""
    v = F.try_parse_json("decision")
    d = decisions.select("rowId", F.get_json_object("prompt", "$.instruction").alias("instruction"), "decision", F.col("thinkingText").alias("thinking"), v.alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    state = F.when(is_object, "object").when(F.col("v").isNull() & ~is_blank(F.col("decision")), "broken").otherwise("none")
    named = ~is_blank(F.try_variant_get("v", "$.chosenDescribe", "string"))
    fin = F.regexp_extract("thinking", r"(?i)final\s*:\s*(.+)$", 1)
    closes = F.when(fin != "", ~F.coalesce(action_key(fin), F.lit("other")).startswith("other")).otherwise(False)
    text = F.rtrim(F.coalesce("decision", F.lit("")))
    shape = F.concat(F.when(F.endswith(text, F.lit("}")), "").otherwise("o"), F.when(F.pmod(F.length(text) - F.length(F.replace(F.replace(text, F.lit('\\"'), F.lit("__")), F.lit('"'), F.lit(""))), F.lit(2)) == 0, "").otherwise("q"))
    return d.select("rowId", "instruction", (is_object & named).alias("acts"), state.alias("state"), "thinking", F.try_variant_get("v", "$.reasoning", "string").alias("reasoning"), closes.alias("final"), shape.alias("shape"))


def complete_sentences(votes_df: DataFrame, least: int = 2) -> DataFrame:
    """Masked sentences that close with an end mark at least ``least`` times in the whole corpus."""
    return votes_df.select(F.explode("closed").alias("sentence")).groupBy("sentence").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("sentence")


#: Where expectation-maximization starts, the same for every labelling function of a defect: the rate of hits among
#: defective answers and of false alarms among sound ones. Wide on purpose: which function can be trusted is learnt from
#: how the votes of all rows agree. An abstention counts for neither.
HIT, ALARM = 0.75, 0.15
#: Number of labelling functions of every defect.
FUNCTIONS = {"empty": 3, "copy": 4, "refusal": 8, "other_language": 4, "torn_json": 3, "torn_words": 3}
START = {d: ((HIT, ALARM),) * n for d, n in FUNCTIONS.items()}
#: Pseudo-votes that hold each rate near its start, so that a few rows cannot turn a function's meaning around.
STRENGTH = 4.0


def em(patterns: dict[str, int], prior: float, start: tuple[tuple[float, float], ...], rounds: int = 60) -> dict[str, float]:
    """Posterior of the defect for every vote pattern, from the patterns' counts.

    Two-class model with independent labelling functions; an abstention says nothing, and a pattern of nothing but
    abstentions is no case. Expectation-maximization estimates the class share and each function's rates from all rows,
    smoothed by ``STRENGTH`` pseudo-votes at ``start``, so that few rows cannot turn a function's meaning around.
    """
    silent = {q for q in patterns if not q.strip("0")}
    patterns = {q: n for q, n in patterns.items() if q not in silent}
    if not patterns:
        return dict.fromkeys(silent, 0.0)
    k = len(next(iter(patterns)))
    total = sum(patterns.values())
    p = prior
    side = [({"+": hit, "-": 1 - hit}, {"+": alarm, "-": 1 - alarm}) for hit, alarm in start]  # defective, sound
    rate = [tuple(dict(y) for y in f) for f in side]
    post: dict[str, float] = {}
    for _ in range(rounds):
        for pat in patterns:
            a, b = math.log(p), math.log(1 - p)
            for i, x in enumerate(pat):
                if x != "0":
                    a += math.log(rate[i][0][x])
                    b += math.log(rate[i][1][x])
            post[pat] = 1 / (1 + math.exp(min(700, b - a)))
        mass = sum(n * post[q] for q, n in patterns.items())
        p = min(0.5, max(1e-6, (mass + prior * 10) / (total + 10)))
        for i in range(k):
            for y in (0, 1):
                got = {x: STRENGTH * side[i][y][x] for x in "-+"}
                for q, n in patterns.items():
                    if q[i] != "0":
                        got[q[i]] += n * (post[q] if y == 0 else 1 - post[q])
                n_all = sum(got.values())
                rate[i][y].update({x: max(1e-6, c / n_all) for x, c in got.items()})
    return post | dict.fromkeys(silent, 0.0)


#: No cutoff goes below this, whatever the labelled answers say.
LEAST_POSTERIOR = 0.25


def cutoff(post: dict[str, float], cases: dict[str, int], sound: dict[str, int], share: float) -> float:
    """The posterior from which on a pattern counts, validated on labelled answers: patterns of ``cases`` (answers with the
    defect) and of ``sound`` ones, weighted so that cases make up ``share``. The best F1 wins, of equals the cutoff
    nearest to one half; 0.5 where nothing is labelled."""
    bad, good = sum(cases.values()), sum(sound.values())
    if not bad or not good:
        return 0.5
    share = min(0.5, max(share, 1e-6))
    best, low, high, below = -1.0, 0.0, 1.0, 0.0
    for c in sorted(set(post.values())):
        hit = share * sum(n for q, n in cases.items() if post.get(q, 0.0) >= c) / bad
        wrong = (1 - share) * sum(n for q, n in sound.items() if post.get(q, 0.0) >= c) / good
        f1 = 2 * hit / (hit + wrong + share)
        if f1 > best + 1e-9:
            best, low, high = f1, below, c
        elif f1 > best - 1e-9 and high == below:
            high = c
        below = c
    # all cutoffs above low and up to high are equally good on the labelled answers; of these the nearest to one half
    return max(LEAST_POSTERIOR, high) if high < 0.5 else (0.5 if low < 0.5 else (low + high) / 2)


#: Shares of the defects at the start of expectation-maximization.
PRIOR = dict.fromkeys(MODELS, 0.05)
#: Refusals put into answers for validation; no pattern was written from them.
REFUSALS = [
    "I would prefer to sit this one out.", "I am not going to make that choice for you.", "Sorry, that is nothing I want to give advice on.", "I have to decline, as this is not what I am for.", "Please find somebody else to decide this.", "I won't take part in this game.",
    "Dabei möchte ich nicht helfen.", "Ich lehne es ab, hier eine Wahl zu treffen.", "No quiero elegir ninguna jugada.", "Prefiero no participar en este juego.", "Je ne souhaite pas choisir à votre place.", "Je préfère ne pas répondre.",
]


def _corpus(torn: str, really: str) -> Column:
    """The vote of the corpus on words that break off: whether an open sentence is never closed elsewhere."""
    return F.when(F.col(torn) == "00", "0").when(F.col(really), "+").otherwise("-")


def vote_table(decisions: DataFrame) -> tuple[DataFrame, dict[str, Counter[str]]]:
    """((rowId, ground, the vote pattern of every label model), patterns of broken answers by model with their counts).

    Every sound answer (``ground``: words, an action and an instruction) is broken in all known ways, where it is labelled:
    emptied, its words exchanged for each of ``REFUSALS`` and for the instruction without every ninth word, its words cut
    short, its JSON torn (three times inside quotes, once outside), and every instruction answered by every answer to
    instructions in other languages. Only counts go to the driver.
    """
    v = cut(answers(decisions).mapInPandas(_label_batches, _VOTES))
    known = complete_sentences(v)
    cut_off = v.filter("size(open) > 0").select("rowId", F.explode("open").alias("sentence")).join(known, "sentence", "left_anti").select("rowId").distinct().withColumn("really", F.lit(True))
    rows = v.join(cut_off, "rowId", "left")
    rows = cut(rows.select("rowId", "ground", *[F.concat(F.col(d), _corpus(d, "really")).alias(d) if d == "torn_words" else F.col(d) for d in MODELS]))

    good = v.filter("ground")
    pieces = good.groupBy("torn", F.col("piece").alias("sentence")).agg(F.count("*").alias("n"))
    pieces = pieces.join(known.withColumn("closed", F.lit(True)), "sentence", "left").withColumn("really", F.col("sentence").isNotNull() & F.col("closed").isNull())
    cases: dict[str, Counter[str]] = {d: Counter() for d in MODELS}
    for r in pieces.groupBy(F.concat("torn", _corpus("torn", "really")).alias("votes")).agg(F.sum("n").alias("n")).collect():
        cases["torn_words"][r["votes"]] += r["n"]
    for r in good.groupBy("copied").count().collect():
        cases["copy"][r["copied"]] += r["count"]
    tongues = [(json.loads(r["asks"]), json.loads(r["speaks"]), r["count"]) for r in good.groupBy("asks", "speaks").count().collect()]
    asked, spoke = Counter(), Counter()
    for asks, (whole, lead, hints, scripts), n in tongues:
        asked[tuple(asks)] += n
        spoke[asks[0], (whole, lead, tuple(hints), tuple(scripts))] += n
    for asks, n in asked.items():
        for (tongue, speaks), m in spoke.items():
            if asks[0] and tongue and asks[0] != tongue:
                cases["other_language"][_code(foreign(*asks, *speaks))] += n * m
    if n := sum(asked.values()):
        only = lambda model, *a, shape="": _code(votes(None, *a, False, shape)[0][model])
        cases["empty"][only("empty", False, "none", [])] += n
        for shape, times in (("oq", 3), ("o", 1)):
            cases["torn_json"][only("torn_json", False, "broken", [], shape=shape)] += times * n
        for text in REFUSALS:
            cases["refusal"][only("refusal", True, "object", [text])] += n
    return rows, cases


def defect_labels(decisions: DataFrame, prior: dict[str, float] = PRIOR, rounds: int = 60) -> DataFrame:
    """(rowId, defect, posterior): every defect of a row whose posterior reaches its cutoff; a row may have several.

    Vote patterns are counted over all rows, broken answers over all sound ones; only the counts (at most 3 to the power of
    the functions of a model) go to the driver. ``rowId`` is unique and not null. Nulls and empty texts are no words; an
    empty table gives an empty result.
    """
    v, broken = vote_table(decisions)
    counts = v.select("ground", F.explode(F.array(*[F.struct(F.lit(d).alias("model"), F.col(d).alias("votes")) for d in MODELS])).alias("x")).groupBy("x.model", "x.votes").agg(F.count("*").alias("n"), F.count_if("ground").alias("sound")).collect()
    found = None
    for d, defect in MODELS.items():
        pats = {r["votes"]: r["n"] for r in counts if r["model"] == d}
        sound = {r["votes"]: r["sound"] for r in counts if r["model"] == d and r["sound"]}
        post = em(dict.fromkeys(broken[d], 0) | pats, prior[d], START[d], rounds)
        share = sum(n * post[q] for q, n in pats.items()) / max(1, sum(pats.values()))
        least = cutoff(post, broken[d], sound, share)
        keep = {q: p for q, p in post.items() if p >= least}
        if not keep:
            continue
        m = F.create_map(*[F.lit(x) for kv in keep.items() for x in kv])
        part = v.filter(F.col(d).isin(*keep)).select("rowId", F.lit(defect).alias("defect"), m[F.col(d)].alias("posterior"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return v.select("rowId", F.lit("").alias("defect"), F.lit(0.0).alias("posterior")).limit(0)
    return found.groupBy("rowId", "defect").agg(F.max("posterior").alias("posterior"))


def rank_of(defect: Column) -> Column:
    out = F.lit(len(DEFECTS))
    for i, d in enumerate(DEFECTS):
        out = F.when(defect == d, i).otherwise(out)
    return out


def broken_pairs(decisions: DataFrame) -> DataFrame:
    """(rowId, defect): at most one defect per row, in the order of ``DEFECTS``."""
    labels = defect_labels(decisions)
    best = labels.groupBy("rowId").agg(F.min_by("defect", rank_of(F.col("defect"))).alias("defect"))
    return best.select("rowId", "defect")
