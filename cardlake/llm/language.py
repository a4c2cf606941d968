"""Language of a short text by script and function words. Pure Python, for use inside Arrow batches."""

from __future__ import annotations

import re
from collections import Counter

#: Fixed function words per language; a word in several lists counts for each of them.
FUNCTION_WORDS = {
    "en": "the and of to is in that it for on with as are this be at or not you your i my one from by have no before after but so if which what its would could will can then than there".split(),
    "de": "der die das und ist nicht ein eine einen zu den dem des mit auf für von ich du sie er es noch nach wenn dass aber oder kein im wird nur sich bis weil also hat haben seit unter dich".split(),
    "es": "el los las una y es no que de la en con por para se su al del más como pero si o este esta ya todavía hasta porque hay sin cuál otra puedo mi tu lo le son muy solamente".split(),
    "fr": "le les des une et est ne pas que qui de la en du dans pour sur avec ce cette il je tu n'est au aux plus mais ou si donc encore car après rien sont tant vaut mieux choisis y".split(),
    "it": "il gli della di che è non una e per con su sono ma come se dal alla delle nella questo questa ancora quindi perché finché né più mio ho al nessun soltanto prima dopo".split(),
    "pt": "o os as um uma e é não que de da do em com por para se no na dos das mais mas como até ainda pois já ao nem há sem isso esta este apenas nenhum minha saia você".split(),
}
_WHERE: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _WHERE[_w] = (*_WHERE.get(_w, ()), _lang)
#: Letters that only one of the languages uses, worth as much as a word.
LETTERS = {"ß": "de", "ä": "de", "ö": "de", "ñ": "es", "¿": "es", "¡": "es", "ã": "pt", "õ": "pt", "œ": "fr", "ù": "fr"}
SCRIPTS = [
    ("ja", re.compile("[぀-ヿ]")),
    ("ko", re.compile("[가-힣]")),
    ("ru", re.compile("[Ѐ-ӿ]")),
    ("el", re.compile("[Ͱ-Ͽ]")),
    ("ar", re.compile("[؀-ۿ]")),
    ("he", re.compile("[֐-׿]")),
    ("hi", re.compile("[ऀ-ॿ]")),
    ("th", re.compile("[฀-๿]")),
    ("zh", re.compile("[一-鿿]")),
]
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A character outside Latin, punctuation and symbols: only then the scripts are looked at one by one.
_EXOTIC = re.compile("[^\u0000-ͯ -⟿︀-️]")


def points(text: str) -> tuple[Counter[str], str]:
    """(points per language, script). A text of another script gives that language a point a character."""
    if _EXOTIC.search(text):
        for name, pattern in SCRIPTS:
            n = len(pattern.findall(text))
            if n >= 3 and n * 3 > sum(ch.isalpha() for ch in text):
                return Counter({name: n}), name
    got: Counter[str] = Counter()
    low = text.lower()
    for w in _WORD.findall(low):
        langs = _WHERE.get(w)
        if langs:
            for lang in langs:
                got[lang] += 1
        elif "'" in w or "’" in w:
            w = w.replace("’", "'")
            for lang in _WHERE.get(w, ()):
                got[lang] += 1
            if w not in _WHERE and w.partition("'")[0] in ("l", "d", "n", "j", "qu", "c", "s", "t", "m"):
                got["fr"] += 1
    if not low.isascii():
        for ch, lang in LETTERS.items():
            if ch in low:
                got[lang] += low.count(ch)
    return got, "latin"


def decide(got: Counter[str]) -> tuple[str | None, int]:
    """(language, lead over the runner-up in points); None and 0 when nothing speaks for one language."""
    top = got.most_common(2)
    if not top:
        return None, 0
    lead = top[0][1] - (top[1][1] if len(top) > 1 else 0)
    return (top[0][0] if lead > 0 else None), lead


def guess(text: str) -> tuple[str | None, int, str]:
    """(language, lead over the runner-up in points, script)."""
    got, script = points(text)
    return (*decide(got), script)
