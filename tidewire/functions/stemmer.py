"""The English stemmer of the Snowball project (also called Porter 2), and the usual English stop words.

It works on one word and is meant for the distinct words of many texts."""

from __future__ import annotations

import re

#: English stop words, as full-text configurations ship them.
STOP_WORDS = frozenset("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
""".split())

#: Fixed values of the algorithm: words with stems of their own, and words that are left alone after step 1a.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
LEFT_ALONE = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Fixed values of steps 2 to 4: endings and what stands in their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

V, C = "[aeiouy]", "[^aeiouy]"
REGION = re.compile(f"{V}{C}")
FIRST_REGION = re.compile("gener|commun|arsen")
CONSONANT_Y = re.compile("(?:^|(?<=[aeiouy]))y")
VOWEL = re.compile(V)
SHORT_END = re.compile(f"(?:{C}{V}[^aeiouywxY]|^{V}{C})$")


def _longest_first(endings) -> tuple[str, ...]:
    return tuple(sorted(endings, key=len, reverse=True))


GENITIVES, PLURALS, PASTS = ("'s'", "'s", "'"), _longest_first(("sses", "ied", "ies", "us", "ss", "s")), ("eedly", "ingly", "edly", "eed", "ing", "ed")
SECONDS, THIRDS, FOURTHS = map(_longest_first, (SECOND, THIRD, FOURTH))


def _ending(word: str, endings: tuple[str, ...]) -> str | None:
    """The longest of the endings that the word has; they are given longest first. Most words have none."""
    return next(filter(word.endswith, endings)) if word.endswith(endings) else None


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and the same again."""

    def after(at: int) -> int:
        m = REGION.search(word, at)
        return m.end() if m else len(word)

    first = FIRST_REGION.match(word)
    r1 = first.end() if first else after(0)
    return r1, after(r1)


def _past_and_gerund(w: str, r1: int) -> str:
    e = _ending(w, PASTS)
    if e in ("eed", "eedly"):
        return w[: len(w) - len(e)] + "ee" if len(w) - len(e) >= r1 else w
    if e is None or not VOWEL.search(w[: len(w) - len(e)]):
        return w
    w = w[: len(w) - len(e)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return w[:-1]
    return w + "e" if r1 >= len(w) and SHORT_END.search(w) else w


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word in INVARIANT:
        return word
    w = word.removeprefix("'")
    w = CONSONANT_Y.sub("Y", w) if "y" in w else w
    r1, r2 = _regions(w)

    e = _ending(w, GENITIVES)
    w = w[: len(w) - len(e)] if e else w

    e = _ending(w, PLURALS)
    if e == "sses":
        w = w[:-2]
    elif e in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif e == "s" and VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in LEFT_ALONE:
        return w

    w = _past_and_gerund(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    e = _ending(w, SECONDS)
    if e and len(w) - len(e) >= r1:
        before = w[: len(w) - len(e)]
        if (e != "ogi" or before.endswith("l")) and (e != "li" or before[-1:] in tuple("cdeghkmnrt")):
            w = before + SECOND[e]
    e = _ending(w, THIRDS)
    if e and len(w) - len(e) >= r1 and (e != "ative" or len(w) - len(e) >= r2):
        w = w[: len(w) - len(e)] + THIRD[e]
    e = _ending(w, FOURTHS)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: len(w) - len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexeme(word: str) -> str | None:
    """The stem; none of a stop word."""
    return None if word in STOP_WORDS else stem(word)
