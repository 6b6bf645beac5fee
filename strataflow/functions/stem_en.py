"""English stems by the published Porter2 rules, and the stop words that full-text search leaves out."""

from __future__ import annotations

import re
from functools import cache

# Stop words of English full-text search.
STOP_WORDS = set("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now
""".split())

# Words with stems of their own.
SPECIAL = dict(x.split(":") for x in """
skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news
howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes
""".split())
# Words that stay once plurals are off.
STAY = set("inning outing canning herring earring proceed exceed succeed".split())
# Endings of the later steps and what takes their place, longest first.
STEP2 = [x.split(":") for x in """
ization:ize ational:ate fulness:ful ousness:ous iveness:ive tional:tion biliti:ble lessli:less entli:ent ation:ate alism:al aliti:al
ousli:ous iviti:ive fulli:ful enci:ence anci:ance abli:able izer:ize ator:ate alli:al bli:ble ogi:og li:
""".split()]
STEP3 = [x.split(":") for x in "ational:ate tional:tion alize:al icate:ic iciti:ic ative: ical:ic ness: ful:".split()]
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

VOWEL = "aeiouy"
DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
REGION = re.compile(rf"[{VOWEL}][^{VOWEL}]")
SHORT_END = re.compile(rf"(?:[^{VOWEL}][{VOWEL}][^{VOWEL}wxY]|^[{VOWEL}][^{VOWEL}])$")


def _regions(word: str) -> tuple[int, int]:
    head = re.match("gener|commun|arsen", word)
    found = head or REGION.search(word)
    r1 = found.end() if found else len(word)
    again = REGION.search(word, r1)
    return r1, again.end() if again else len(word)


def _has_vowel(part: str) -> bool:
    return any(c in VOWEL for c in part)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        return w[:-1]
    return w


def _past(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), None)
    if end is None or not _has_vowel(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if DOUBLE.search(w):
        return w[:-1]
    return w + "e" if r1 >= len(w) and SHORT_END.search(w) else w


def _replaced(w: str, r1: int, r2: int, table: list[list[str]]) -> str:
    for end, new in table:
        if w.endswith(end):
            at = len(w) - len(end)
            fits = at >= (r2 if end == "ative" else r1)
            fits = fits and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt"))
            return w[:at] + new if fits else w
    return w


@cache
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    w = word.lower()
    if len(w) <= 2 or w in SPECIAL:
        return SPECIAL.get(w, w)
    w = re.sub(rf"(?<=[{VOWEL}])y|^y", "Y", w.lstrip("'"))
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    w = _plural(w)
    if w in STAY:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"
    w = _replaced(w, r1, r2, STEP2)
    w = _replaced(w, r1, r2, STEP3)
    for end in STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stem_words(texts: list[str | None]) -> list[list[str]]:
    """The lexemes of each text: stems of its words of letters and digits, without stop words, in order."""
    words = ([w for w in re.findall(r"[^\W_]+", (t or "").lower()) if w not in STOP_WORDS] for t in texts)
    return [[stem(w) for w in some] for some in words]


def lexeme(word: str) -> str | None:
    """The stem of a word; null for a stop word."""
    return None if word.lower() in STOP_WORDS else stem(word)
