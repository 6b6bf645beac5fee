"""Stemmer for Russian words, on distinct words through a pandas function.

Endings are tried in a fixed order and the first that fits wins. Regions are counted in bytes of UTF-8: the first begins after the
first vowel, and each of the next two after the first pair of neighbouring letters that aren't vowels.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lists of endings, in the order in which they are tried, and the letters that count as vowels.
GERUND = "в вши вшись ив ивши ившись ыв ывши ывшись".split()
REFLEXIVE = "ся сь".split()
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
VERB = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно ила ыла ена ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "иями ями ами иях ией иям ием ов ев ях ах ей ой ий ям ем ам ом ию ью ия ья ие ье еи ии ю я е и й о у ы ь а".split()
SUPERLATIVE = "ейше ейш".split()
DERIVED = "ость ост".split()
VOWELS = "аеиоыэюяпмнaeiouy"

#: A letter of two bytes or one.
LETTER = re.compile(rb"[\x80-\xff].?|.", re.DOTALL)
_VOWELS = {c.encode() for c in VOWELS}
_CAPITALS = {c: c + 32 for c in (*range(ord("A"), ord("Z") + 1), *range(ord("А"), ord("Я") + 1))} | {ord("Ё"): "е"}


def lower(word: str) -> str:
    """Lower case; ё in capitals becomes е."""
    return word.translate(_CAPITALS)


def regions(word: str) -> tuple[int, int]:
    """Byte offsets where the first and the last region begin: 0 and the end, for a word without vowels."""
    letters = LETTER.findall(word.encode())
    shape = "".join("v" if x in _VOWELS else "c" for x in letters)
    begin = shape.find("v") + 1
    if not begin:
        return 0, sum(map(len, letters))

    def after_pair(at: int, lone: bool = False) -> int:
        if lone and shape.startswith("c", at):
            return at + 1
        found = shape.find("cc", at)
        return len(shape) if found < 0 else found + 2

    # after the end of a pair, one more letter that is no vowel makes the next pair
    last = after_pair(after_pair(begin), lone=True)
    return sum(map(len, letters[:begin])), sum(map(len, letters[:last]))


def _without(word: str, begin: int, endings: list[str]) -> str | None:
    """The word without the first of the endings that it has from byte `begin` on; null if it has none."""
    room = len(word.encode()) - begin
    return next((word[: -len(e)] for e in endings if word.endswith(e) and len(e.encode()) <= room), None)


def stem(word: str) -> str:
    word = lower(word)
    if len(word.encode()) < 4:
        return word
    first, last = regions(word)

    def drop(word: str, *lists: list[str], begin: int = first) -> str:
        found = (_without(word, begin, x) for x in lists)
        return next((x for x in found if x is not None), word)

    cut = _without(word, first, GERUND)
    word = cut if cut is not None else drop(drop(word, REFLEXIVE), ADJECTIVE, VERB, NOUN)
    word = drop(word, ["и"])
    word = drop(drop(word, DERIVED, begin=max(first, last)), SUPERLATIVE)
    word = word[:-1] if word.endswith("нн") else word
    return drop(word, ["ь"])


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """Distinct terms with their stems."""
    f = F.pandas_udf(lambda s: s.map(stem, na_action="ignore"), "string")
    return terms.select(column).distinct().withColumn("stem", f(column))
