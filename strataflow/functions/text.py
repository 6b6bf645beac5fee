"""Text functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delimiters between index terms, and between the terms of a ranked query (a shorter list).
INDEX_DELIMITERS = " \t\n\r.,;:!?()[]{}\"'<>/|@#$%^&*+=`~\\"
QUERY_DELIMITERS = " \t\n\r.,;:!?()[]{}\"'"
TOKEN = "[A-Za-z0-9\u0400-\u047f'-]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def char_class(chars: str) -> str:
    """A pattern's class of the characters."""
    return "[" + "".join("\\" + c if c in "\\]^-[&~" else {"\t": "\\t", "\n": "\\n", "\r": "\\r"}.get(c, c) for c in chars) + "]"


_DOWN = str.maketrans(UPPER, LOWER)


def ascii_lower(text: str) -> str:
    return text.translate(_DOWN)


def tokenize(text: Column, min_chars: int = 1) -> Column:
    """Tokens: runs of letters, digits, hyphens and apostrophes, trimmed of the last two, in lower case."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), lambda t: F.lower(F.btrim(t, F.lit("-'"))))
    return F.filter(found, lambda t: F.length(t) >= max(1, min_chars))


def index_terms(text: Column) -> Column:
    """Index terms: split at delimiters, longer than two bytes, ASCII in lower case."""
    parts = F.split(F.translate(text, UPPER, LOWER), char_class(INDEX_DELIMITERS) + "+")
    return F.filter(parts, lambda t: F.octet_length(t) > 2)


def query_terms(text: str) -> list[str]:
    """Terms of a ranked query: cut at its delimiters, longer than two bytes."""
    return [t for t in re.split(char_class(QUERY_DELIMITERS) + "+", text) if len(t.encode()) > 2]


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Trigrams in common over all trigrams of two texts."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
