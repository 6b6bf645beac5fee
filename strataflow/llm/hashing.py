"""Hashes of all words of texts and of runs of words, by whole arrays."""

from __future__ import annotations

from itertools import pairwise

import numpy as np

SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Text whose words are hashed at a time.
HASH_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """Hashes of all words of a text: a polynomial of each word's bytes, from one running sum over the text."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                one = np.ones(1, np.uint64)
                self.power, self.inverse = (np.cumprod(np.concatenate((one, np.full(n, b, np.uint64)))) for b in (BASE, pow(int(BASE), -1, 1 << 64)))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts end to end, and the number of words of each."""
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.grow(len(raw))
        space = SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)])
            before = np.where(start > 0, total[start - 1], np.uint64(0))
            value = mixed((total[end - 1] - before) * self.inverse[start])
        ends = np.cumsum([len(x) + 1 for x in texts])
        return value, np.diff(np.searchsorted(start, ends), prepend=0)


def run_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, from the words' hashes."""
    out, have, base = w.copy(), 1, BASE
    power = {1: base}
    while have * 2 <= n:
        power[have * 2] = power[have] * power[have]
        out = out[:-have] * power[have] + out[have:] if len(out) > have else out[:0]
        have *= 2
    if have < n:  # a longer run from two that overlap
        more = n - have
        out = out[:-more] * np.uint64(0xC2B2AE3D27D4EB4F) + (out[more:] ^ (out[more:] >> np.uint64(31))) if len(out) > more else out[:0]
    return mixed(out)


def pieces(texts: list[bytes], size: int = HASH_BYTES) -> list[list[bytes]]:
    """Texts in runs of about `size` bytes; a longer text is a run of its own."""
    ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // size, prepend=-1)).tolist()
    return [texts[a:b] for a, b in pairwise([*cuts, len(texts)])]


class Shingles:
    """Hashes of each run of n words of texts, A-Z in lower case; of all words of a text if they are fewer."""

    def __init__(self, n: int):
        self.n, self.words = n, WordHasher()

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The distinct shingles of each text, ascending; none for a text without words."""
        out = []
        for some in pieces([(t or b"").lower() for t in texts]):  # for bytes, A-Z alone
            value, sizes = self.words(some)
            with np.errstate(over="ignore"):
                runs, at = run_hashes(value, self.n), 0
                for size in sizes.tolist():
                    if size >= self.n:
                        out.append(np.unique(runs[at : at + size - self.n + 1]))
                    else:
                        out.append(run_hashes(value[at : at + size], size) if size else value[:0])
                    at += size
        return out
