"""Spelling variants of a corpus: words one inserted, deleted or replaced letter apart, grouped without listing pairs.

A run is a maximal stretch of A-Z, a-z and U+00C0 to U+00FF, with A-Z alone lower-cased. One run in `noise`, by a checksum of its
document and itself, loses a letter, as a slip of the keyboard would. Words are the distinct results of `min_letters` or more that
occur `min_count` times or more; they are numbered from 0 by falling count, then by code points, so that of two words the one with
the smaller number is the better form.

A word joins one wildcard group for each of its letters (the position, what stands before, what stands behind): the others of a
group are its replacements. It also stands under itself, and under each distinct result of deleting one letter: whoever stands
under a word by deletion is one letter longer than it. Each group yields its size and its two best words; every member learns
from these how many near words the group has for it and which is best. A group has no more members than the alphabet has letters
(times the positions, for deletions), and no pair is ever a row.

Words over `LONG` letters stand under digests of what is before and behind the letter (a polynomial modulo 2^127 - 1), so that a
run of a million letters makes a million short keys.

Defined cases: a null text has no runs; a null doc_id counts as an empty one in the checksum; repeated rows count each; of equal
counts the word that is smaller in code points is better; an empty table, and one without words, gives no rows. Other columns
aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MIN_LETTERS, MIN_COUNT, NOISE = 5, 3, 97
#: Distinct words that a task holds before it hands its counts on, and keys of an Arrow batch.
HELD, KEYS = 100_000, 50_000
#: Letters above which a word's keys are digests.
LONG = 64
BASE, PRIME = 0x9E3779B97F4A7C15F39CC0605CEDC835, (1 << 127) - 1
#: Latin-1 bytes of letters as they are, A-Z lower-cased, all others as spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _counter(min_letters: int, noise: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # characters beyond Latin-1 become question marks, which part runs as well
                for run, n in Counter(text.encode("latin-1", "replace").translate(FOLD).split()).items():
                    if len(run) < min_letters:
                        continue
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % noise == 0:
                        gone = h % len(run)
                        run = run[:gone] + run[gone + 1 :]
                        if len(run) < min_letters:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield handed()
        yield handed()

    return count


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """The words, staged: wid (0 is the most frequent), word, n. Tasks count by themselves before words are shuffled."""
    C.ready_python(docs.sparkSession)
    counts = docs.select("doc_id", "text").mapInArrow(_counter(min_letters, noise), "word string, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).withColumn("fall", -F.col("n"))
    ranges = C.ordered_chunks(counts.withColumn("one", F.lit(1).cast("long")), F.struct("fall", "word"), "words")
    return C.stage(C.running_total(ranges, [], "__pid", ["fall", "word"], "one", "wid").select("wid", "word", "n"), "vocabulary")


def long_keys(word: str) -> tuple[list[str], list[str], str]:
    """Keys of a long word: its wildcards, its distinct deletions, and itself."""
    size, head = len(word), [0]
    for c in word:
        head.append((head[-1] * BASE + ord(c)) % PRIME)
    whole, power, wild, less = head[-1], 1, [], []
    for i in range(size - 1, -1, -1):
        tail = (whole - head[i + 1] * power) % PRIME
        wild.append(f"*{size}:{i}:{head[i]:x}:{tail:x}")
        if i == 0 or word[i] != word[i - 1]:  # letters of a run of equals give one result
            less.append(f"#{size - 1}:{(head[i] * power + tail) % PRIME:x}" if size - 1 > LONG else word[:i] + word[i + 1 :])
        power = power * BASE % PRIME
    return wild, less, f"#{size}:{whole:x}"


def keys(word: str) -> tuple[list[str], list[str], str]:
    """A word's wildcards, its distinct deletions, and itself, as keys."""
    if len(word) > LONG:
        return long_keys(word)
    spots = range(len(word))
    return [f"{word[:i]}*{word[i + 1 :]}" for i in spots], list({word[:i] + word[i + 1 :] for i in spots}), word


def _keyed(min_letters: int):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[str] = []
        role: list[int] = []
        wids: list[int] = []

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(role, pa.int32()), pa.array(wids, pa.int64())], ["key", "role", "wid"])
            found.clear(), role.clear(), wids.clear()
            return made

        for batch in batches:
            for wid, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wild, less, own = keys(word)
                less = less if len(word) > min_letters else []  # shorter results can't be words
                found += wild + [own] + less
                role += [0] * (len(wild) + 1) + [1] * len(less)
                wids += [wid] * (len(wild) + 1 + len(less))
                if len(found) >= KEYS:
                    yield handed()
        yield handed()

    return spread


def near(words: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """For every word that has any: wid, n_near (the number of near words) and best (the wid of the best of them)."""
    C.ready_python(words.sparkSession)
    # numbers fall to ranges of the vocabulary, so words are dealt anew before they are spread
    dealt = words.select("wid", "word").repartition(C.shuffle_width(words.sparkSession), "wid")
    rows = dealt.mapInArrow(_keyed(min_letters), "key string, role int, wid long")
    group = Window.partitionBy("key").orderBy("role", "wid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.select(
        "wid", "role", F.count("*").over(group).alias("size"), F.first("role").over(group).alias("head"), F.first("wid").over(group).alias("best"), F.nth_value("wid", 2).over(group).alias("second")
    )
    # a group that deletions alone lead to isn't that of a word
    told = told.where("size > 1 and head = 0")
    each = told.select("wid", F.expr("if(role = 0, size - 1, 1L)").alias("n"), F.expr("if(wid = best, second, best)").alias("best"))
    return each.groupBy("wid").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(wid, root) for every word with a form, given (wid, form): each round doubles the distance that a link spans, and counts at
    least double along a link, so that rounds are few."""
    now = C.stage(links.select("wid", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("wid").alias("__wid"), F.col("root").alias("__up"))
        ahead = now.join(up, F.col("root") == F.col("__wid"), "left")
        after = C.stage(ahead.select("wid", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("moved")), "roots")
        C.discard(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.select("wid", "root")


def variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """Per word: word, n, n_near, form (its best near word if that occurs twice as often or more, else null), form_n, root (where the
    forms of forms end; the word itself without a form)."""
    words = vocabulary(docs, min_letters, min_count, noise)
    found = near(words, min_letters)
    best = words.select(F.col("wid").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    rows = words.join(found, "wid", "left").join(best, "best", "left")
    fits = F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False))
    rows = rows.select("wid", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(fits, F.col(c)).alias(c) for c in ("best", "form", "form_n")])
    rows = C.stage(rows, "variants")
    ends = roots(rows.where("best is not null").select("wid", F.col("best").alias("form")))
    named = ends.join(words.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root").select("wid", "root_word")
    out = rows.join(named, "wid", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
