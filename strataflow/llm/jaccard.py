"""Links between texts whose sets of word runs are alike: all pairs with a Jaccard similarity of SIMILARITY or more, exactly.

In an order of all shingles, two sets that are so alike share k of the first n - ceil(SIMILARITY * n) + k shingles of each, for the
k of the smaller set. k is a tenth of a set, so a passage that two texts share, or a chance, rarely makes a pair of them. Pairs are counted
over the shingles that up to SHARED sets have in front; the sets that share one which more have are chained without being counted.
Connected components of chains and counted pairs hold every pair that counts, and each component's texts are compared in full. Any
order gives the same pairs. Shingles that are frequent in a sample come last, so that passages which many texts share chain few of them.

Components with more than GROUP_LIMIT shingles are cut into chunks, and every two chunks are compared as a group of their own.

Defined cases: texts of fewer than SHINGLE words have all their words as one shingle; null and blank texts have none and no links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components
from .hashing import Shingles

SHINGLE = 5
SIMILARITY = 0.8
#: Shingles of texts that are compared as one group, about; what a task holds is bounded by them.
GROUP_LIMIT = 2_000_000
#: Most sets with the same shingle in front whose pairs are counted, and rows that a task gathers before it looks for pairs.
SHARED, GATHER = 64, 50_000
#: Texts that show which shingles are frequent, at least, and their share of all texts, at least: a shingle that more than SHARED sets have
#: must show in the sample however many texts there are, or else chance alone chains sets without a count.
SAMPLE, SAMPLE_SHARE = 64_000, 0.25
#: Texts of a larger sample that must have a shingle to make it a frequent one, at most; SHARED times SAMPLE_SHARE is well above it.
LEAST = 6
#: Rounds in which the shingles in front are shuffled, at most, and sets for each: only one round's share is on the disks at a time.
ROUNDS, ROUND_SETS = 4, 50_000
#: Bits of a shingle that say where it is counted, and shingles that a task gathers before it deals them out.
BUCKET_BITS, LISTED = 10, 1_000_000
SLACK = 1e-9


def frequent(docs: DataFrame, shingle: int, sample: int = SAMPLE, share: float = SAMPLE_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """The first 32 bits of shingles that several texts of a sample have, ascending, and how many have them. The bits are shuffled as
    arrays, by their first BUCKET_BITS; the few shingles that agree in all 32 count as one, which changes the order alone."""
    texts = max(docs.count(), 1)
    taken = min(1.0, max(sample / texts, share))
    least = min(max(2, round(2 * taken * texts / sample)), LEAST)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt() -> pa.RecordBatch:
            own = np.sort(np.concatenate(held))
            ends = np.searchsorted(own, np.arange(1, 1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(32 - BUCKET_BITS))
            lists = [(i, x.astype("<u4").tobytes()) for i, x in enumerate(np.split(own, ends)) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in lists], pa.int32()), pa.array([x for _, x in lists], pa.binary())], ["bucket", "own"])

        shingles, held = Shingles(shingle), []
        for batch in batches:
            held += [x >> np.uint64(32) for x in shingles(batch.column(0).to_pylist())]
            if sum(map(len, held)) >= LISTED:
                yield dealt()
                held = []
        if held:
            yield dealt()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, x) for batch in batches for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, own in itertools.groupby(rows, lambda r: r[0]):
            h, n = np.unique(np.frombuffer(b"".join(x for _, x in own), "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x[n >= least].astype(np.int64)) for x in (h, n)], ["h", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text"))
    rows = rows.sample(taken, seed=1)
    lists = rows.mapInArrow(listed, "bucket int, own binary").repartition(C.shuffle_width(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    found = lists.mapInArrow(counted, "h long, n long").toArrow()
    h, n = found.column("h").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(own: np.ndarray, known: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set; a set that is alike has at least `shared` of the smaller one's size in common with them in front."""
    if len(known):
        bits = own >> np.uint64(32)
        at = np.minimum(np.searchsorted(known, bits), len(known) - 1)
        own = own[np.lexsort((own, np.where(known[at] == bits, counts[at], 0)))]
    return own[: len(own) - int(np.ceil(similarity * len(own) - SLACK)) + int(shared(len(own)))]


def shared(n):
    """How many of their first shingles two sets that are alike have in common, the smaller of n shingles."""
    return np.maximum(1, n // 10)


def set_table(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Stage, for each text that has words: doc_id, text_hash, key (hash of its set), n (size of the set) and the prefix."""
    import xxhash

    C.ready_python(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, shingle))
    C.release(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        for batch in batches:
            sets = shingles(batch.column(2).to_pylist())
            some = pa.array([len(x) > 0 for x in sets])
            sets = [x for x in sets if len(x)]
            keys = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64)
            heads = [prefix(x, *known.value, similarity) for x in sets]
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(some), batch.column(1).filter(some), pa.array(keys.view(np.int64)), pa.array([len(x) for x in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                ["doc_id", "text_hash", "key", "n", "prefix"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return C.stage(rows.mapInArrow(made, "doc_id long, text_hash long, key long, n int, prefix array<long>"), "shingle-sets")


def group_pairs(h: np.ndarray, n: np.ndarray, key: np.ndarray, similarity: float, limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, need) from rows by (h, n, key), whole groups of h: in groups of up to `limit` rows all pairs close in size, with the count that
    they need; in larger ones neighbours, which need none."""
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.concatenate((first, [len(h)])))
    large = np.repeat(size > limit, size)
    for d in range(1, max(2, min(limit, int(size.max(initial=0))))):
        near = (h[d:] == h[:-d]) & (n[:-d] >= similarity * n[d:] - SLACK)
        near &= ~large[d:] if d > 1 else True
        at = np.flatnonzero(near)
        yield key[at], key[at + d], np.where(large[at], 0, shared(n[at]))


def front_pairs(sets: DataFrame, similarity: float, limit: int = SHARED, gather: int = GATHER) -> list[DataFrame]:
    """Stage (a, b, need) of keys of sets for each shingle that both have in front, a table for each round of shingles. Rows of equal sets
    are made one where they meet."""
    spark = sets.sparkSession

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(*rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for found in group_pairs(*rows, similarity, limit):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "need"])

        held, rows, chain = [], 0, None  # chain: the last row of a group that is too large to hold
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
                rows += batch.num_rows
            if not rows or batch is not None and rows < gather:
                continue
            h, n, key = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])))
            h, n, key = h[new], n[new], key[new]
            if chain is not None:
                more = int(np.searchsorted(h, chain[0], "right"))  # rows of that group come first
                ends_n, ends_key = np.concatenate(([chain[1]], n[:more])), np.concatenate(([chain[2]], key[:more]))
                near = np.flatnonzero(ends_n[:-1] >= similarity * ends_n[1:] - SLACK)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ends_key[near], ends_key[near + 1], 0 * near)], ["a", "b", "need"])
                chain = (chain[0], ends_n[-1], ends_key[-1]) if more == len(h) else None
                h, n, key = h[more:], n[more:], key[more:]
            end = len(h) if batch is None or not len(h) else int(np.searchsorted(h, h[-1], "left"))
            if len(h) - end > limit:
                end, chain = len(h), (h[-1], n[-1], key[-1])
            yield from pairs(h[:end], n[:end], key[:end])
            held, rows = [[h[end:], n[end:], key[end:]]], len(h) - end

    rounds, staged = min(ROUNDS, 1 + sets.count() // ROUND_SETS), []
    for i in range(rounds):
        own = F.filter("prefix", lambda h: F.pmod(h, F.lit(rounds)) == i)  # noqa: B023
        rows = sets.select(F.explode(own if rounds > 1 else "prefix").alias("h"), "n", "key")
        rows = rows.repartition(C.shuffle_width(spark) * 2, "h").sortWithinPartitions("h", "n", "key")
        staged.append(C.stage(rows.mapInArrow(chained, "a long, b long, need long").where("a <> b"), "front-pairs"))
        del rows
        C.release(spark)
    return staged


def counted(found: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) that share as many shingles in front as they need."""
    each = reduce(DataFrame.union, found).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need"))
    return each.where("n >= need").select("a", "b")


def chains(sets: DataFrame, similarity: float, limit: int = SHARED, gather: int = GATHER) -> DataFrame:
    """Pairs (a, b) of keys whose connected components hold all pairs of sets that are alike."""
    return counted(front_pairs(sets, similarity, limit, gather))


def alike(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Places of sets that are alike, enough of them to connect all that are; sets come by size. Takes the sets out of the list as
    it numbers their shingles, so that both forms aren't held at once."""
    sizes = np.array([len(x) for x in sets])
    begin = np.concatenate(([0], np.cumsum(sizes)))
    every = np.concatenate(sets)
    every.sort()
    fresh = np.ones(len(every), bool)
    np.not_equal(every[1:], every[:-1], out=fresh[1:])
    words = every[fresh]
    del every, fresh
    flat = np.empty(begin[-1], np.int32)
    for i in range(len(sets)):
        flat[begin[i] : begin[i + 1]] = np.searchsorted(words, sets[i])
        sets[i] = None
    part, has = np.arange(len(sizes)), np.zeros(len(words), bool)
    del words
    for i in range(len(sizes) - 1):
        end = int(np.searchsorted(sizes, sizes[i] / similarity + SLACK * sizes[i], "right"))
        if end <= i + 1 or (part[i + 1 : end] == part[i]).all():
            continue
        has[flat[begin[i] : begin[i + 1]]] = True
        both = np.add.reduceat(has[flat[begin[i + 1] : begin[end]]].astype(np.int32), begin[i + 1 : end] - begin[i + 1])
        has[flat[begin[i] : begin[i + 1]]] = False
        near = both >= similarity * (sizes[i] + sizes[i + 1 : end] - both) - SLACK
        for j in np.flatnonzero(near & (part[i + 1 : end] != part[i])) + i + 1:
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                yield i, int(j)


def links(docs: DataFrame, prints: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Pairs (a, b) of fingerprints of texts that are alike, enough to connect all that are; `prints` has text_hash and code."""
    spark = docs.sparkSession
    sets = set_table(docs, shingle, similarity)
    codes = prints.select("text_hash", "code").distinct()
    named = C.stage(sets.groupBy("text_hash", "key", "n").agg(F.min("doc_id").alias("doc_id")).join(codes, "text_hash"), "named-sets")
    first = named.groupBy("key").agg(F.min(F.struct("code", "text_hash", "doc_id", "n")).alias("f")).select("key", "f.*")
    first = C.stage(first, "sets")
    same = named.select(F.col("key").alias("__key"), F.col("code").alias("a")).distinct()
    same = same.join(first.select("key", F.col("code").alias("b")), F.col("__key") == F.col("key")).where("a <> b").select("a", "b")
    met = front_pairs(sets, similarity)
    C.discard(sets)
    pairs = C.stage(counted(met), "set-chains")
    C.discard(*met)
    C.release(spark)
    parts = C.stage(components(pairs, "a", "b"), "set-parts")
    some = parts.withColumnRenamed("node", "key").join(first, "key")
    texts = C.stage(some.select("key", "root", "code", "n", F.col("text_hash").alias("__hash"), F.col("doc_id").alias("__doc")), "set-texts")
    chunks = texts.groupBy(F.col("root").alias("__root")).agg(F.ceil(F.sum("n") / group_limit).cast("int").alias("chunks"))
    groups = C.stage(texts.join(chunks, F.col("root") == F.col("__root")).drop("__root"), "set-groups")
    some = C.bounded_broadcast(groups, groups.count())
    held = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    rows = held.join(some, (held["text_hash"] == some["__hash"]) & held["doc_id"].eqNullSafe(some["__doc"]))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    group = ["root", "ci", "cj"]
    rows = rows.select("root", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"), "n", "key", "code", "text")
    rows = rows.repartition(C.shuffle_width(spark) * 2, *group).sortWithinPartitions(*group, "n", "key")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> pa.RecordBatch:
            found = [(codes[i], codes[j]) for i, j in alike(own, similarity) if codes[i] != codes[j]]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        now, seen, codes, own, shingles = None, None, [], [], Shingles(shingle)
        for batch in batches:
            sets = shingles(batch.column(6).to_pylist())
            for *of, _, key, code, found in zip(*(x.to_pylist() for x in batch.columns[:6]), sets, strict=True):
                if of != now:
                    if len(own) > 1:
                        yield pairs()
                    now, seen, codes, own = of, None, [], []
                if key != seen:  # equal rows come one after the other
                    codes.append(code)
                    own.append(found)
                seen = key
        if len(own) > 1:
            yield pairs()

    found = C.stage(same.union(rows.mapInArrow(compared, "a long, b long")), "set-links")
    C.discard(pairs, named, first, parts, texts, groups)
    return found
