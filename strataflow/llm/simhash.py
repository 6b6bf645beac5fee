"""SimHash near-duplicates by a binary trie self-join.

Fingerprints have 64 bits, from the hashes of 3-word shingles. Two fingerprints are linked if they differ in BUDGET bits or
fewer. Distinct fingerprints are dealt out by blocks of their bits: cut into m blocks, two that are linked agree in m - BUDGET
blocks at least, so each choice of that many blocks brings the pair together somewhere. Within each group a binary trie over
the sorted fingerprints is joined with itself: pairs of nodes go down together, each step adds the bits in which the two
differ, and a pair over the budget is dropped. Links are thinned to a spanning forest where they are found, and distributed
connected components make the classes.

Groups larger than GROUP_LIMIT are cut into chunks, and every two chunks are joined as a group of their own, so no task holds
an unbounded group and no pair is lost.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; rows of equal ids are rows of their
own; a class of rows without ids has a null component_id; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

BITS = 64
BUDGET = 3
SHINGLE = 3
SEED = 42
#: Largest group of fingerprints that one task joins whole.
GROUP_LIMIT = 20_000
#: Rows that a task gathers, to the next end of a group, before it joins them.
GATHER = 200_000
#: Pairs of nodes that are handled at a time, and pairs of fingerprints under a pair of nodes that are compared directly.
FRONTIER, LEAF = 400_000, 16

Near = Callable[[DataFrame, DataFrame], DataFrame]


# --- fingerprints


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each document from its shingles' hashes, laid end to end; `counts` has how many each one has.

    Bits are counted in eight byte-wide lanes a word at a time, in runs of 255 shingles so that no lane overflows.
    """
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    place = np.arange(len(hashes)) - np.repeat(begin, n)
    runs = np.flatnonzero(place % 255 == 0)
    first_run = np.searchsorted(runs, begin)
    bits = np.zeros((len(some), BITS), bool)
    lanes = np.uint64(0x0101010101010101)
    for s in range(8):
        part = np.add.reduceat((hashes >> np.uint64(s)) & lanes, runs)
        votes = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        bits[:, s::8] = votes * 2 > n[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `shingle` words, A-Z in lower case; of all words if they are fewer; of none if there are none."""
    import xxhash

    w = (text or b"").lower().split()  # for bytes, both know ASCII alone
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [shingle_hashes(x) for x in batch.column(2).to_pylist()]
        flat = np.concatenate(each) if each else np.zeros(0, np.uint64)
        codes = fingerprints(flat, np.array([len(x) for x in each], np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes.view(np.int64))], ["doc_id", "text_hash", "code"])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Stage doc_id, a hash of the text, and the fingerprint as a signed number."""
    C.ready_python(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return C.stage(rows.mapInArrow(_print_batches, "doc_id long, text_hash long, code long"), "fingerprints")


# --- trie self-join


def trie_links(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of codes within one group that differ in `budget` bits or fewer. Groups are the ranges [lo, hi) of
    `codes`, each ascending and without repeats. A node of a trie is a range of codes that agree in their first bits."""
    zeros: dict[int, np.ndarray] = {}

    def split(bit: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if bit not in zeros:
            clear = (codes >> np.uint64(bit)) & np.uint64(1) == 0
            zeros[bit] = np.concatenate(([0], np.cumsum(clear))).astype(np.int32)
        return a + zeros[bit][b] - zeros[bit][a]

    stack = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            for k in range(0, len(alo), FRONTIER):
                stack.append((bit, *(x[k : k + FRONTIER] for x in (alo, ahi, blo, bhi, err))))
            continue
        work = (ahi - alo).astype(np.int64) * (bhi - blo)
        leaf = work <= LEAF
        if leaf.any():
            n, wide, a, b = work[leaf], (bhi - blo)[leaf], alo[leaf], blo[leaf]
            which = np.repeat(np.arange(len(n)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = a[which] + place // wide[which], b[which] + place % wide[which]
            near = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        if leaf.all():
            continue
        alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        amid, bmid, twin = split(bit, alo, ahi), split(bit, blo, bhi), alo == blo
        kids = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        kids.append(tuple(x[~twin] for x in (amid, ahi, blo, bmid, err + 1)))
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*kids, strict=True))
        live = (ahi > alo) & (bhi > blo) & (err <= budget)
        if live.any():
            stack.append((bit - 1, *(x[live] for x in (alo, ahi, blo, bhi, err))))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest one that it is linked to, near or far."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, code), sorted; groups may go on from one batch to the next."""

    def links(group: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(code)]))
        many = hi - lo > 1
        # signed order becomes unsigned order when the sign is flipped, and no distance changes
        root = forest(len(code), trie_links(code.view(np.uint64) ^ np.uint64(1 << 63), lo[many], hi[many]))
        own = np.flatnonzero(root != np.arange(len(code)))
        return pa.RecordBatch.from_arrays([pa.array(code[own]), pa.array(code[root[own]])], ["a", "b"])

    groups, codes, n = [], [], 0
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
        groups.append(np.stack(cols[:4], axis=1))
        codes.append(cols[4])
        n += len(cols[4])
        if n >= GATHER:
            group, code = np.concatenate(groups), np.concatenate(codes)
            cut = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1))
            end = int(cut[-1]) + 1 if len(cut) else 0
            if end:
                yield links(group[:end], code[:end])
            groups, codes, n = [group[end:]], [code[end:]], len(code) - end
    if n:
        yield links(np.concatenate(groups), np.concatenate(codes))


def block_masks(distinct: int, budget: int = BUDGET) -> list[int]:
    """Masks of the bits that two linked fingerprints agree in, one of them at least. More fingerprints get more and longer
    masks: 16 bits up to 2^22 of them, about 26 up to 2^32, then about 32, so that groups stay small."""
    m = budget + 1 if distinct < 1 << 22 else budget + 2 if distinct < 1 << 32 else budget + 3
    edges = [round(BITS * i / m) for i in range(m + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(m)]
    return [sum(x) for x in combinations(blocks, m - budget)]


def links(codes: DataFrame, distinct: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Pairs (a, b) of linked fingerprints, thinned to a forest in each group; `codes` has distinct fingerprints in `code`."""
    spark = codes.sparkSession
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in block_masks(distinct)]
    keyed = codes.select("code", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    large = C.stage(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > group_limit), "large-groups")
    large = large.select(F.col("t").alias("__t"), F.col("key").alias("__key"), F.ceil(F.col("n") / group_limit).cast("int").alias("chunks"))
    large = C.bounded_broadcast(large, large.count())
    rows = keyed.join(large, (keyed.t == large["__t"]) & (keyed.key == large["__key"]), "left")
    rows = rows.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("t", "key", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"), "code")
    group = ["t", "key", "ci", "cj"]
    rows = rows.repartition(C.shuffle_width(spark) * 2, *group).sortWithinPartitions(*group, "code")
    return rows.mapInArrow(_join_groups, "a long, b long")


def classes(docs: DataFrame, group_limit: int = GROUP_LIMIT, near: Near | None = None, used: list | None = None) -> DataFrame:
    """doc_id, text_hash, code (signed fingerprint), root (one code for each class) and component_id (smallest doc_id).
    `near` takes the documents and the staged fingerprints, and gives pairs (a, b) of fingerprints that are linked as well. Tables that
    the result is read from are added to `used`."""
    prints = fingerprint_table(docs)
    codes = C.stage(prints.groupBy("code").agg(F.min("doc_id").alias("first_id")), "codes")
    distinct = codes.count()
    found = links(codes, distinct, group_limit)
    root = components(found.union(near(docs, prints)) if near else found, "a", "b")
    linked_codes = C.stage(root.join(codes, root.node == codes.code).select("node", "root", "first_id"), "linked")
    named = linked_codes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked_codes.select("node", "root").join(named, "root")
    by_code = codes.join(linked, codes.code == linked.node, "left").select(
        F.col("code").alias("__code"),
        F.coalesce("root", "code").alias("root"),
        F.when(F.col("node").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    by_code = C.stage(by_code, "classes")
    if used is not None:
        used += [prints, codes, linked_codes, by_code]
    by_code = C.bounded_broadcast(by_code, distinct)
    return prints.join(by_code, prints.code == by_code["__code"]).drop("__code")


def hex_code(code: str = "code"):
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def keep_first(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """One document of each class, that with the smallest doc_id (of equal ids, the smallest text hash; of equal rows, one),
    with the columns of the input."""
    used: list = []
    named = C.stage(classes(docs, near=near, used=used).select("root", "doc_id", "text_hash"), "class-rows")
    C.discard(*used)
    C.release(docs.sparkSession)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = named.groupBy("root").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__h"))
    repeated = not named.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    held = held.withColumns({"__doc": F.col("__row.doc_id"), "__hash": F.xxhash64("__row.text")})
    # the kept ids grow with the documents, so both sides are shuffled at any size; equal rows, if any, are made one after that
    both = held.join(kept, held["__doc"].eqNullSafe(kept["__id"]) & (held["__hash"] == kept["__h"]), "left_semi")
    return (both.dropDuplicates(["__doc", "__hash"]) if repeated else both).select("__row.*")
