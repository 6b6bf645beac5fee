"""Boolean and ranked search: a query text becomes a tree, and the tree set operations on an inverted index.

The index has posting lists in blocks: documents are dealt into parts of about PART_DOCS, and a row holds the ids of one term in
one part, ascending, with the term's count in each. A query reads the rows of its own terms and works on each part by itself,
so ids never meet in a shuffle of their own.

Two modes. `lr`: operators apply from left to right without precedence, words side by side are joined by AND, parentheses that
stand alone are ignored. `prec`: OR binds least, then AND, then NOT, with parentheses.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, index_terms
from ..session import ship

#: Documents of one part, about; a posting list holds no more ids.
PART_DOCS = 1 << 16
#: Terms or postings that a task gathers before it makes lists of them.
GATHER = 500_000
LIST_COLUMNS = ["term", "part", "ids", "freqs"]
LIST_SCHEMA = "term string, part int, ids array<long>, freqs array<long>"
#: A list on its way through a shuffle: gaps between ids and counts in turn, each in as many groups of seven bits as it needs.
PACKED_SCHEMA = "term string, part int, packed binary"
#: Bytes of an Arrow batch that goes to Python (a batch of lists is as large as its ids are many), and of packed lists that are unpacked at once.
BATCH_BYTES, UNPACK_BYTES = 8 << 20, 256 << 10
SPELLINGS = {"and": "AND", "&&": "AND", "or": "OR", "||": "OR", "not": "NOT", "!": "NOT"}


@dataclass(frozen=True)
class Node:
    kind: str
    parts: tuple = ()
    term: str = ""


def part_count(docs: DataFrame) -> int:
    return max(1, -(-docs.count() // PART_DOCS))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Batches put together until a column of lists has GATHER values."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(column).flatten())
        if n >= GATHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(table: pa.Table, column: int) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists end to end, and the row of each."""
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    return lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)


def _listed(terms: pa.Array, group: np.ndarray, part: np.ndarray, ids: np.ndarray, freqs: np.ndarray) -> pa.RecordBatch:
    """Posting lists from postings in order of (group, part, id): one for each group and part, an id that comes again summed."""
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (part[1:] != part[:-1])))[: len(group)]
    fresh = new | np.concatenate(([True], ids[1:] != ids[:-1]))[: len(ids)]
    freqs = np.add.reduceat(freqs, np.flatnonzero(fresh)) if len(freqs) else freqs
    ends = pa.array(np.append(np.flatnonzero(new[fresh]), fresh.sum()).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids[fresh], freqs)]
    return pa.RecordBatch.from_arrays([terms.take(pa.array(group[new])), pa.array(part[new].astype(np.int32)), *lists], LIST_COLUMNS)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, terms) to posting lists of the rows at hand."""
    for table in _gathered(batches, 2):
        words, row = _flat(table, 2)
        words = words.dictionary_encode()
        doc, part = (table.column(i).to_numpy().astype(np.int64) for i in range(2))
        pairs, n = np.unique(words.indices.to_numpy().astype(np.int64) * len(doc) + row, return_counts=True)
        group, row = np.divmod(pairs, max(len(doc), 1))
        order = np.lexsort((doc[row], part[row], group))
        yield _listed(words.dictionary, group[order], part[row][order], doc[row][order], n[order].astype(np.int64))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists in order of (term, part), of which those of one term and part are made one."""
    rest = None
    for table in itertools.chain(_gathered(batches, 2), [None]):
        now = rest if table is None else table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if now is None or not now.num_rows:
            continue
        term, part = now.column(0).combine_chunks(), now.column(1).to_numpy()
        term = (term.chunk(0) if isinstance(term, pa.ChunkedArray) else term).dictionary_encode()
        code = term.indices.to_numpy()
        own = np.concatenate(([0], np.cumsum((code[1:] != code[:-1]) | (part[1:] != part[:-1]))))
        # the last list may go on in the next batch
        rest = now.slice(int(np.searchsorted(own, own[-1]))) if table is not None else None
        now = now if rest is None else now.slice(0, now.num_rows - rest.num_rows)
        if now.num_rows:
            ids, row = _flat(now, 2)
            ids, freqs = ids.to_numpy(), _flat(now, 3)[0].to_numpy()
            order = np.lexsort((ids, own[row]))
            row = row[order]
            yield _listed(term.dictionary, code[row].astype(np.int64), part[row], ids[order], freqs[order])


def _packed(lists: pa.RecordBatch) -> pa.RecordBatch:
    """Posting lists by PACKED_SCHEMA."""
    table = pa.Table.from_batches([lists])
    ids, row = _flat(table, 2)
    values = np.stack([ids.to_numpy(), _flat(table, 3)[0].to_numpy()], 1)
    new = np.concatenate(([True], row[1:] != row[:-1]))[: len(row)]
    values[1:, 0] -= np.where(new[1:], 0, values[:-1, 0])
    values = values.reshape(-1).view(np.uint64)
    size, rest = np.ones(len(values), np.int64), values >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest = rest >> np.uint64(7)
    ends = np.concatenate(([0], np.cumsum(size)))
    data, at, rest = np.empty(ends[-1], np.uint8), ends[:-1], values
    while len(at):
        more = rest > 127
        data[at] = (rest & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        at, rest = at[more] + 1, rest[more] >> np.uint64(7)
    offsets = ends[2 * np.searchsorted(row, np.arange(lists.num_rows + 1))].astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), lists.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([lists.column(0), lists.column(1), packed], ["term", "part", "packed"])


def _unpacked(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """What `_packed` was given, a piece at a time."""
    sizes = np.cumsum(np.asarray(pc.binary_length(rows.column(2)), np.int64))
    cuts = np.flatnonzero(np.diff(sizes // UNPACK_BYTES)) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), rows.num_rows]):
        yield _unpacked_piece(rows.slice(a, b - a))


def _unpacked_piece(rows: pa.RecordBatch) -> pa.RecordBatch:
    packed = pa.concat_arrays([rows.column(2)]).cast(pa.binary())
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) if len(packed) else np.zeros(1, np.int64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    last = np.flatnonzero(data < 128)
    begin = np.concatenate(([0], last[:-1] + 1))[: len(last)]
    place = np.arange(len(data)) - np.repeat(begin, last - begin + 1)
    values = np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begin) if len(data) else np.empty(0, np.uint64)
    gaps, freqs = values.view(np.int64).reshape(-1, 2).T
    starts = np.searchsorted(last, offsets - offsets[0]) // 2
    sums = np.concatenate(([0], np.cumsum(gaps)))
    ids = sums[1:] - np.repeat(sums[starts[:-1]], np.diff(starts))
    lists = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(np.ascontiguousarray(x))) for x in (ids, freqs)]
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], LIST_COLUMNS)


def packed(lists: DataFrame) -> DataFrame:
    """Posting lists in the form in which they are small to shuffle."""
    ready(lists.sparkSession)
    return lists.select(*LIST_COLUMNS).mapInArrow(lambda batches: map(_packed, batches), PACKED_SCHEMA)


def merged(rows: DataFrame) -> DataFrame:
    """One posting list for each term and part, ids ascending and counts of an id summed, from packed lists; each task's in order of term and part."""
    rows = rows.select("term", "part", "packed").repartition("term", "part").sortWithinPartitions("term", "part")
    return rows.mapInArrow(lambda batches: _merged(piece for b in batches for piece in _unpacked(b)), LIST_SCHEMA)


def ready(spark: SparkSession) -> None:
    """Before lists go through Python: bound the bytes of the session's Arrow batches, which stay so, and send the package."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


def posting_lists(docs: DataFrame, parts: int = 1) -> DataFrame:
    """(term, part, ids, freqs): the ids, ascending, of the documents of a part that have the term, and how often each has it.

    Tasks make lists of the documents at hand, and these are what is shuffled, once and packed: a posting is two small numbers there,
    and a term comes once a task and part. Rows of equal ids are one document; those without an id are left out."""
    ready(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _part(parts), index_terms(F.col("text")).alias("terms"))
    return merged(rows.mapInArrow(lambda batches: map(_packed, _inverted(batches)), PACKED_SCHEMA))


def universe(docs: DataFrame, parts: int = 1) -> DataFrame:
    """(part, ids): all documents, those without any term included."""
    return docs.groupBy(_part(parts)).agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))


def _split(text: str) -> list[str]:
    return ascii_lower(text).split()


def parse_left_to_right(text: str) -> Node | None:
    tree, op, negate = None, "AND", False
    for word in _split(text):
        if word in "()":
            continue
        kind = SPELLINGS.get(word)
        if kind == "NOT":
            negate = True
        elif kind:
            op = kind
        else:
            leaf = Node("TERM", term=word)
            leaf = Node("NOT", (leaf,)) if negate else leaf
            tree = leaf if tree is None else Node(op, (tree, leaf))
            op, negate = "AND", False
    return tree


def parse_precedence(text: str) -> Node | None:
    words = _split(text.replace("(", " ( ").replace(")", " ) "))
    at = 0

    def peek() -> str:
        return SPELLINGS.get(words[at], words[at]) if at < len(words) else ""

    def either() -> Node | None:
        nonlocal at
        left = both()
        while peek() == "OR":
            at += 1
            right = both()
            left = Node("OR", (left, right)) if left and right else left or right
        return left

    def both() -> Node | None:
        nonlocal at
        left = single()
        while peek() not in ("", "OR", ")"):
            at += peek() == "AND"
            right = single()
            left = Node("AND", (left, right)) if left and right else left or right
        return left

    def single() -> Node | None:
        nonlocal at
        word = peek()
        if word in ("", ")", "OR", "AND"):
            return None
        at += 1
        if word == "NOT":
            inner = single()
            return Node("NOT", (inner,)) if inner else None
        if word == "(":
            inner = either()
            at += peek() == ")"
            return inner
        return Node("TERM", term=word)

    return either()


def terms(tree: Node) -> list[str]:
    own = [tree.term] if tree.kind == "TERM" else []
    return sorted({*own, *(t for p in tree.parts for t in terms(p))})


def can_match_without_terms(tree: Node) -> bool:
    """Whether a document that has none of the terms matches."""
    parts = [can_match_without_terms(p) for p in tree.parts]
    return {"TERM": lambda: False, "NOT": lambda: not parts[0], "AND": lambda: all(parts), "OR": lambda: any(parts)}[tree.kind]()


def ids_of(tree: Node, lists: dict[str, Column], every: Column) -> Column:
    """The ids that match, from each term's list and those of all documents. `x AND NOT y` needs no list of all."""
    if tree.kind == "TERM":
        return lists[tree.term]
    parts = [p for p in tree.parts if p.kind != "NOT"]
    without = [ids_of(p.parts[0], lists, every) for p in tree.parts if p.kind == "NOT"]
    if tree.kind == "AND" and parts:
        return reduce(F.array_except, without, reduce(F.array_intersect, [ids_of(p, lists, every) for p in parts]))
    if tree.kind == "NOT":
        return F.array_except(every, ids_of(tree.parts[0], lists, every))
    found = [ids_of(p, lists, every) for p in tree.parts]
    return reduce(F.array_intersect if tree.kind == "AND" else F.array_union, found)


def search(index: DataFrame, universe: DataFrame, text: str, mode: str = "lr") -> DataFrame:
    """Ids of the documents that match. The index is read once, for the query's terms alone; the universe is joined only if the
    tree takes documents away from all of them."""
    tree = parse_precedence(text) if mode == "prec" else parse_left_to_right(text)
    if tree is None:
        return universe.select(F.explode("ids").alias("doc_id")).limit(0)
    names = {t: f"t{i}" for i, t in enumerate(terms(tree))}
    none = F.array().cast(universe.schema["ids"].dataType)
    own = [F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("ids")))).alias(n) for t, n in names.items()]
    found = index.where(F.col("term").isin(list(names))).groupBy("part").agg(*own)
    every = none
    if can_match_without_terms(tree) or _needs_universe(tree):
        found, every = universe.join(found, "part", "left"), F.col("ids")
    lists = {t: F.coalesce(F.col(n), none) for t, n in names.items()}
    return found.select(F.explode(ids_of(tree, lists, every)).alias("doc_id"))


def _needs_universe(tree: Node) -> bool:
    """Whether a NOT stands where nothing else limits what it leaves."""
    if tree.kind == "AND" and any(p.kind != "NOT" for p in tree.parts):
        return any(_needs_universe(p.parts[0] if p.kind == "NOT" else p) for p in tree.parts)
    return tree.kind == "NOT" or any(_needs_universe(p) for p in tree.parts)


def scores(index: DataFrame, wanted: list[str]) -> DataFrame:
    """(doc_id, score): how often documents have the terms, in all. A term that is listed twice counts twice."""
    rows = index.where(F.col("term").isin(wanted)) if len(set(wanted)) == len(wanted) else _join_terms(index, wanted)
    each = rows.select(F.explode(F.arrays_zip("ids", "freqs")).alias("x"))
    return each.groupBy(F.col("x.ids").alias("doc_id")).agg(F.sum("x.freqs").alias("score"))


def _join_terms(index: DataFrame, wanted: list[str]) -> DataFrame:
    asked = index.sparkSession.createDataFrame([(t,) for t in wanted], "term string")
    return index.where(F.col("term").isin(wanted)).join(F.broadcast(asked), "term")


def best_scores(index: DataFrame, asked: list[tuple[int, str]], k: int) -> DataFrame:
    """(qid, doc_id, score, place): the k best documents of each query, which are given as (qid, term) and answered together; ties go
    to the smaller id. A term that a query lists twice counts twice.

    Posting lists, not hits, are shuffled, to the task of their query and part. Documents are summed there, and only each task's
    best k of a query go on to the last ranking, so its window sees k rows a task."""
    known: dict[str, list[int]] = {}
    for qid, term in asked:
        known.setdefault(term, []).append(qid)
    if not known:
        asked_for = F.array().cast("array<bigint>")
    else:
        asked_for = F.create_map(*[c for t, q in known.items() for c in (F.lit(t), F.array(*[F.lit(i).cast("long") for i in q]))])[F.col("term")]
    rows = index.where(F.col("term").isin(list(known))).select(F.explode(asked_for).alias("qid"), "part", "ids", "freqs").repartition("qid", "part")
    hits = rows.select("qid", "part", F.explode(F.arrays_zip("ids", "freqs")).alias("x"))
    scored = hits.groupBy("qid", "part", F.col("x.ids").alias("doc_id")).agg(F.sum("x.freqs").alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")).cast("long")
    return scored.select("qid", "doc_id", "score").withColumn("place", place).where(F.col("place") <= k)
