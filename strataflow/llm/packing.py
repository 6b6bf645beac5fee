"""Harmonic packing of token ids into sequences of bounded length.

A class is a length floor(capacity / k), k of whose pieces fill a sequence; classes are those that leave at most `slack` tokens
free (lengths of which the capacity is a multiple leave none). A document is cut into whole sequences and then, from what is left, into the longest
class that fits, and so on: with k(k + 1) growing, few pieces are left of any document. A task fills the sequences of each class
with k pieces as they come, without asking others. Pieces that don't fill a sequence of their task are numbered over all tasks, and
fill sequences by the same counts. What is left then is less than one sequence a class: it is laid end to end and cut at the
capacity, and the last stretch into powers of two, which need no padding. So no sequence is padded by more than `slack`.

Defined cases: a null text is empty and has the end id alone; repeated rows and null ids are documents of their own; an empty
table gives no pieces; very long texts are cut like others. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import token_records

CAPACITY, END_ID, SLACK = 2048, 1, 8
PIECES = 4096
KINDS = dict(part=pa.int32(), row=pa.int64(), doc_id=pa.int64(), start=pa.int64(), length=pa.int64(), ids_crc32=pa.int64(), doc_tokens=pa.int64(), size=pa.int32(), k=pa.int32(), no=pa.int64(), ids=pa.binary())
SCHEMA = "part int, row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size int, k int, no long, ids binary"


def classes(capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """(length, pieces a sequence) of each class, shortest first. Length 1 is always one."""
    sizes = {capacity // k for k in range(1, capacity + 1)}
    return sorted((s, capacity // s) for s in sizes if capacity % s <= slack)


def cut(total: int, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: always the longest class that fits."""
    at = 0
    while at < total:
        size = sizes[bisect_right(sizes, total - at) - 1]
        yield at, size
        at += size


def _cutter(tokenizer: str, capacity: int, end_id: int, slack: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), token_records.encoder(tokenizer)
        count = dict(classes(capacity, slack))
        sizes, met, row, rows = sorted(count), dict.fromkeys(count, 0), 0, []

        def handed() -> pa.RecordBatch:
            cols = zip(*rows, strict=True) if rows else [[]] * len(KINDS)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS.values(), strict=True)], [*KINDS])
            rows.clear()
            return made

        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                raw = body + end
                ids = np.frombuffer(raw, enc.dtype).astype("<u4")
                total = len(ids)
                for start, size in cut(total, sizes):
                    no = met[size]
                    met[size] = no + 1
                    rows.append((part, row, doc_id, start, size, zlib.crc32(ids[start : start + size]), total, size, count[size], no, raw[start * width : (start + size) * width]))
                row += 1
                if len(rows) >= PIECES:
                    yield handed()
        yield handed()

    return write


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """Documents encoded and cut, staged: a row a piece, with its task, its document's number there, its class (size, k), its number
    among the task's pieces of that class, and its ids (two bytes each where the vocabulary allows it, else four)."""
    C.ready_python(docs.sparkSession)
    how = _cutter(tokenizer or token_records.default_tokenizer(), capacity, end_id, slack)
    return C.stage(docs.select("doc_id", "text").mapInArrow(how, SCHEMA), "pieces")


def tail_cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the sequences that hold `total` tokens laid end to end: whole ones, then powers of two."""
    out, at = [], 0
    while total - at >= capacity:
        out.append((at, at + capacity))
        at += capacity
    while at < total:
        size = 1 << (total - at).bit_length() - 1
        out.append((at, at + size))
        at += size
    return out


def place(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give staged pieces their sequence_id (gapless from 0) and their offset in it.

    Counts by task and class decide; at most one row a task and class is summed up in order, on three levels. Pieces that
    neither a task nor all tasks together can make a sequence of are fewer than k a class, whatever the input: their number is
    bounded by the classes alone."""
    spark = cuts.sparkSession
    counts = C.stage(cuts.groupBy("part", "size", "k").agg(F.count("*").alias("n")).withColumns({"full": F.expr("n div k"), "rest": F.expr("n % k")}), "class-counts")
    by_part = C.running_total(counts.groupBy("part").agg(F.sum("full").alias("bins")).withColumn("chunk", F.expr("part div 1024")), [], "chunk", ["part"], "bins", "before")
    inside = Window.partitionBy("part").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    counts_at = counts.withColumn("within", F.coalesce(F.sum("full").over(inside), F.lit(0).cast("long"))).join(by_part.select("part", "before"), "part")
    counts_at = C.running_total(counts_at.withColumn("chunk", F.expr("part div 1024")), ["size"], "chunk", ["part"], "rest", "rest_before")
    at = C.stage(counts_at.select(F.col("part").alias("__part"), F.col("size").alias("__size"), "full", F.expr("before + within").alias("first_bin"), "rest_before"), "class-offsets")
    known = C.bounded_broadcast(at, at.count())
    rows = cuts.join(known, (F.col("part") == F.col("__part")) & (F.col("size") == F.col("__size")))
    own = rows.where("no < full * k").withColumns({"sequence_id": F.expr("first_bin + no div k"), "offset": F.expr("(no % k) * size")})

    # what tasks have left, filled by the same counts over all tasks
    filled = counts.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    left = {r["size"]: (r.n, r.k) for r in counts.groupBy("size", "k").agg(F.sum("rest").alias("n")).collect()}  # a row a class
    shared, plan = filled, []
    for size, (n, k) in sorted(left.items()):
        plan.append((size, shared, n // k))
        shared += n // k
    bins = spark.createDataFrame(plan, "__s int, shared_first long, shared_full long")
    rest = rows.where("no >= full * k").withColumn("rest_no", F.expr("rest_before + no - full * k")).join(F.broadcast(bins), F.col("size") == F.col("__s"))
    joined = rest.where("rest_no < shared_full * k").withColumns({"sequence_id": F.expr("shared_first + rest_no div k"), "offset": F.expr("(rest_no % k) * size")})

    # fewer than k pieces a class: end to end, in the order of classes
    total = 0
    starts = []
    for size, (n, k) in sorted(left.items()):
        starts.append((size, total))
        total += n % k * size
    begins = spark.createDataFrame(starts, "__t int, begin long")
    ends = spark.createDataFrame([(a, b, shared + i) for i, (a, b) in enumerate(tail_cuts(total, capacity))], "seq_start long, seq_end long, sequence_id long")
    tail = rest.where("rest_no >= shared_full * k").join(F.broadcast(begins), F.col("size") == F.col("__t"))
    tail = tail.withColumn("laid", F.expr("begin + (rest_no - shared_full * k) * size"))
    # a piece may lie across the border of two sequences; there are as many sequences as classes at most, and a few
    tail = tail.join(F.broadcast(ends), (F.col("laid") < F.col("seq_end")) & (F.col("laid") + F.col("length") > F.col("seq_start")))
    skip = "greatest(seq_start - laid, 0L)"
    tail = tail.withColumns({"skip": F.expr(skip), "long": F.expr(f"least(laid + length, seq_end) - laid - {skip}"), "offset": F.expr("greatest(laid - seq_start, 0L)")})
    names = [c for c in cuts.columns if c not in ("size", "k", "no")] + ["sequence_id", "offset"]
    whole = own.select(*names).union(joined.select(*names)).withColumns({"skip": F.lit(0).cast("long"), "long": F.col("length")})
    return whole.union(tail.select(*names, "skip", "long"))


def _recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        skip, long, length, ids = (batch.column(names.index(c)).to_pylist() for c in ("skip", "long", "length", "ids"))
        parts = [x[a * (w := len(x) // m) : (a + n) * w] for a, n, m, x in zip(skip, long, length, ids, strict=True)]
        crc = [zlib.crc32(np.frombuffer(x, f"<u{len(x) // n}").astype("<u4")) for n, x in zip(long, parts, strict=True)]
        cols = {c: batch.column(i) for i, c in enumerate(names)} | {"ids": pa.array(parts, pa.binary()), "ids_crc32": pa.array(crc, pa.int64())}
        yield pa.RecordBatch.from_arrays([*cols.values()], names)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, part and row (the document's place in the input), ids."""
    placed = place(pieces(docs, tokenizer, capacity, end_id, slack), capacity)
    # pieces at a border of the last sequences are cut again; others keep their checksum
    cut_again = F.col("long") < F.col("length")
    again = placed.where(cut_again)
    out = placed.where(~cut_again).union(again.mapInArrow(_recut, again.schema))
    start, length = (F.col("start") + F.col("skip")).alias("start"), F.col("long").alias("length")
    return out.select("doc_id", start, length, "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "row", "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, n_tokens, ids. A sequence has at most the capacity's tokens."""
    got = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return got.select("sequence_id", "n_tokens", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
