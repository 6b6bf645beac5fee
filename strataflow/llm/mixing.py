"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Each source's documents are shuffled by a hash and laid end to end as a circular stream of words. The stream is cut
into blocks of equal length. The points of a van der Corput sequence, mapped through the sources' cumulative numbers of
blocks, say which source fills each slot of the mix; the k-th slot of a source takes the k-th block of its stream. A slot's
position is its place in the mix, and a document stands where the slot is that takes its first word.

Whole documents (`mix`) are taken as often as their middles lie in the part of the stream that the slots take. The stream runs on
from one document to the next, so what one is rounded up by the next has less, and a source is off by half a document at most.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows of size 0 are kept
with taken 0 and without a position, and left out of the mixed documents; repeated rows count as rows of their own (in
the mixed documents, rows of equal id, text and source stand for one another); an empty table gives an empty result. Only
doc_id, text and source are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 1024
#: Grid points that one row of a source is expanded into at a time.
PIECE = 4096


def measure(docs: DataFrame) -> DataFrame:
    """Stage one narrow row a document: uid, doc_id, source, size in words, and the hash that shuffles the stream."""
    return C.stage(
        docs.select(
            "doc_id",
            "source",
            F.size(C.words(F.col("text"))).cast("long").alias("size"),
            F.xxhash64("doc_id", "text").alias("h"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "mix-docs",
    )


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, int]:
    """Per source: sid (its place by code point, null last), source_size, weight, target; and the number of sources.

    Targets are the weight's part of share * all sizes, held at cap * source_size; what is over goes to the others by
    weight until none is above. Each round is one aggregate over the table of sources.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = C.ordered_chunks(per.withColumn("one", F.lit(1).cast("long")), F.col("source").asc_nulls_last(), "mix-sources")
    per = C.running_total(per, [], "__pid", [F.col("source").asc_nulls_last()], "one", "sid")
    turns = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(turns, (F.col("sid") % len(weights) + 1).cast("int")).cast("long"))
    per = C.stage(per.select("source", "sid", "source_size", "weight", "__pid"), "mix-targets")
    n, total, weight = per.agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
    goal = min(share, cap) * (total or 0)
    level, held = (goal / weight if weight else 0.0), -1
    limit = F.col("source_size") * cap
    while n:
        over = limit < F.lit(level) * F.col("weight")
        now, used, free = per.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
        ).first()
        if now == held or not free:
            break
        held, level = now, (goal - used) / free
    target = F.least(limit.cast("double"), F.lit(float(level)) * F.col("weight"))
    return per.withColumn("target", target), n


def schedule(per: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """The mix's slots: position (order in the mix), sid, rank (the slot's place among its source's), begin and end in the
    source's circular stream; and a number above all positions. Each source gets exactly the slots that its target needs;
    its last one may be short."""
    spark = per.sparkSession
    goal = F.round("target").cast("long")
    per = per.withColumn("goal", goal).withColumn("slots", F.ceil(F.col("goal") / block_words).cast("long"))
    per = C.running_total(per, [], "__pid", ["sid"], "slots", "before")
    total = per.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(1, (max(total, 1) - 1).bit_length())
    grid = 1 << bits
    edge = "cast((cast({} as decimal(19,0)) * cast({} as decimal(19,0)) + {}) div cast({} as decimal(19,0)) as bigint)"
    total = max(total, 1)
    per = (
        per.where("slots > 0")
        .withColumn("lo", F.expr(edge.format("before", grid, total - 1, total)))
        .withColumn("hi", F.expr(edge.format("before + slots", grid, total - 1, total)))
    )
    pieces = per.select(
        "sid", "source_size", "goal", "slots", "lo", "hi",
        F.explode(F.expr(f"sequence(lo div {PIECE}, (hi - 1) div {PIECE})")).alias("piece"),
    ).repartition(C.shuffle_width(spark), "sid", "piece")
    points = pieces.select(
        "sid", "source_size", "goal", "slots",
        F.explode(F.expr(f"sequence(greatest(lo, piece * {PIECE}), least(hi, (piece + 1) * {PIECE}) - 1)")).alias("point"),
    )
    # the van der Corput sequence visits grid point p at the position whose bits are those of p reversed
    place = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    chunk = C.chunk_bits(total)
    slots = points.withColumn("position", place).withColumn("one", F.lit(1).cast("long"))
    slots = slots.withColumn("chunk", F.shiftright("position", max(0, bits - chunk)))
    slots = C.running_total(slots, ["sid"], "chunk", ["position"], "one", "rank").where("rank < slots")
    begin = F.col("rank") * block_words
    slots = slots.select("position", "sid", "source_size", "rank", begin.alias("begin"), F.least(begin + block_words, "goal").alias("end"))
    return slots, grid


def streams(sized: DataFrame, per: DataFrame, n_sources: int) -> DataFrame:
    """Add to every document its source's sid, source_size, target and goal, and start, its place in the source's stream."""
    small = per.select(F.col("source").alias("__source"), "sid", "source_size", "target", F.round("target").cast("long").alias("goal"))
    small = C.bounded_broadcast(small, n_sources)
    rows = sized.join(small, sized.source.eqNullSafe(small["__source"]), "inner").drop("__source")
    bits = C.chunk_bits(sized.count())
    rows = rows.withColumn("chunk", F.shiftrightunsigned("h", 64 - bits))
    return C.running_total(rows, ["sid"], "chunk", ["h", "doc_id", "uid"], "size", "start")


def take(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: uid, doc_id, h, size, source, source_size, target, taken (words that the mix takes, repeats counted) and
    position (of the first slot that takes words of it; null if none does)."""
    sized = measure(docs)
    per, n_sources = source_targets(sized, weights, share, cap)
    slots, _ = schedule(per, block_words)
    # a slot may run past the end of the stream, where the stream begins again
    lap = F.explode(F.expr("sequence(begin div source_size, (end - 1) div source_size)")).alias("lap")
    parts = slots.select("*", lap).select(
        "sid", "position",
        (F.greatest("begin", F.col("lap") * F.col("source_size")) - F.col("lap") * F.col("source_size")).alias("lo"),
        (F.least("end", (F.col("lap") + 1) * F.col("source_size")) - F.col("lap") * F.col("source_size")).alias("hi"),
    )
    bucket = F.explode(F.expr(f"sequence(lo div {block_words}, (hi - 1) div {block_words})")).alias("bucket")
    parts = parts.select("*", bucket).withColumnRenamed("sid", "slot_sid").withColumnRenamed("bucket", "slot_bucket")
    rows = streams(sized, per, n_sources)
    spans = rows.withColumn("stop", F.col("start") + F.col("size")).withColumn(
        "bucket", F.explode_outer(F.when(F.col("size") > 0, F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    )
    met = spans.join(parts, (spans.sid == parts.slot_sid) & (spans.bucket == parts.slot_bucket), "left")
    edge_lo = F.greatest("start", F.col("bucket") * block_words, "lo")
    edge_hi = F.least("stop", (F.col("bucket") + 1) * block_words, "hi")
    part = F.when(F.col("hi").isNotNull(), F.greatest(F.lit(0).cast("long"), edge_hi - edge_lo)).otherwise(F.lit(0).cast("long"))
    same = ["uid", "doc_id", "h", "size", "source", "source_size", "target"]
    return met.groupBy(*same).agg(F.sum(part).alias("taken"), F.min(F.when(part > 0, F.col("position"))).alias("position"))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int, bool]:
    """A row for each time that a document is taken whole: doc_id, h, source, position and begin (in its source's stream); a number
    above all positions; and whether rows repeat id, text and source."""
    sized = measure(docs)
    per, n_sources = source_targets(sized, weights, share, cap)
    slots, grid = schedule(per, block_words)
    slots = slots.select(F.col("sid").alias("__sid"), F.col("rank").alias("__rank"), "position")
    rows = streams(sized, per, n_sources).where("size > 0")
    lap = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cap).cast("long"))).alias("lap")
    rows = rows.select("*", lap).withColumn("begin", F.col("start") + F.col("lap") * F.col("source_size"))
    rows = rows.where(F.col("begin") * 2 + F.col("size") <= F.col("goal") * 2)
    rows = rows.withColumn("rank", F.expr(f"begin div {block_words}"))
    met = rows.join(slots, (F.col("sid") == F.col("__sid")) & (F.col("rank") == F.col("__rank")))
    repeated = not sized.groupBy("doc_id", "h", "source").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return met.select("doc_id", "h", "source", "position", "begin"), grid, repeated


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents, with the columns of the input, in the order of the mix: partitions are equal ranges of positions, each
    in order. Positions hold equally many words, so the partitions do as well."""
    got, grid, repeated = copies(docs, **settings)
    got = got.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("source").alias("__source"), "position", "begin")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    held = held.withColumns({"__key": F.xxhash64("__row.doc_id", "__row.text"), "__doc": F.col("__row.doc_id"), "__from": F.col("__row.source")})
    held = held.dropDuplicates(["__key", "__doc", "__from"]) if repeated else held
    both = held.join(got, (held["__key"] == got["__h"]) & held["__doc"].eqNullSafe(got["__id"]) & held["__from"].eqNullSafe(got["__source"]))
    wide = C.shuffle_width(docs.sparkSession)
    both = both.select("__row", "position", "begin", F.floor(F.col("position") / grid * wide).cast("int").alias("part"))
    return both.repartitionById(wide, "part").sortWithinPartitions("position", "begin").select("__row.*")
