"""Sharding over fixed virtual slots.

A record's id is hashed into one of a fixed number of virtual slots. A small, versioned table maps slots to shards;
adding or rebalancing shards edits that table and never touches the hash. The law is `key`: the id and the number of
shards alone decide. A shard that is added takes whole slots from the others, and nothing moves between the others. Bytes are
summed by slot, and a further version of the map is edited from them, so that shards come near to equal bytes where needed.

Defined cases: a null text has no bytes; a null doc_id hashes like any one value; repeated rows are rows of their own and
take places of their own, next to one another; an empty table gives an empty result, and a map without bytes to balance is
left as it is. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SLOTS = 4096
SHARDS = 24
RECORD_OVERHEAD = 8
#: Parts that the rows of one slot are dealt into while they are numbered, and repeated rows that are written at a time.
SUBSLOTS, PIECE = 16, 4096


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot for a number of shards. Built by growing from one shard: the shard that is added takes its part of
    the slots one at a time, each from the shard that then has most (the lowest of equals), from its high end."""
    held: list[list[int]] = [list(range(slots))]
    for n in range(2, shards + 1):
        new: list[int] = []
        while len(new) < slots // n:
            giver = max(range(n - 1), key=lambda s: (len(held[s]), -s))
            new.append(held[giver].pop())
        held.append(sorted(new))
    where = [0] * slots
    for shard, own in enumerate(held):
        for slot in own:
            where[slot] = shard
    return where


def rebalance(where: list[int], bytes_by_slot: list[int], tolerance: float = 0.02) -> list[int]:
    """The next version of a map, edited so that no shard holds more than (1 + tolerance) of its part of the bytes where
    whole slots allow it: the heaviest shard gives the lightest its largest slot that narrows the gap between the two."""
    where = list(where)
    shards = max(where) + 1
    load = [0] * shards
    for slot, shard in enumerate(where):
        load[shard] += bytes_by_slot[slot]
    goal = sum(load) / shards
    while True:
        high, low = max(range(shards), key=lambda s: load[s]), min(range(shards), key=lambda s: load[s])
        gap = load[high] - load[low]
        fit = [s for s, shard in enumerate(where) if shard == high and 0 < bytes_by_slot[s] < gap]
        if load[high] <= goal * (1 + tolerance) or not fit:
            return where
        slot = max(fit, key=lambda s: min(bytes_by_slot[s], gap - bytes_by_slot[s]))
        where[slot] = low
        load[high] -= bytes_by_slot[slot]
        load[low] += bytes_by_slot[slot]


def write_map(spark: SparkSession, versions: list[list[int]], path: str, first: int = 1) -> DataFrame:
    """Add versions of a map, numbered from `first`, to a table of rows (version, slot, shard), and read it back."""
    rows = [(v, s, shard) for v, where in enumerate(versions, first) for s, shard in enumerate(where)]
    spark.createDataFrame(rows, "version int, slot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return read_map(spark, path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("slot int, shard int, version int").parquet(path)


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Stage one narrow row a record: doc_id, size in bytes, checksum of the text, and its virtual slot."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return C.stage(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + RECORD_OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("vslot"),
        ),
        "shard-rows",
    )


def bytes_by_slot(rows: DataFrame) -> DataFrame:
    """Bytes and records of each virtual slot."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


def write_rebalanced(rows: DataFrame, path: str, version: int, tolerance: float = 0.02) -> int:
    """Edit a stored version of a map by the bytes that its slots hold in `rows`; returns the number of the version written. The
    sums, as many as there are slots, come to the driver."""
    spark = rows.sparkSession
    where = {r.slot: r.shard for r in read_map(spark, path).where(F.col("version") == version).collect()}
    held = {r.vslot: r.bytes for r in bytes_by_slot(rows).collect()}
    edited = rebalance([where[s] for s in range(len(where))], [held.get(s, 0) for s in range(len(where))], tolerance)
    latest = read_map(spark, path).agg(F.max("version")).first()[0]
    write_map(spark, [edited], path, latest + 1)
    return latest + 1


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Per record: doc_id, size, text_crc32, vslot, shard, place (gapless from 0 in the shard), grown_shard (with one more), and
    balanced_shard (by the version of the map that is edited to the bytes of these records)."""
    spark = docs.sparkSession
    path = C.fresh_path(spark, "slot-map")
    write_map(spark, [slot_map(shards, slots), slot_map(shards + 1, slots)], path)
    rows = with_slots(docs, slots)
    edited = write_rebalanced(rows, path, 1)
    table = read_map(spark, path)
    # the map has `slots` rows a version, whatever the size of the input
    for version, name in ((1, "shard"), (2, "grown_shard"), (edited, "balanced_shard")):
        one = table.where(F.col("version") == version).select(F.col("slot").alias(f"__{name}"), F.col("shard").alias(name))
        rows = rows.join(F.broadcast(one), rows.vslot == F.col(f"__{name}")).drop(f"__{name}")
    same = ["doc_id", "size", "text_crc32", "vslot", "shard", "grown_shard", "balanced_shard"]
    rows = rows.groupBy(*same).agg(F.count("*").alias("n"))
    deal = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SUBSLOTS))
    rows = rows.withColumn("chunk", F.col("vslot") * SUBSLOTS + deal)
    rows = C.running_total(rows, ["shard"], "chunk", ["doc_id", "text_crc32", "size"], "n", "before")
    # a row that is repeated often is written in pieces by many tasks
    rows = rows.select(*same, "n", "before", F.explode(F.expr(f"sequence(0L, (n - 1) div {PIECE})")).alias("piece"))
    rows = rows.repartition(C.shuffle_width(spark), "doc_id", "text_crc32", "piece")
    place = F.explode(F.expr(f"sequence(before + piece * {PIECE}, before + least(n, (piece + 1) * {PIECE}) - 1)"))
    return rows.select(*same, place.alias("place"))
