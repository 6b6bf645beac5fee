"""Streams with state of their own by key (lists, values, timers), stopped and resumed while their input arrives.

Events come in `FILES` files in the order of time. The stream is started anew for each, as after a restart, and goes on from its
checkpoint: state and timers outlive the run. State is kept in RocksDB, in a session of its own, so that the
user's session keeps its settings. Rows of a key are put in order within a trigger. Timers let go of state once the watermark says
that nothing can need it any more. A null key is a key; an empty input gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import ranking
from ..session import ship, table
from ..sources.files import scratch_path

# The driver's worker for these streams doesn't see files sent to executors, so processors go to it whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES = 4
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def resumed(rows: DataFrame, order: list[str], stream: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """The rows that a stream gives out, with the run's number as `run`, while `rows` arrive in FILES files by `order`."""
    spark = rows.sparkSession
    ship(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    path = scratch_path(spark, "stateful")
    placed = ranking.staged(ranking.ranked(rows, *[F.col(c) for c in order]), "arrivals")
    n = placed.count()
    for run in range(FILES):
        placed.where(F.expr(f"(place - 1) * {FILES} div {max(n, 1)}") == run).drop("place").write.mode("append").parquet(f"{path}/in")
        out = stream(own.readStream.schema(rows.schema).parquet(f"{path}/in")).withColumn("run", F.lit(run))
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{schema}, run int").parquet(f"{path}/out")


class Newest(StatefulProcessor):
    """A list state of the newest events of a key."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "at long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        now = sorted([*before, *((r.at, r.event_id) for r in rows)], reverse=True)[: self.keep]
        self.held.put(now)
        yield Row(user_id=key[0], events=[e for _, e in now])

    def close(self) -> None:
        pass


def newest_events(spark: SparkSession, sf_dir: str, keep: int = 100) -> DataFrame:
    """(user_id, event_id): the newest events of each user, as the last run that saw the user gave them out."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    schema = "user_id long, events array<long>"
    out = resumed(rows, ["at", "event_id"], lambda s: s.groupBy("user_id").transformWithState(Newest(keep), schema, "append", "none"), schema)
    return out.groupBy("user_id").agg(F.max_by("events", "run").alias("events")).select("user_id", F.explode("events").alias("event_id"))


class Cache(StatefulProcessor):
    """A value state of when a key's cached value was filled. A timer drops it once it can't be a hit any more."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.filled = handle.getValueState("filled", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        filled = self.filled.get()[0] if self.filled.exists() else None
        start, hits, misses = filled, 0, 0
        for r in sorted(rows, key=lambda r: (r.at, r.event_id)):
            if filled is not None and r.at < filled + self.seconds:
                hits += 1
            else:
                filled, misses = r.at, misses + 1
        if filled != start:
            self.filled.update((filled,))
            self.handle.registerTimer((filled + self.seconds) * 1000)
        yield Row(user_id=key[0], hits=hits, misses=misses)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a later fill has a timer of its own
        if self.filled.exists() and (self.filled.get()[0] + self.seconds) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.filled.clear()
        return iter(())

    def close(self) -> None:
        pass


def cache_hits(spark: SparkSession, sf_dir: str, seconds: int = 6 * 3600) -> DataFrame:
    """(user_id, hits, misses): look-ups by user in a cache whose values last a fixed time."""
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ts.alias("ts"), F.unix_timestamp(ts).alias("at"))
    schema = "user_id long, hits long, misses long"
    out = resumed(rows, ["ts", "event_id"], lambda s: s.withWatermark("ts", "1 hour").groupBy("user_id").transformWithState(Cache(seconds), schema, "append", "eventTime"), schema)
    return out.groupBy("user_id").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


class Once(StatefulProcessor):
    """A value state that remembers a key for a time after its first event; a timer forgets it."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: (r.at, r.event_id))
        if not self.known.exists():
            self.known.update((first.at,))
            self.handle.registerTimer(first.at // 1000 + self.seconds * 1000)
            yield Row(user_id=key[0], event_type=key[1], event_id=first.event_id)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def distinct_within(spark: SparkSession, sf_dir: str, seconds: int = 2 * 3600) -> DataFrame:
    """(user_id, event_type, event_id, run): the first event of each user and kind in a run, unless the watermark, that long behind the
    newest event of earlier runs, still remembers one."""
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", ts.alias("ts"), F.unix_micros(ts).alias("at"))
    schema = "user_id long, event_type string, event_id long"
    return resumed(rows, ["ts", "event_id"], lambda s: s.withWatermark("ts", f"{seconds} seconds").groupBy("user_id", "event_type").transformWithState(Once(seconds), schema, "append", "eventTime"), schema)
