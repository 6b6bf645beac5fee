"""Structured Streaming forms, run to the end of their input by an available-now trigger.

Results go to files in the shared folder and are read back, so no result is gathered in the driver. Rows of a key are put in order
within a trigger before they change the key's state, so results don't depend on how rows come in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import tokenize
from ..operators import ranking
from ..session import ship, table
from ..sources.files import scratch_path


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table as a stream of files: a folder of parts, or the one file named by a glob."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def _run(stream: DataFrame, path: str, mode: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream to the end of its input, from where the checkpoint below `path` left off: into files, or to `each` batch."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    (writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{path}/rows")).start().awaitTermination()


def _appended(stream: DataFrame) -> DataFrame:
    """The rows of a stream whose rows are final once they come."""
    path = scratch_path(stream.sparkSession, "stream")
    _run(stream, path, "append")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def _batches(stream: DataFrame, mode: str) -> DataFrame:
    """The rows of all batches of a stream, with the batch's number as `batch`. A batch that is run again replaces its files."""
    path = scratch_path(stream.sparkSession, "stream")
    _run(stream, path, mode, lambda df, i: df.write.mode("overwrite").parquet(f"{path}/rows/batch={i}"))
    return stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/rows")


def _last(stream: DataFrame) -> DataFrame:
    """The whole result as the last batch gave it."""
    rows = _batches(stream, "complete")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(last)).drop("batch")


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of tokens, kept as documents arrive."""
    tokens = _source(spark, sf_dir, "documents").select(F.explode(tokenize(F.col("text"))).alias("term"))
    return _last(tokens.groupBy("term").agg(F.count("*").alias("freq")))


#: How late events may come, in hours.
LATE_HOURS = 1


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day and type. A day is given out, and its state dropped, once the watermark has passed its end."""
    rows = _source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{LATE_HOURS} hours")
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return _appended(out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n"))


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows of a key within a trigger, in order."""
    return pd.concat(batches).sort_values(by)


def _answers(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get[0] if state.exists else False
    said = []
    for kind in _in_order(batches, ["event_id"]).event_type:
        said.append(("Exist" if held else "OK") if kind == "signup" else "OK" if held else "NoSuchWord")
        held = kind == "signup" or (held and kind != "error")
    state.update((held,))
    yield pd.DataFrame({"word": key[0], "answers": [",".join(said)]})


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed dictionary fed by a log of commands: signup adds a word, error removes it, others look it up. One row a key and
    trigger has the answers in the order of the commands."""
    ship(spark)
    rows = _source(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("word"), "event_id", "event_type")
    return _appended(rows.groupBy("word").applyInPandasWithState(_answers, "word long, answers string", "held boolean", "append", GroupStateTimeout.NoTimeout))


#: Seconds that a cached value lasts.
CACHE_SECONDS = 6 * 3600


def _cached(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    filled = state.get[0] if state.exists else None
    rows, hits = _in_order(batches, ["at", "event_id"]), 0
    for at, change in zip(rows["at"], rows["change"], strict=True):
        if change:
            filled = None
        elif filled is not None and at < filled + CACHE_SECONDS:
            hits += 1
        else:
            filled = int(at)
    reads = int((~rows["change"]).sum())
    state.update((filled,))
    yield pd.DataFrame({"user_id": [key[0]], "hits": [hits], "misses": [reads - hits]})


def _look_ups(spark: SparkSession, sf_dir: str, changes: str) -> DataFrame:
    ship(spark)
    rows = _source(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.expr(changes).alias("change"))
    out = rows.groupBy("user_id").applyInPandasWithState(_cached, "user_id long, hits long, misses long", "filled long", "append", GroupStateTimeout.NoTimeout)
    return _appended(out).groupBy("user_id").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups by user in a cache whose values last a fixed time from the look-up that missed them."""
    return _look_ups(spark, sf_dir, "false")


def cache_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where a purchase changes the value and so throws it out of the cache."""
    return _look_ups(spark, sf_dir, "event_type = 'purchase'")


def route_lines(stream: DataFrame, path: str) -> None:
    """Deal lines (doc_id, text) to two files in turn, by their number in the stream. How many lines a batch has is written before
    its lines, so a stream that is started anew, or runs a batch again, counts on from the batches before."""
    spark = stream.sparkSession

    def route(df: DataFrame, i: int) -> None:
        rows = ranking.staged(ranking.ranked(df.select("doc_id", F.translate("text", "aeiouAEIOU", "").alias("line")), F.col("doc_id")), "routed")
        rows.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={i}")
        counts = spark.read.schema("n long, batch int").parquet(f"{path}/counts")
        before = counts.where(F.col("batch") < i).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        odd = (F.col("place") + before) % 2 == 1
        for child, own in (("first", odd), ("second", ~odd)):
            rows.where(own).drop("place").write.mode("overwrite").parquet(f"{path}/rows/child={child}/batch={i}")

    _run(stream, path, "append", route)


def line_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt to two files in turn. They arrive in two parts, and the stream is started anew for the second."""
    path = scratch_path(spark, "stream")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = docs.agg((F.max("doc_id") + F.min("doc_id")) / 2).first()[0]
    first = F.col("doc_id") < F.lit(middle)
    for part in (first, ~F.coalesce(first, F.lit(False))):
        docs.where(part).write.mode("append").parquet(f"{path}/arrived")
        route_lines(spark.readStream.schema(docs.schema).parquet(f"{path}/arrived"), path)
    return spark.read.schema("doc_id long, line string, child string, batch int").parquet(f"{path}/rows").drop("batch")


#: Notifications that a user keeps.
KEPT = 100


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = list(zip(*state.get, strict=True)) if state.exists else []
    for rows in batches:
        held = sorted([*held, *zip(rows["at"].tolist(), rows["event_id"].tolist(), strict=True)], reverse=True)[:KEPT]
    state.update(([a for a, _ in held], [e for _, e in held]))
    yield pd.DataFrame({"user_id": [key[0]], "events": [[e for _, e in held]]})


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events of each user, kept as state and given out anew by each batch that changes them."""
    ship(spark)
    rows = _source(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = rows.groupBy("user_id").applyInPandasWithState(_newest, "user_id long, events array<long>", "at array<long>, event array<long>", "update", GroupStateTimeout.NoTimeout)
    newest = _batches(out, "update").groupBy("user_id").agg(F.max_by("events", "batch").alias("events"))
    return newest.select("user_id", F.explode("events").alias("event_id"))


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl's frontier that is stopped and resumed: urls arrive as files, the first run takes those that are there, and the
    second goes on from the checkpoint, with the urls seen before as its state. Each url is given out once."""
    path = scratch_path(spark, "stream")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    for part, run in ((F.col("page_id") % 3 < 2, 1), (F.col("page_id") % 3 >= 1, 2)):
        pages.where(part).write.mode("append").parquet(f"{path}/arrived")
        found = spark.readStream.schema("page_id long, url string").parquet(f"{path}/arrived").select("url", F.lit(run).alias("run"))
        _run(found.dropDuplicates(["url"]), path, "append")
    return spark.read.schema("url string, run int").parquet(f"{path}/rows").select("url")


def distinct_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the kinds of their events, each once as long as the watermark remembers it."""
    rows = _source(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "2 hours")
    return _appended(rows.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"))
