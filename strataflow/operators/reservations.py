"""Requests that draw on accounts, decided in their order: one is accepted if every account that it draws on still holds enough
after the requests accepted before it; a refused one takes nothing.

A round bounds from both sides what was drawn before a request: by those accepted for sure, and by those not refused. A request
that fits the upper bound everywhere is accepted, one that breaks a lower bound is refused. After `ROUNDS` rounds mostly few are
open. These fall into groups that share accounts, by connected components, and each group is decided in one pass in the order of
requests; its task streams the sorted requests and holds one number an account of the group. Decisions of a group depend on one
another in turn, so a group is one task's work, however the rest is dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from ..sources.files import discard
from .graphs import components
from .ranking import staged_at

ROUNDS = 3


def _decide_in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, said) from rows (component, seq, account, amount, room) sorted by component and seq."""
    group, drawn, now, parts, out = None, {}, None, [], []

    def shut() -> None:
        if parts:
            fits = all(drawn.get(a, 0.0) + amount <= room for a, amount, room in parts)
            if fits:
                for a, amount, _ in parts:
                    drawn[a] = drawn.get(a, 0.0) + amount
            out.append((now, fits))
            parts.clear()

    def handed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_())], ["seq", "said"])
        out.clear()
        return made

    for batch in batches:
        for component, seq, account, amount, room in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (component, seq) != (group, now):
                shut()
            if component != group:
                drawn.clear()
            group, now = component, seq
            parts.append((account, amount, room))
        yield handed()
    shut()
    yield handed()


def decide(draws: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(seq, accepted) from rows (seq, account, amount, held): a row for each account that a request draws on, which holds `held`
    at first; null where there is no such account. Empty gives empty."""
    spark = draws.sparkSession
    unknown = F.max(F.col("held").isNull()).over(Window.partitionBy("seq"))
    rows, path = staged_at(draws.select("seq", F.col("account").cast("string").alias("account"), F.col("amount").cast("double").alias("amount"), F.col("held").cast("double").alias("held"), F.when(unknown, False).alias("accepted")), "draws")
    before = Window.partitionBy("account").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    drawn = lambda counts: F.coalesce(F.sum(F.when(counts, F.col("amount"))).over(before), F.lit(0.0))
    for _ in range(rounds):
        if rows.where("accepted is null").isEmpty():
            return rows.groupBy("seq").agg(F.min("accepted").alias("accepted"))
        low, high = drawn(F.col("accepted")), drawn(F.coalesce("accepted", F.lit(True)))
        bounds = rows.withColumns({"low": low + F.col("amount"), "high": high + F.col("amount")})
        verdict = F.when(F.min(F.col("high") <= F.col("held")), True).when(F.max(F.col("low") > F.col("held")), False)
        said = bounds.where("accepted is null").groupBy(F.col("seq").alias("__seq")).agg(verdict.alias("said"))
        after, new = staged_at(rows.join(said, F.col("seq") == F.col("__seq"), "left").withColumn("accepted", F.coalesce("accepted", "said")).drop("__seq", "said"), "draws")
        discard(spark, path)
        rows, path = after, new
    ship(spark)
    known = rows.withColumn("room", F.col("held") - drawn(F.col("accepted"))).where("accepted is null")
    opened, _ = staged_at(known.select("seq", "account", "amount", "room"), "open")
    hubs = opened.groupBy("seq").agg(F.min("account").alias("hub"))
    groups = components(opened.join(hubs, "seq"), "account", "hub").select(F.col("node").alias("__node"), "component")
    sorted_rows = opened.join(groups, F.col("account") == F.col("__node")).select("component", "seq", "account", "amount", "room").repartition("component").sortWithinPartitions("component", "seq")
    late = sorted_rows.mapInArrow(_decide_in_turn, "seq long, said boolean").select(F.col("seq").alias("__seq"), "said")
    whole = rows.groupBy("seq").agg(F.min("accepted").alias("accepted"))
    return whole.join(late, F.col("seq") == F.col("__seq"), "left").select("seq", F.coalesce("accepted", "said").alias("accepted"))
