"""Places and running sums over a whole table's order, without a task that sees all rows.

Rows are dealt into ranges of the order and staged; each range is summed, the ranges' sums are added up on the driver (one row a
partition), and each range counts on from there by a window of its own.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch_path

PLACE = "place"


def staged_at(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """A table written to the shared folder and read back, and its path, for `files.discard`."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, kind: str) -> DataFrame:
    """A table written to the shared folder and read back."""
    return staged_at(df, kind)[0]


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, following: str | None = None) -> DataFrame:
    """Add `place` (from 1), for each name in `sums` the sum of its column over the rows up to this one, and, where `following`
    names a column, next_<name>: its value in the next row (null in the last). Rows that are equal in the order are taken in
    any order. Repeated rows count each; an empty table stays empty."""
    named = {PLACE: F.lit(1).cast("long")} | (sums or {})
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = staged(ranged.withColumns({f"__{k}": v for k, v in named.items()}), "ranges")
    first = [F.min_by(following, F.struct(*order)).alias("__first")] if following else []
    parts = ranged.groupBy("__part").agg(*[F.sum(f"__{k}").alias(k) for k in named], *first).orderBy("__part").collect()
    kinds = dict(ranged.dtypes)
    kinds |= {k: "double" if kinds[f"__{k}"] in ("double", "float") else "bigint" for k in named}
    before = {k: [*accumulate((r[k] or 0 for r in parts), initial=0.0 if kinds[k] == "double" else 0)] for k in named}
    rows = [(r["__part"], *[before[k][i] for k in named], parts[i + 1]["__first"] if following and i + 1 < len(parts) else None) for i, r in enumerate(parts)]
    schema = ", ".join(["`__at` int", *[f"`__before_{k}` {kinds[k]}" for k in named], f"`__after` {kinds[following] if following else 'int'}"])
    offsets = df.sparkSession.createDataFrame(rows, schema)
    within = Window.partitionBy("__part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(offsets), F.col("__part") == F.col("__at"))
    added = {k: F.sum(f"__{k}").over(upto) + F.col(f"__before_{k}") for k in named}
    if following:
        added[f"next_{following}"] = F.coalesce(F.lead(following).over(within), "__after")
    return out.withColumns(added).drop("__part", "__at", "__after", *[f"__{k}" for k in named], *[f"__before_{k}" for k in named])


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Add `place`, the row's number from 1 in the order."""
    return running(df, list(order))


def running_by(df: DataFrame, by: list[str], value: str, sums: dict[str, str]) -> DataFrame:
    """Add, for each name in `sums`, the sum of its column over the rows of the same group up to this one in the order of `value`, and
    next_<value>: the value of the group's next row. Groups are few (they come to the driver, once for each range that they lie in),
    and may be of any size; (by, value) must be unique."""
    order = [F.col(c) for c in (*by, value)]
    ranged = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("__part", *by).agg(*[F.sum(v).alias(f"__{k}") for k, v in sums.items()], F.min(value).alias("__first"))
    rows = sorted(parts.collect(), key=lambda r: (*[r[c] for c in by], r["__part"]))
    held: dict[str, float] = {}
    out = []
    for i, r in enumerate(rows):
        same = i > 0 and all(rows[i - 1][c] == r[c] for c in by)
        held = {k: held[k] + rows[i - 1][f"__{k}"] if same else 0 for k in sums}
        after = rows[i + 1] if i + 1 < len(rows) and all(rows[i + 1][c] == r[c] for c in by) else None
        out.append((r["__part"], *[r[c] for c in by], *[float(held[k]) for k in sums], after["__first"] if after else None))
    kinds = dict(ranged.dtypes)
    schema = ", ".join(["`__at` int", *[f"`__by_{c}` {kinds[c]}" for c in by], *[f"`__before_{k}` double" for k in sums], f"`__after` {kinds[value]}"])
    offsets = df.sparkSession.createDataFrame(out, schema)
    within = Window.partitionBy("__part", *by).orderBy(value)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.col("__part") == F.col("__at")
    for c in by:
        on = on & (F.col(c) == F.col(f"__by_{c}"))
    joined = ranged.join(F.broadcast(offsets), on)
    added = {k: F.sum(v).over(upto) + F.col(f"__before_{k}") for k, v in sums.items()} | {f"next_{value}": F.coalesce(F.lead(value).over(within), "__after")}
    return joined.withColumns(added).drop("__part", "__at", "__after", *[f"__by_{c}" for c in by], *[f"__before_{k}" for k in sums])
