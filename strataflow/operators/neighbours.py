"""Exact nearest neighbours by pivots.

Pivots are vectors of the table itself, about the square root of its rows. Every vector belongs to the cell of its nearest pivot
and, by its distance from that, to a ring of the cell; the distance is stored once. By the triangle inequality a ring from a to b of
a pivot at distance d from a query holds nothing nearer than max(d - b, a - d). A query first meets the rings with the least of
these bounds that hold k others; the k-th distance found then says which of the other rings can still hold a nearer one, and
it meets those alone. Queries and vectors meet by an equi-join on rings.

Distances are squared and rounded to six digits; of equal ones the smaller key is nearer. Null vectors are left out; all others must
have one length. With fewer than k others a query gets all; an empty table gives no rows. Equal vectors share a ring, which
Spark splits where it is large.

Wide vectors without clusters leave bounds that exclude little, so most pairs are compared. `nearest_in_blocks` is for those: it
compares all pairs, but a block of queries with a block of vectors at a time, by a product of matrices, and gives k rows a query
and block to the shuffle. What a task holds is bounded by the blocks; the work is queries times vectors by nature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .ranking import staged

#: Most pivots, and rings a cell: what is known of all rings is a table of at most their product, held by the driver and the queries.
MOST_PIVOTS, RINGS = 1024, 8
#: Vectors and queries of a block at most, numbers in a block at most, and queries that are compared at a time.
BLOCK_ROWS, BLOCK_QUERIES, BLOCK_VALUES, AT_ONCE = 8_000, 20_000, 2_000_000, 256
#: Room for rounding: bounds come from floating sums, and distances that round alike count as equal.
ROOM = 1e-5


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows of x from rows of pivots."""
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def dist2(a: str, b: str) -> Column:
    """The squared distance of two array columns, rounded."""
    term = "(cast(s as double) - cast(t as double))"
    return F.round(F.expr(f"aggregate(zip_with({a}, {b}, (s, t) -> {term} * {term}), cast(0 as double), (s, t) -> s + t)"), 6)


@dataclass(frozen=True)
class Rings:
    """What queries know of all rings: pivots, and of each ring the least and largest distance from its pivot and its count."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For rows of x and each ring: no vector of the ring is nearer than this."""
        d = np.repeat(distances(x, self.pivots), RINGS, axis=1)
        return np.where(self.count[None] > 0, np.maximum(np.maximum(d - self.high[None], self.low[None] - d), 0), np.inf)

    def first(self, k: int, bounds: np.ndarray) -> list[np.ndarray]:
        """For each query the rings of the least bounds that hold k vectors besides itself."""
        order = np.argsort(bounds, axis=1, kind="stable")
        # the ring at which the count is reached is the last one
        enough = (np.cumsum(self.count[order], axis=1) < k + 1).sum(1) + 1
        return [o[:n][self.count[o[:n]] > 0] for o, n in zip(order, enough, strict=True)]


@dataclass(frozen=True)
class Index:
    """A table with its vectors' rings, as a column `ring`."""

    rows: DataFrame
    key: str
    vector: str
    rings: Rings


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in vectors])


def build(rows: DataFrame, key: str, vector: str, pivots: int | None = None) -> Index:
    """Deal the vectors of a table into rings."""
    ship(rows.sparkSession)
    rows = rows.where(F.col(vector).isNotNull())
    wanted = min(MOST_PIVOTS, pivots or max(1, round(rows.count() ** 0.5)))
    # spread over the table by a hash, so that the choice doesn't depend on its order
    chosen = rows.orderBy(F.xxhash64(key), key).limit(wanted).select(vector).collect()
    points = np.array([list(r[0]) for r in chosen], float)
    if not chosen:
        return Index(rows.withColumn("ring", F.lit(0)), key, vector, Rings(points, *[np.zeros(0)] * 3))

    @F.pandas_udf("cell int, r double")
    def cell(v: pd.Series) -> pd.DataFrame:
        d = distances(_matrix(v), points)
        return pd.DataFrame({"cell": d.argmin(1).astype("int32"), "r": d.min(1)})

    dealt = staged(rows.withColumn("__c", cell(vector)).withColumns({"cell": F.col("__c.cell"), "r": F.col("__c.r")}).drop("__c"), "cells")
    low, reach = np.zeros(len(points)), np.zeros(len(points))
    for r in dealt.groupBy("cell").agg(F.min("r"), F.max("r")).collect():  # a row a pivot
        low[r[0]], reach[r[0]] = r[1], r[2] - r[1]
    at = lambda a: F.element_at(F.lit([float(x) for x in a]), F.col("cell") + 1)
    share = F.when(at(reach) > 0, (F.col("r") - at(low)) / at(reach) * RINGS).otherwise(0.0)
    dealt = dealt.withColumn("ring", F.col("cell") * RINGS + F.least(F.floor(share).cast("int"), F.lit(RINGS - 1)))
    least, most, count = np.zeros(len(points) * RINGS), np.zeros(len(points) * RINGS), np.zeros(len(points) * RINGS)
    for r in dealt.groupBy("ring").agg(F.min("r"), F.max("r"), F.count("*")).collect():  # a row a ring
        least[r[0]], most[r[0]], count[r[0]] = r[1], r[2], r[3]
    return Index(dealt.drop("cell", "r"), key, vector, Rings(points, least, most, count))


def visits(index: Index, queries: DataFrame, k: int, within: str | None = None) -> DataFrame:
    """(q, qv, slot): the rings that each query meets at first, or, with the name of a column of distances, those that it meets besides
    them because they may hold something as near."""

    rings = index.rings

    @F.pandas_udf("array<int>")
    def first(v: pd.Series) -> pd.Series:
        return pd.Series(rings.first(k, rings.bounds(_matrix(v))))

    @F.pandas_udf("array<int>")
    def rest(v: pd.Series, reach: pd.Series) -> pd.Series:
        bounds = rings.bounds(_matrix(v))
        met = rings.first(k, bounds)
        return pd.Series([np.setdiff1d(np.flatnonzero((b <= t + ROOM) & (rings.count > 0)), m) for b, t, m in zip(bounds, reach, met, strict=True)])

    slots = first(index.vector) if within is None else rest(index.vector, within)
    return queries.select(F.col(index.key).alias("q"), F.col(index.vector).alias("qv"), F.explode(slots).alias("slot"))


def _nearest(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k nearest of each query; tasks keep k rows a query before they are shuffled."""
    order = Window.partitionBy("q").orderBy("dist", key)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(index: Index, queries: DataFrame, k: int, carry: list[str] | None = None) -> DataFrame:
    """(q, key, dist, place, and the columns to carry): the k nearest other vectors of each row of `queries`, a table with the index's
    key and vector."""
    key, carry = index.key, carry or []
    if not len(index.rings.pivots):
        return queries.select(F.col(key).alias("q"), key, F.lit(0.0).alias("dist"), F.lit(1).alias("place"), *carry).limit(0)
    queries = queries.where(F.col(index.vector).isNotNull()).select(key, index.vector)

    def met(rings: DataFrame) -> DataFrame:
        pairs = rings.join(index.rows, (F.col("slot") == F.col("ring")) & (F.col("q") != F.col(key)))
        return pairs.select("q", key, dist2("qv", index.vector).alias("dist"), *carry)

    near = staged(_nearest(met(visits(index, queries, k)), key, k), "near").drop("place")
    reach = near.groupBy(F.col("q").alias("__q")).agg(F.when(F.count("*") >= k, F.sqrt(F.max("dist"))).otherwise(float("inf")).alias("reach"))
    known = queries.join(reach, F.col(key) == F.col("__q"), "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))).drop("__q")
    return _nearest(near.unionByName(met(visits(index, known, k, "reach"))), key, k)


def nearest_in_blocks(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, carry: list[str] | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """What `nearest` gives, by comparing blocks of `queries` with blocks of `rows`."""
    carry = carry or []
    spark = rows.sparkSession
    ship(spark)
    rows, queries = rows.where(F.col(vector).isNotNull()), queries.where(F.col(vector).isNotNull())
    n, width = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    fit = max(1, BLOCK_VALUES // max(width or 1, 1))
    row_blocks, query_blocks = -(-n // min(block, fit)) or 1, -(-queries.count() // min(BLOCK_QUERIES, fit)) or 1
    kinds = dict(rows.dtypes)
    own = lambda parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    # a given number of partitions, which adaptive execution leaves apart: blocks are small to shuffle and long to compare
    parts = min(row_blocks * query_blocks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = queries.select(F.col(key).alias("q"), F.col(vector).alias("qv"), own(query_blocks).alias("qb"), every(row_blocks).alias("rb")).repartition(parts, "qb", "rb")
    held = rows.select(key, vector, *carry, own(row_blocks).alias("rb"), every(query_blocks).alias("qb")).repartition(parts, "qb", "rb")
    named = [c for c in (key, *carry)]

    def best(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = [have[named].iloc[:0].assign(q=ask["q"].iloc[:0], dist=0.0)]
        if len(ask) and len(have):
            x, keys = _matrix(have[vector]), have[key].to_numpy()
            squares, order = (x * x).sum(1), keys.argsort(kind="stable").argsort(kind="stable")
            for at in range(0, len(ask), AT_ONCE):
                some = ask.iloc[at : at + AT_ONCE]
                y, q = _matrix(some["qv"]), some["q"].to_numpy()
                own = (y * y).sum(1)
                d = squares[None] + own[:, None] - 2 * (y @ x.T)
                d[q[:, None] == keys[None]] = np.inf
                last = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                # all that may round to the k-th distance or less
                i, j = np.nonzero((d <= (last + ROOM * (1 + own * 1e-6))[:, None]) & np.isfinite(d))
                exact = np.concatenate([((y[i[c : c + 100_000]] - x[j[c : c + 100_000]]) ** 2).sum(1) for c in range(0, len(i), 100_000)] or [np.zeros(0)])
                exact = np.floor(exact * 1e6 + 0.5) / 1e6
                by = np.lexsort((order[j], exact, i))
                i, j, exact = i[by], j[by], exact[by]
                place = np.arange(len(i)) - np.searchsorted(i, i, "left")
                i, j, exact = i[place < k], j[place < k], exact[place < k]
                out.append(have[named].iloc[j].assign(q=q[i], dist=exact))
        return pd.concat(out, ignore_index=True)[["q", *named[:1], "dist", *named[1:]]]

    schema = ", ".join([f"q {kinds[key]}", f"`{key}` {kinds[key]}", "dist double", *[f"`{c}` {kinds[c]}" for c in carry]])
    found = asked.groupBy("qb", "rb").cogroup(held.groupBy("qb", "rb")).applyInPandas(best, schema)
    return _nearest(found, key, k)


def compared(index: Index, queries: DataFrame, k: int) -> int:
    """How many pairs of a query and a vector `nearest` computes the distance of."""
    near = nearest(index, queries, k)
    reach = near.groupBy(F.col("q").alias("__q")).agg(F.sqrt(F.max("dist")).alias("reach"))
    sizes = index.rows.groupBy("ring").agg(F.count("*").alias("n"))
    met = visits(index, queries, k).select("slot").union(visits(index, queries.join(reach, F.col(index.key) == F.col("__q")), k, "reach").select("slot"))
    return met.join(sizes, F.col("slot") == F.col("ring")).agg(F.sum("n")).first()[0] or 0
