"""k-means by Lloyd's rounds: each is one pass that assigns rows to the centres in the plan and adds up each cluster's array.

Centres are k arrays, with k times dimensions bounded by `MOST_VALUES`, held by the driver. Of equally near centres (squared distances rounded to
nine digits) the first counts. A cluster without rows keeps its centre. Null vectors are in no cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_VALUES = 1_000_000


def seeds(rows: DataFrame, key: str, x: str, k: int) -> list[list[float]]:
    """The vectors of the k rows whose keys have the least digests: the same at every run, and spread over the table."""
    chosen = rows.where(F.col(x).isNotNull()).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(k).select(x).collect()
    return [[float(v) for v in r[0]] for r in chosen]


def nearest(x: str, centres: list[list[float]]) -> Column:
    """The number of the nearest centre."""
    if not centres:
        return F.lit(None).cast("int")
    if len(centres) * len(centres[0]) > MOST_VALUES:
        raise ValueError("too many centres for one plan")
    square = lambda c: F.aggregate(F.zip_with(x, F.lit(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    told = F.array_min(F.array(*[F.struct(F.round(square(c), 9).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centres)]))
    return F.when(F.col(x).isNotNull(), told["c"])


def lloyd(rows: DataFrame, x: str, centres: list[list[float]], rounds: int, tolerance: float = 0.0) -> list[list[float]]:
    """The centres after some rounds, or sooner if none moves by more than the tolerance in any dimension."""
    for _ in range(rounds if centres else 0):
        sums = rows.where(F.col(x).isNotNull()).groupBy(nearest(x, centres).alias("c")).agg(*[F.avg(F.col(x)[i]).alias(f"m{i}") for i in range(len(centres[0]))])
        after = list(centres)
        for r in sums.collect():  # a row a cluster
            after[r[0]] = [float(v) for v in r[1:]]
        moved = max(abs(a - b) for old, new in zip(centres, after, strict=True) for a, b in zip(old, new, strict=True))
        centres = after
        if moved <= tolerance:
            break
    return centres
