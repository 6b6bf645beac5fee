"""A stored table that loads change: rows by key in hash buckets, of which a load rewrites only those with changes.

A load's rows are told apart by key into new ones, changed ones (another content hash) and same ones; the last row of a key in a load
counts. A same row that differs in other columns takes these but keeps the `order` of its last change. Buckets with such, new or changed rows are staged whole and then overwritten; all others keep their files. A load that is
tried again after a failure ends in the same state, as its rows are then the same ones.

Defined cases: rows with a null key aren't stored; null values are a content like any other; repeated rows are one; an empty load changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import staged
from .files import stamps

BUCKETS = 64


@dataclass(frozen=True)
class BucketStore:
    """path: where the table is; key: its key column; values: the columns whose hash says whether a row changed."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    values: list[str]
    buckets: int = BUCKETS

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _hash(self):
        # a null and an empty text must differ
        return F.md5(F.to_json(F.struct(*self.values), {"ignoreNullFields": "false"}).cast("binary"))

    def _stored(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0))
        return self.spark.read.schema(StructType(self.schema.fields)).option("basePath", self.path).parquet(self.path).withColumn("bucket", self._bucket())

    def rows(self) -> DataFrame:
        """The table as it stands."""
        return self._stored().select(*self.schema.names)

    def files(self) -> dict[str, tuple[int, int]]:
        return stamps(self.spark, self.path)

    def upsert(self, load: DataFrame, order: str, each: str | None = None) -> dict[str, int]:
        """Store a load, the largest `order` of a key last; returns how many rows were new, updated and same. Keys are counted, unless
        `each` names a column: rows of a key then come one after another by (order, each), and each is told from the one before."""
        names = self.schema.names
        rows = load.where(F.col(self.key).isNotNull()).withColumn("__hash", self._hash())
        nth, moved, last = F.lit(1), F.lit(None).cast("boolean"), F.struct(order, "__hash")
        if each:
            within = Window.partitionBy(self.key).orderBy(order, each)
            nth, moved, last = F.row_number().over(within), F.col("__hash") != F.lag("__hash").over(within), F.struct(order, each)
        rows = rows.withColumns({"__nth": nth, "__moved": moved}).groupBy(F.col(self.key).alias("__key")).agg(
            F.max_by(F.struct(*names), last).alias("r"), (F.min_by("__hash", "__nth") if each else F.max_by("__hash", last)).alias("__hash"),
            F.count_if("__moved").alias("__updated"), F.count_if(~F.col("__moved")).alias("__same"),
        )
        rows = staged(rows.select("r.*", "__hash", "__updated", "__same").withColumn("bucket", self._bucket()), "load")
        held = self._stored()
        rest = [c for c in names if c not in (self.key, order, *self.values)]
        since = F.col(order) if order in names else F.lit(None)
        old = held.select(F.col(self.key).alias("__old"), self._hash().alias("__held"), since.alias("__since"), *[F.col(c).alias(f"__old_{c}") for c in rest])
        told = rows.join(old, F.col(self.key) == F.col("__old"), "left")
        kind = F.when(F.col("__old").isNull(), "new").when(F.col("__hash") == F.col("__held"), "same").otherwise("updated")
        still = (kind == "same") & (F.col("__updated") == 0)
        other = still & ~reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__old_{c}")), rest, F.lit(True))
        shown = [F.when(still, F.col("__since")).otherwise(F.col(c)).alias(c) if c == order else F.col(c) for c in names]
        told = staged(told.select(*shown, "bucket", kind.alias("kind"), other.alias("__other"), "__updated", "__same"), "told")
        counts: dict[str, int] = {}
        for r in told.groupBy("kind").agg(F.count("*").alias("n"), F.sum("__updated").alias("updated"), F.sum("__same").alias("same")).collect():
            for k, n in ((r["kind"], r["n"]), ("updated", r["updated"]), ("same", r["same"])):
                counts[k] = counts.get(k, 0) + n
        changed = told.where("kind <> 'same' or __updated > 0 or __other")
        touched = [r[0] for r in changed.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if touched:
            keys = changed.select(F.col(self.key).alias("__gone"))
            kept = held.where(F.col("bucket").isin(touched)).join(keys, F.col(self.key) == F.col("__gone"), "left_anti")
            whole = staged(kept.select(*names, "bucket").union(changed.select(*names, "bucket")), "buckets")
            whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return {k: counts.get(k, 0) for k in ("new", "updated", "same")}
