"""Shared pieces of the training-data operators: words, staging, distributed running totals."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[ \t-\r]"

#: Largest table, in rows, that an operator may broadcast after having counted it.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text, in order; a null or blank text has none (an empty array)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir: executors don't share a temporary folder")
    made = _LOCAL.get("dir")
    if not made:
        made = _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="strataflow-")
        atexit.register(_remove_local)
    return made


_LOCAL: dict[str, str] = {}


def _remove_local() -> None:
    import shutil

    shutil.rmtree(_LOCAL.pop("dir", "file://")[len("file://") :] or "/nonexistent", ignore_errors=True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/strataflow-{kind}-{uuid.uuid4().hex}"
    if shared_dir(spark) != _LOCAL.get("dir"):
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have gone first; the folder is then left to the cluster's own cleaning
        pass


def stage(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    tidy(df.sparkSession)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def checkpointed(df: DataFrame) -> DataFrame:
    """A table checkpointed in the shared folder. Spark removes its files once no plan refers to it, where it is set to."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    tidy(df.sparkSession)
    return df.checkpoint()


#: MB in use on the driver's heap, garbage included, from which it is collected between steps.
HEAP_MB = 160


def tidy(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage if there is much. Plans of many steps leave garbage behind, for which an idle heap
    would rather grow to its limit than be collected; what is live is a small part of it."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > HEAP_MB << 20:
        spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are staged. Spark deletes them once the driver's JVM has collected the
    objects that stand for them, which an idle heap may put off until a long query has filled the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in staged:
        _remove(df.sparkSession, df.staged_path)


#: Rows and bytes of an Arrow batch that goes to Python, the same for all operators.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def ready_python(spark: SparkSession) -> None:
    """Before Python runs on executors: bound the session's Arrow batches, and send them this package, once a context. Plans read
    the bounds when they run, so they are the same for every operator and stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table of `rows` counted rows for broadcast if that is within the limit; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_bits(rows: int) -> int:
    """Bits k such that 2^k is about the square root of the rows: chunks and rows per chunk then grow alike."""
    return max(1, (max(rows, 1).bit_length() + 1) // 2)


def running_total(df: DataFrame, keys: list[str], chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same `keys` that come before in the order (chunk, *order).

    Two levels: sums per chunk, a running sum over the chunks of each key, then a running sum within each chunk.
    No task ever holds more than one chunk or one key's list of chunks.
    """
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, chunk)
        .agg(F.sum(value).alias("__chunk_sum"))
        .withColumn("__offset", F.coalesce(F.sum("__chunk_sum").over(before), F.lit(0).cast("long")))
    )
    named = offsets.select(*[F.col(c).alias(f"__k_{c}") for c in (*keys, chunk)], "__offset")
    on = [df[c].eqNullSafe(named[f"__k_{c}"]) for c in (*keys, chunk)]
    joined = df.join(named, on, "left")
    within = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("__offset") + F.coalesce(F.sum(value).over(within), F.lit(0).cast("long"))
    return joined.withColumn(out, total).drop("__offset", *[f"__k_{c}" for c in (*keys, chunk)])


def ordered_chunks(df: DataFrame, order: Column, kind: str = "ranged") -> DataFrame:
    """Stage a table in range partitions of `order`, with the partition's number as column `__pid`."""
    return stage(df.repartitionByRange(order).withColumn("__pid", F.spark_partition_id()), kind)
