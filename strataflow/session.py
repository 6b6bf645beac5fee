"""Session and table access shared by every query."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .sources.files import stamps

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build_session(cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session with the settings that the queries are developed with."""
    cpus = cpus or os.cpu_count() or 8
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": "strataflow",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.cteRecursionLevelLimit": "2000",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; works for a file, a folder and any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register input tables as temporary views for the SQL-text queries."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


#: Bytes of input files that one shuffle partition is for, and that a read gives one task.
SPREAD_BYTES = 16 << 20


def spread(spark: SparkSession, sf_dir: str, *names: str, size: int = SPREAD_BYTES) -> None:
    """Let a query's tasks stay of one size however large its tables are: the session gets a shuffle partition for each `size` bytes of
    their files, if it has fewer, and reads files, and joins small partitions, in pieces of that size, if it has larger ones. Settings stay so."""
    total = sum(n for name in names for n, _ in stamps(spark, f"{sf_dir}/{name}.parquet").values())
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < -(-total // size):
        spark.conf.set("spark.sql.shuffle.partitions", str(-(-total // size)))
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > size:
            spark.conf.set(name, str(size))


_SHIPPED: dict = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a context; queries that run Python there call this first."""
    context = spark.sparkContext
    if _SHIPPED.get("to") is context:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strataflow-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _SHIPPED["to"] = context
