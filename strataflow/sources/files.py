"""Files as sources and sinks: CSV, JSON lines, and a postings index kept as Parquet."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path that driver and executors share: below spark.checkpoint.dir, or a temporary one in local mode. It is removed when
    the driver ends, or by `discard`."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        path = f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
        atexit.register(discard, spark, path)
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix=f"{kind}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}/data"


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path that nothing reads any more."""
    try:
        where, fs = _hadoop(spark, path)
        fs.delete(where, True)
    except Exception:  # the JVM may have gone first; the folder is then left to the cluster's own cleaning
        pass


def stamps(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Size and time of each data file below a path, or of the path itself."""
    where, fs = _hadoop(spark, path)
    found, listed = {}, fs.listFiles(where, True)
    while listed.hasNext():
        f = listed.next()
        name = f.getPath().getName()
        if not name.startswith(("_", ".")):
            found[f.getPath().toString()] = (f.getLen(), f.getModificationTime())
    return found


def write_csv(df: DataFrame, path: str) -> str:
    """Rows as CSV with a header; quotes and line breaks in values are kept."""
    df.write.option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV by a given schema. NUL characters go from text; a row that doesn't fit the schema is dropped."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\\N").option("mode", "DROPMALFORMED").csv(path)
    return df.select(*[F.translate(c, "\0", "").alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])


def write_texts(df: DataFrame, key: str, body: str, path: str) -> str:
    """Texts as text files in folders, a line for each: the key, a tab, and the text in base 64, which keeps its line breaks. The line
    of a null text ends with the key; an empty text has the tab."""
    folder = F.pmod(F.xxhash64(key), F.lit(TEXT_FOLDERS)).alias("folder")
    line = F.concat_ws("\t", F.coalesce(F.col(key).cast("string"), F.lit("")), F.regexp_replace(F.base64(F.encode(F.col(body), "UTF-8")), r"\s", "")).alias("value")
    df.select(folder, line).write.partitionBy("folder").text(path)
    return path


def read_texts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Texts that `write_texts` wrote: the key and the text. An empty key is null where keys aren't text."""
    (key, kind), (body, _) = (x.split() for x in schema.split(", "))
    parts = F.split("value", "\t", 2)
    first = F.get(parts, 0)
    first = first if kind == "string" else F.when(first != "", first).cast(kind)
    return spark.read.text(path).select(first.alias(key), F.decode(F.unbase64(F.get(parts, 1)), "UTF-8").alias(body))


#: Folders that texts are dealt into.
TEXT_FOLDERS = 16
INDEX_SCHEMA = "term string, part int, ids array<long>, freqs array<long>"


def save_index(lists: DataFrame, universe: DataFrame, path: str) -> str:
    """Posting lists (term, part, ids, freqs) as their tasks have them, each task's in order of term, so that a look-up by term
    reads few row groups of a file; and beside them the ids of all documents."""
    lists.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/lists")
    universe.write.parquet(f"{path}/universe")
    return path


def load_index(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """The lists and ids of an index, from one segment or several. A term then has a list for each segment and part."""
    lists = spark.read.schema(INDEX_SCHEMA).parquet(*[f"{p}/lists" for p in paths])
    universe = spark.read.schema("part int, ids array<long>").parquet(*[f"{p}/universe" for p in paths])
    if len(paths) > 1:
        universe = universe.groupBy("part").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return lists, universe
