"""Tables seeded from SQL scripts, and tables read over JDBC."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A string literal, in which two quotes stand for one, or anything up to a quote or semicolon.
PART = re.compile(r"'(?:[^']|'')*'|[^';]+|;")
INSERT = re.compile(r"\s*insert\s+into\s+([\w.]+)\s*\(([^)]*)\)\s*values\s*(.*)", re.IGNORECASE | re.DOTALL)


def statements(script: str) -> list[str]:
    """The statements of a script; semicolons within literals don't end one."""
    out = [""]
    for part in PART.findall(script):
        if part == ";":
            out.append("")
        else:
            out[-1] += part
    return [x.strip() for x in out if x.strip()]


def _literals(values: str) -> str:
    """Literals with doubled quotes in the form that the SQL parser takes for one quote."""
    return re.sub(r"'(?:[^']|'')*'", lambda m: "'" + m[0][1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'", values)


def read_inserts(spark: SparkSession, script: str) -> dict[str, DataFrame]:
    """The rows that a script's INSERT statements give each table, by the table's name. Other statements are left out; an
    INSERT that adds to a table must name the same columns as the one before."""
    tables: dict[str, DataFrame] = {}
    for text in statements(script):
        if m := INSERT.match(text):
            name, columns, values = m[1].lower(), m[2], _literals(m[3])
            rows = spark.sql(f"select * from values {values} as t({columns})")
            tables[name] = tables[name].unionByName(rows) if name in tables else rows
    return tables


def jdbc_options(url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, fetch: int = 10_000) -> dict[str, str]:
    """Options of a JDBC read. With a numeric key and its bounds, the table is read in `parts` ranges of the key at once; rows
    outside the bounds come with the first and last range."""
    found = {"url": url, "dbtable": table, "fetchsize": str(fetch)}
    if key is not None and bounds is not None:
        low, high = bounds
        if high < low:
            raise ValueError("the upper bound is below the lower one")
        found |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(max(1, parts))}
    return found


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None, **partitioning) -> DataFrame:
    """A table of a database; filters and columns are pushed down to it. The driver's jar must be on the session's class path."""
    reader = spark.read.format("jdbc").options(**jdbc_options(url, table, **partitioning))
    return (reader.option("driver", driver) if driver else reader).load()


def write_jdbc(df: DataFrame, url: str, table: str, driver: str | None = None, parts: int = 4, batch: int = 5_000, mode: str = "overwrite") -> None:
    """Rows into a table of a database, over `parts` connections and in batches of inserts, each part in one transaction. Text columns
    without a length become long text there; such columns can't be keys."""
    writer = df.coalesce(parts).write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).option("batchsize", batch).option("numPartitions", parts)
    (writer.option("driver", driver) if driver else writer).save()
