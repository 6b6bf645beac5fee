"""Tables kept in databases that lie as files in a shared folder: one SQLite database for each range of a key, so that tasks on any
machine write and read them at once without a server. Columns are whole numbers, floating-point numbers (NaN, which SQLite
lacks, comes back null) or text."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship
from .postings import filesystem

KINDS = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "real", "double": "real", "string": "text"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def write(df: DataFrame, folder: str, table: str, key: str, parts: int = 4, batch: int = 5_000) -> list[str]:
    """Rows into `parts` databases by ranges of a key, in batches of inserts, each database in one transaction; the databases' files. A task
    that was tried twice leaves a file that isn't among them."""
    ship(df.sparkSession)
    columns = ", ".join(f"{quoted(c)} {KINDS[kind]}" for c, kind in df.dtypes)
    insert = f"insert into {quoted(table)} values ({', '.join('?' * len(df.columns))})"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(folder)
        with tempfile.TemporaryDirectory() as own:
            db = sqlite3.connect(f"{own}/db")
            db.execute(f"create table {quoted(table)} ({columns})")
            for rows in batches:
                for a in range(0, rows.num_rows, batch):
                    db.executemany(insert, zip(*(c.to_pylist() for c in rows.slice(a, batch).columns), strict=True))
            db.execute(f"create index by_key on {quoted(table)} ({quoted(key)})")
            db.commit()
            db.close()
            fs.create_dir(place, recursive=True)
            file = f"{place}/{uuid.uuid4().hex}.db"
            with fs.open_output_stream(file) as out, Path(f"{own}/db").open("rb") as data:
                while piece := data.read(1 << 20):
                    out.write(piece)
        yield pa.RecordBatch.from_pydict({"file": [file]})

    return sorted(r.file for r in df.repartitionByRange(parts, key).mapInArrow(written, "file string").collect())


def read(spark: SparkSession, folder: str, found: list[str], table: str, schema: StructType, where: str = "true", batch: int = 10_000) -> DataFrame:
    """The rows of databases for which a condition in their SQL holds, a task for each database."""
    ship(spark)
    arrow = to_arrow_schema(schema)
    select = f"select {', '.join(quoted(c) for c in schema.names)} from {quoted(table)} where {where}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for file in (f for b in batches for f in b.column(0).to_pylist()):
            with tempfile.TemporaryDirectory() as own:
                with fs.open_input_stream(file) as data, Path(f"{own}/db").open("wb") as out:
                    while piece := data.read(1 << 20):
                        out.write(piece)
                db = sqlite3.connect(f"{own}/db")
                cursor = db.execute(select)
                while some := cursor.fetchmany(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)
                db.close()

    names = spark.createDataFrame([(f,) for f in found], "file string").repartition(max(1, len(found)), "file")
    return names.mapInArrow(rows, schema)
