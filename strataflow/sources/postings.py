"""A Spark data source for boolean indexes kept as text, in segments.

A segment is a text file: a line with the number of documents and of terms, then for each term three lines: the term, how many
ids follow, and the ids with a space after each. A write adds segments of up to `SEGMENT_BYTES` and, once all tasks are done, a
manifest that names them; only files named by a manifest are read, so that a task that was tried twice leaves nothing. Files are
read in byte ranges: a line that ends in a space ends a term's entry, so a range begins after the first of these.

Registered as format "postings": options path, docs (written in the segments' first line) and split (bytes a range). Rows are
(term string, ids array<long>); a term comes once for each segment that has it. Terms hold no white space; null terms and empty lists aren't written.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import ship

SEGMENT_BYTES, SPLIT_BYTES, CHUNK = 32 << 20, 16 << 20, 1 << 20
SCHEMA = "term string, ids array<long>"
ARROW_SCHEMA = pa.schema([("term", pa.string()), ("ids", pa.list_(pa.int64()))])
#: Entries that are written or read at once.
ENTRIES = 4096


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if m := re.match(r"file:/+(.*)", uri):
        return pafs.LocalFileSystem(), "/" + m[1]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class Range(InputPartition):
    file: str
    begin: int
    end: int


def entries(batch: pa.RecordBatch) -> tuple[pa.Array, bytes]:
    """Where each entry of some lists ends, and all of them end to end."""
    batch = batch.filter(pc.and_(pc.is_valid(batch["term"]), pc.fill_null(pc.greater(pc.list_value_length(batch["ids"]), 0), False)))
    lists = pa.concat_arrays([batch["ids"]]).cast(pa.large_list(pa.int64()))
    ids = pa.LargeListArray.from_arrays(lists.offsets, lists.values.cast(pa.large_string()))
    text = lambda x: pa.scalar(x, pa.large_string())
    columns = [batch["term"].cast(pa.large_string()), pc.list_value_length(lists).cast(pa.large_string()), pc.binary_join(ids, text(" "))]
    found = pc.binary_join_element_wise(pc.binary_join_element_wise(*columns, text("\n")), text(" \n"), text(""))
    if found.null_count:
        raise ValueError("a list holds a null id")
    return pc.cumulative_sum(pc.binary_length(found)), b"".join(found.cast(pa.large_binary()).to_pylist())


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, docs: int):
        self.path, self.docs = path, docs

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        files, held, size, terms = [], [], 0, 0

        def shut() -> None:
            nonlocal held, size, terms
            if held:
                name = f"segment-{uuid.uuid4().hex}.txt"
                with fs.open_output_stream(f"{folder}/{name}") as out:
                    out.write(f"{self.docs} {terms}\n".encode())
                    out.write(b"".join(held))
                files.append(name)
            held, size, terms = [], 0, 0

        for batch in batches:
            for a in range(0, batch.num_rows, ENTRIES):
                ends, data = entries(batch.slice(a, ENTRIES))
                at, n = 0, 0
                while n < len(ends):
                    # an entry more than what fits, so that a segment is closed by the entry that fills it
                    more = min(len(ends), int(np.searchsorted(ends, at + SEGMENT_BYTES - size)) + 1)
                    held.append(data[at : ends[more - 1].as_py()])
                    size, terms = size + len(held[-1]), terms + more - n
                    at, n = ends[more - 1].as_py(), more
                    if size >= SEGMENT_BYTES:
                        shut()
        shut()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = filesystem(self.path)
        for m in messages:
            for f in m.files if m else []:
                fs.delete_file(f"{folder}/{f}")


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        fs, folder = filesystem(self.path)
        files = []
        for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith("manifest-"):
                with fs.open_input_stream(info.path) as f:
                    files += json.loads(f.read())
        found = fs.get_file_info([f"{folder}/{f}" for f in sorted(files)])
        return [Range(i.path, a, min(a + self.split, i.size)) for i in found for a in range(0, i.size, self.split)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there is no file
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(part.file) as f:
            # an entry belongs to the range in which the line before it ends; the segment's first line counts as such a line
            mark, limit = b"\n" if part.begin == 0 else b" \n", part.end + 2 - part.begin
            held = f.read_at(limit, part.begin)

            def found(what: bytes, least: int) -> int:
                """Where it is, from a place on, reading on as far as need be; -1 if the file ends before."""
                nonlocal held
                while (at := held.find(what, least)) < 0:
                    more = f.read_at(CHUNK, part.begin + len(held))
                    if not more:
                        return -1
                    held, least = held + more, max(least, len(held) - 1)
                return at

            pos = found(mark, 0) + len(mark)
            if pos < len(mark) or pos >= limit and part.begin > 0:
                return
            stop = found(b" \n", max(pos, limit - 2))
            stop = len(held) - 2 if stop < 0 else stop
        if pos <= stop:
            rows = held[pos:stop].split(b" \n")
            del held
            for a in range(0, len(rows), ENTRIES):
                parts = [pc.list_element(pc.split_pattern(pa.array(rows[a : a + ENTRIES], pa.large_string()), "\n"), i) for i in (0, 2)]
                ids = pc.split_pattern(parts[1], " ")
                lists = pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([parts[0].cast(pa.string()), lists], schema=ARROW_SCHEMA)


class Postings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "postings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("docs", 0)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and its workers."""
    ship(spark)
    spark.dataSource.register(Postings)
