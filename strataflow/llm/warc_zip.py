"""WARC archives packaged in ZIP files, written by tasks and read back by byte ranges.

Each archive is a ZIP file whose members are stored, not compressed: `NNNNN.warc.gz` holds WARC records, each a gzip member of
its own, and `NNNNN.idx` one line a record with its offset and length. The reader parses the end-of-directory record, its
ZIP64 form and the central directory, finds the two kinds of members, and reads the records' byte ranges where they lie.

Payloads that occur more than once and have MIN_REVISIT bytes or more are stored once, with the largest page_id; the other
records are revisits that refer to it.

Defined cases: a null html is an empty payload; a null url leaves the target out; a null page_id is smaller than any other;
rows that repeat page_id and payload are alike (all responses, if theirs is the largest id); an empty table gives no archive
and an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import storage

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
MEMBER_BYTES = 8 << 20
READ_BYTES = 4 << 20

END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; `digest` is the payload's SHA-1 in hex. A revisit keeps the HTTP head, not the payload."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The parts of one record: type, page_id, refers_to, url, payload (None for a revisit), payload_bytes, digest in hex."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    name = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = head["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"the payload of {head['warc-record-id']} doesn't match its digest")
    return {
        "page_id": name(head["warc-record-id"]), "record_type": head["warc-type"], "refers_to": name(head.get("warc-refers-to")),
        "url": head.get("warc-target-uri"), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": stated,
    }


# --- ZIP directory


def directory(f, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, offset of the local header, stored length) of each member, from the central directory alone."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        where = at - 20
        if where < 0 or tail[where : where + 4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = struct.unpack_from("<Q", tail, where + 8)[0]
        body = f.read_at(56, end64)
        if body[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", body, 32)
    raw, out, i = f.read_at(length, start), [], 0
    for _ in range(count):
        if raw[i : i + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, stored, full = struct.unpack_from("<10xH8xII", raw, i)
        n, extra, note, offset = *struct.unpack_from("<HHH", raw, i + 28), struct.unpack_from("<I", raw, i + 42)[0]
        name = raw[i + 46 : i + 46 + n].decode()
        j, stop = i + 46 + n, i + 46 + n + extra
        while j + 4 <= stop:
            kind, m = struct.unpack_from("<HH", raw, j)
            if kind == 1:  # 64-bit values, in this order, of those fields that are all ones
                values = iter(struct.unpack_from(f"<{m // 8}Q", raw, j + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                stored = next(values) if stored == 0xFFFFFFFF else stored
                offset = next(values) if offset == 0xFFFFFFFF else offset
            j += 4 + m
        out.append((name, method, offset, stored))
        i = stop + note
    return out


def data_start(f, offset: int) -> int:
    """Where a member's bytes begin: after its local header, whose name and extra field have lengths of their own."""
    raw = f.read_at(30, offset)
    if raw[:4] != LOCAL:
        raise ValueError("no local header")
    return offset + 30 + sum(struct.unpack_from("<HH", raw, 26))


# --- writing


def _writer(folder: str, archive_bytes: int, member_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, zipped, name, members, size = [], None, None, "", 0, 0
        body, index, length = [], [], 0

        def close_member() -> None:
            nonlocal body, index, length, members, size
            if body:
                for kind, data in (("warc.gz", b"".join(body)), ("idx", "".join(index).encode())):
                    zipped.writestr(zipfile.ZipInfo(f"{members:05d}.{kind}"), data)
                    size += len(data)
                members += 1
            body, index, length = [], [], 0

        def close_archive() -> None:
            nonlocal out, zipped, members, size
            if zipped is not None:
                close_member()
                zipped.close()
                out.close()
                done.append(name)
            out = zipped = None
            members = size = 0

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if zipped is None:
                    name = storage.fresh(folder, "pages") + ".zip"
                    out = storage.create(name)
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                raw = gzip.compress(record(page_id, url, (html or "").encode(), digest, refers_to), 5, mtime=0)
                index.append(f"{length} {len(raw)}\n")
                body.append(raw)
                length += len(raw)
                if length >= member_bytes:
                    close_member()
                if size >= archive_bytes:
                    close_archive()
        close_archive()
        yield pa.RecordBatch.from_pydict({"archive": pa.array(done, pa.string())})

    return write


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """Write every page as a WARC record; returns the archives' paths. Files of tasks that failed are in no list."""
    spark = pages.sparkSession
    C.ready_python(spark)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"))
    keyed = C.stage(rows.where(F.col("bytes") >= MIN_REVISIT).select("page_id", "digest"), "digests")
    twins = keyed.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    twins = C.stage(twins.select(F.col("digest").alias("__digest"), "first_id"), "twins")
    twins = C.bounded_broadcast(twins, twins.count())
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    named = rows.join(twins, (rows.digest == twins["__digest"]) & (rows.bytes >= MIN_REVISIT), "left")
    named = named.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return C.stage(named.mapInArrow(_writer(folder, archive_bytes, member_bytes), "archive string"), "archives")


# --- reading


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column(0).to_pylist():
            out: list[tuple[str, int, list[int]]] = []
            with storage.open_ranges(name) as f:
                members = {n: (method, at, size) for n, method, at, size in directory(f, f.size())}
                for n in sorted(x for x in members if x.endswith(".idx")):
                    method, at, size = members[n]
                    data_method, data_at, _ = members[n.removesuffix("idx") + "warc.gz"]
                    if method or data_method:
                        raise ValueError(f"{name}: {n} isn't stored")
                    begin = data_start(f, data_at)
                    lengths: list[int] = []
                    for line in f.read_at(size, data_start(f, at)).decode().splitlines():
                        offset, length = map(int, line.split())
                        if lengths and sum(lengths) + length > READ_BYTES:
                            out.append((name, begin + offset - sum(lengths), lengths))
                            lengths = []
                        lengths.append(length)
                        end = begin + offset + length
                    if lengths:
                        out.append((name, end - sum(lengths), lengths))
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.int64()))], ["archive", "begin", "lengths"])


FIELDS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]


def _reader(with_payload: bool):
    fields = FIELDS if with_payload else FIELDS[:-2]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, begin, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with storage.open_ranges(name) as f:
                    raw = f.read_at(sum(lengths), begin)
                rows, at = [], 0
                for length in lengths:
                    rows.append(parse(zlib.decompress(raw[at : at + length], 31)))
                    at += length
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields], [k for k, _ in fields])

    return read


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload."""
    C.ready_python(archives.sparkSession)
    wide = C.shuffle_width(archives.sparkSession)
    splits = archives.repartition(wide, "archive").mapInArrow(_splits, "archive string, begin long, lengths array<long>")
    splits = splits.repartition(wide, "archive", "begin")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return splits.mapInArrow(_reader(with_payload), schema + (", url string, payload binary" if with_payload else ""))
