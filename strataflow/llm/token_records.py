"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames: length (u64), masked checksum of those eight bytes (u32), payload, masked checksum of the
payload (u32); all little-endian. The checksum is CRC-32 as zlib has it, rotated right by 15 bits plus a constant, so that
checksums of checksums stay useful. A payload is the document's id (i64), a flag for a null id (u8), the width of an id in
bytes (u8: 2 where the vocabulary allows it, else 4), and the ids. The index file, beside it, has 24 bytes a record: offset
of the frame, length of the payload, and ids before it in the file (u64 each); records can be read in any order from it.

Documents are written in ascending doc_id order (null first; equal ids by a hash of the text) over all files. Defined cases: a null text is
empty and has the end id alone; repeated rows are records of their own; an empty table gives no file and an empty result; a text
that holds one of the tokenizer's special tokens gets that token's id there, as the library does by default. Only doc_id and
text are read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import storage

END_ID = 0
FILE_BYTES = 64 << 20
READ_BYTES = 4 << 20
#: Bytes that a worker's remembered words take in each of two generations, those of one word besides its characters and ids, and
#: the longest word that is remembered.
CACHE_BYTES, ENTRY_BYTES, CACHED_WORD = 32 << 20, 200, 64
#: Characters of words given to the tokenizer as one text, and bytes of text cut into words at once.
CHARS_OF_WORDS = 64 << 10
BYTES_AT_ONCE = 2 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space in any sense, as a class of RE2.
SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space that isn't alone between two other characters, and the mark that words carry: such texts can't be cut.
NOT_ALONE = rf"^{SPACES}|{SPACES}{SPACES}|{SPACES}$|\x00"
#: Punctuation at the end of a word, after a letter or digit of those that every version of Unicode has as such: it is encoded apart.
LETTERS = r"0-9A-Za-z\x{aa}\x{b2}\x{b3}\x{b5}\x{b9}\x{ba}\x{bc}-\x{be}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
ENDED = rf"([{LETTERS}])([!-/:-@\[-`{{-~]+)( |\n|$)"
#: Characters that mean something in a pattern.
QUOTE = re.compile(f"[{re.escape(PUNCTUATION)}]")
MASK_DELTA = 0xA282EAD8


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(raw: bytes, at: int, length: int) -> memoryview:
    """The payload of the frame at an offset, with both checksums tested."""
    head = raw[at : at + 8]
    if struct.unpack_from("<QI", raw, at) != (length, masked(head)):
        raise ValueError("a record's length is damaged")
    payload = memoryview(raw)[at + 12 : at + 12 + length]
    if struct.unpack_from("<I", raw, at + 12 + length)[0] != masked(payload):
        raise ValueError("a record is damaged")
    return payload


class Encoder:
    """Ids of texts. Where words stand apart by single white space, a byte-level BPE splits the text at its spaces and line breaks
    whatever stands around, so a word with its space is encoded once and remembered; other texts are encoded whole.

    Texts are cut into words, and the ids of words put together again, by column operations; Python sees each distinct word of a
    batch once. A word stands for itself with a space before it, or, after a NUL, without.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # true of byte-level BPE alone, which keeps white space with the word after it and normalises nothing
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_word = kind == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        # texts that hold an added token aren't cut; such a token may reach over any words
        added = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([NOT_ALONE, *(QUOTE.sub(r"\\\g<0>", t) for t in added if t)])
        # words used of late, and those used before
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.line_break = self._ids("\n")
        self.by_word = self.by_word and len(self.line_break) == 1
        #: what stands for a line break, and for nothing before one
        self.apart = {"\0\n": self.line_break.tobytes(), "\0": b""}
        # the ids that begin with a space: among words joined by spaces, each begins one
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, as two texts: those with a space, cut where an id begins with one; those without, a word a line."""
        spaced, bare = [x for x in words if x[0] != "\0"], [x for x in words if x[0] == "\0"]
        flat, lines = self._ids("".join([" " + x for x in spaced])), self._ids("".join([x[1:] + "\n" for x in bare]))
        begins, ends = np.flatnonzero(self.spaced[flat]), np.flatnonzero(lines == self.line_break[0])
        if len(begins) != len(spaced) or len(ends) != len(bare):
            raise ValueError("the tokenizer doesn't keep words apart")
        width = self.dtype.itemsize
        raw, at = flat.tobytes(), [*(begins * width).tolist(), len(flat) * width]
        found = dict(zip(spaced, [raw[a:b] for a, b in pairwise(at)], strict=True))
        raw, at = lines.tobytes(), [0, *((ends + 1) * width).tolist()]
        return found | dict(zip(bare, [raw[a : b - width] for a, b in pairwise(at)], strict=True))

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words: remembered ones, and new ones, which are remembered unless they are long."""
        older = self.older
        found = list(map(self.known.get, words))
        again, new = {}, []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            if word in older:
                found[i] = again[word] = older[word]
            elif word in self.apart:
                found[i] = self.apart[word]
            else:
                new.append(i)
        self._remember(again)
        listed = [words[i] for i in new]
        ends = np.cumsum([len(x) + 1 for x in listed]) // CHARS_OF_WORDS
        cuts = np.flatnonzero(np.diff(ends, prepend=-1)).tolist() if listed else []
        for a, b in pairwise([*cuts, len(listed)]):
            coded = self._encode_words(listed[a:b])
            self._remember(coded)
            for i in new[a:b]:
                found[i] = coded[words[i]]
        return found

    def _remember(self, found: dict[str, bytes]) -> None:
        kept = {x: ids for x, ids in found.items() if len(x) <= CACHED_WORD}
        self.held += ENTRY_BYTES * len(kept) + 2 * sum(map(len, kept)) + sum(map(len, kept.values()))
        self.known.update(kept)
        if self.held > CACHE_BYTES:
            self.known, self.older, self.held = {}, self.known, 0

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        parted = pc.replace_substring_regex(texts, ENDED, "\\1 \0\\2\\3")
        marked = pc.binary_join_element_wise("\0", pc.replace_substring(parted, "\n", " \0\n \0"), "")
        cut = pc.split_pattern(marked, " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self._learn(words)
        flat = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        each = size[codes]
        total = np.cumsum(each)
        # id number i of the batch is number i - (ids before its word) of its word
        ids = flat[np.repeat(begin[codes] - (total - each), each) + np.arange(int(total[-1]) if len(total) else 0)].tobytes()
        ends = np.concatenate(([0], total))[cut.offsets.to_numpy() - cut.offsets[0].as_py()] * self.dtype.itemsize
        return [ids[a:b] for a, b in pairwise(ends.tolist())]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._ids(x).tobytes() for x in texts]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, in order; a null text is empty. Bounded by BYTES_AT_ONCE, or by the longest text."""
        texts, out = pc.fill_null(texts, ""), []
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(ends // BYTES_AT_ONCE, prepend=-1)).tolist()
        for a, b in pairwise([*cuts, len(texts)]):
            some = texts[a:b]
            odd = pc.match_substring_regex(some, self.odd).to_numpy(zero_copy_only=False) | (not self.by_word)
            got = [self._by_words(some.filter(pa.array(~odd))), self._whole(some.filter(pa.array(odd)).to_pylist())]
            turns = [iter(x) for x in got]
            out += [next(turns[int(x)]) for x in odd]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _writer(folder: str, tokenizer: str, end_id: int, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        rows, out, index, name, at, ids = [], None, [], "", 0, 0

        def close() -> None:
            nonlocal out, index, at, ids
            if out is not None:
                out.close()
                with storage.create(name + ".idx") as f:
                    f.write(b"".join(index))
                rows.append((name, part, len(rows), len(index), ids))
            out, index, at, ids = None, [], 0, 0

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                if out is None:
                    name = storage.fresh(folder, f"tokens-{part:05d}")
                    out = storage.create(name + ".bin")
                payload = struct.pack("<qBB", doc_id or 0, doc_id is None, width) + body + end
                index.append(struct.pack("<QQQ", at, len(payload), ids))
                at += out.write(frame(payload))
                ids += len(body) // width + 1
                if at >= file_bytes:
                    close()
        close()
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "part", "seq", "records", "ids"])

    return write


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every document's ids; returns the files in order: file, part, seq, records, ids, ids_before."""
    spark = docs.sparkSession
    C.ready_python(spark)
    # rows that repeat id and text are told apart by a number, so that no range has to hold all of them
    by = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("uid")]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("uid"))
    ordered = ordered.repartitionByRange(C.shuffle_width(spark), *by).sortWithinPartitions(*by)
    files = ordered.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer or default_tokenizer(), end_id, file_bytes), "file string, part int, seq int, records long, ids long")
    files = C.stage(files, "token-files")
    # one row a file: sums by part first, then over the parts
    return C.running_total(files, [], "part", ["seq"], "ids", "ids_before")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with storage.open_ranges(name + ".idx") as f:
                index = np.frombuffer(f.read(), "<u8").reshape(-1, 3)
            group = (index[:, 0] // READ_BYTES).astype(np.int64)
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            lists = [index[a:b].astype(np.int64).ravel() for a, b in zip(cuts, [*cuts[1:], len(index)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(lists), pa.string()), pa.array([before] * len(lists), pa.int64()), pa.array([int(x[0]) for x in lists], pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                ["file", "before", "begin", "entries"],
            )


def payload_ids(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from("<qBB", payload)
    return None if null else doc_id, np.frombuffer(payload[10:], f"<u{width}")


def _reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                index = entries.values.to_numpy().reshape(-1, 3)
                first, stop = int(index[0, 0]), int(index[-1, 0] + index[-1, 1]) + 16
                with storage.open_ranges(name + ".bin") as f:
                    raw = f.read_at(stop - first, first)
                rows = []
                for at, length, start in index.tolist():
                    doc_id, ids = payload_ids(unframe(raw, at - first, length))
                    rows.append((doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4")), ids if with_ids else None))
                cols = list(zip(*rows, strict=True))
                made = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.list_(pa.int64()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(made)])

    return read


def read_records(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """The records of files: doc_id, start, n_tokens, ids_crc32 (and ids). Byte ranges are dealt out, so tasks stay small."""
    C.ready_python(files.sparkSession)
    wide = C.shuffle_width(files.sparkSession)
    spans = files.select("file", "ids_before").repartition(wide, "file").mapInArrow(_spans, "file string, before long, begin long, entries array<long>")
    spans = spans.repartition(wide, "file", "begin")
    return spans.mapInArrow(_reader(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
