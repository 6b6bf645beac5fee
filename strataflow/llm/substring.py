"""Substring dedup by suffix automata of reference shards.

A window is WINDOW consecutive words of one document. A word goes if a window that covers it starts earlier too (in a document
with a smaller id, or earlier in the same one). A suffix automaton holds the words that came before; a document is streamed
through it word by word, and where the matching statistic (the longest run of words ending here that the automaton holds) is
WINDOW or more, that run is a span to remove. Words that end no such run are added to the automaton, so it grows with distinct
text alone. What is streamed together, and in which order, is arranged as follows.

1. Blocks. Tasks write documents to files of about `block_bytes` of text, each distinct text once. In each window the smallest
   hash of its runs of GRAM words is its anchor, so equal windows have equal anchors. Anchors that occur once in all the
   corpus rule their windows out.
2. Within a block, in the order of documents, the stretches of windows that occur twice go through automata of the block. Later
   copies are removed there, so a passage or a document that is repeated without end leaves each block once.
3. Windows that are left are grouped by hash over all blocks. All that are in one group, or in groups next to each other, meet
   in one reference shard, where their words are streamed through the shard's automaton in the order of documents.
4. Of stretches of a shard that are equal word for word (by SHA-256), only the first in the order of documents is streamed: all
   windows of the others start earlier in that one, so they go whole. A passage that stands in every block, or a document of which
   a third of all rows are copies, so comes to its shard once; its copies are found on narrow rows, summed up before the shuffle.

An automaton isn't broadcast to all tasks, since the reference is the corpus itself: stretches are sent to the shard that their
group names. Hashes of windows only decide what meets; two windows with one hash meet in vain, and no collision removes or keeps a word.
Windows are judged on the input.

Defined cases: a null or blank text has no words; a null doc_id comes after all others; equal ids are ordered by a hash of the
text; rows that repeat both id and text count as one document and get the same result; texts of fewer than WINDOW words keep
all; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import storage
from .hashing import BASE, WordHasher, mixed, pieces, run_hashes

WINDOW = 20
GRAM = 8
#: Text of a block.
BLOCK_BYTES = 4 << 20
#: Windows of a block, or of all blocks, that name the same automaton or part of a shard.
LOCAL_WINDOWS, SHARD_WINDOWS = 1 << 15, 1 << 12
#: Words that meet in one reference shard, about.
SHARD_WORDS = 50_000
#: Groups of hashes that a task compares, one after the other: so many at least, and one for so much text of the input. A word
#: begins one window at most, which is 12 bytes in a group and some 100 while the group is compared; so a group takes about
#: 130 MB for words of six bytes, whatever the input, and three times as much if all words were of one letter.
BUCKETS_A_TASK, BUCKET_BYTES = 4, 8 << 20


def sliding(x: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """The smallest (or `best`) of each run of n values."""
    have = 1
    while have * 2 <= n:
        x = best(x[:-have], x[have:]) if len(x) > have else x[:0]
        have *= 2
    more = n - have
    return (best(x[:-more], x[more:]) if len(x) > more else x[:0]) if more else x


class Words:
    """Hashes of the words of texts laid end to end, and of their windows; windows are numbered through."""

    def __init__(self, texts: list[bytes], hasher: WordHasher):
        parts = [hasher(some) for some in pieces(texts)]
        self.words = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in parts)])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        self.bounds = np.cumsum(self.sizes) - self.sizes
        self.windows = np.maximum(self.sizes - WINDOW + 1, 0)
        self.first_window = np.cumsum(self.windows) - self.windows
        # the place of each window's first word
        self.place = np.arange(self.windows.sum()) + np.repeat(self.bounds - self.first_window, self.windows)
        with np.errstate(over="ignore"):
            self.grams = run_hashes(self.words, GRAM)
        self.anchor = sliding(self.grams, WINDOW - GRAM + 1)[self.place]

    def anchors(self) -> np.ndarray:
        """The distinct anchors, ascending; those that lie at several places are listed twice."""
        reach = WINDOW - GRAM + 1
        # the largest anchor among the windows that cover a gram; it is the gram itself if the gram is one of them
        at = np.zeros(len(self.words) + 2 * reach, np.uint64)
        at[self.place + reach - 1] = self.anchor
        largest = sliding(at, reach, np.maximum)[: len(self.grams)]
        value, n = np.unique(self.grams[(largest == self.grams) & (largest != 0)], return_counts=True)
        return np.repeat(value, np.minimum(n, 2))

    def among(self, repeated: np.ndarray) -> np.ndarray:
        """Numbers of the windows whose anchor is among `repeated`, which is ascending."""
        if not len(repeated):
            return np.zeros(0, np.int64)
        return np.flatnonzero(repeated[np.minimum(np.searchsorted(repeated, self.anchor), len(repeated) - 1)] == self.anchor)

    def marks(self, windows: np.ndarray) -> np.ndarray:
        """Hashes of whole windows."""
        with np.errstate(over="ignore"):
            return run_hashes(self.words, WINDOW)[self.place[windows]]


def stretches(shard: np.ndarray, text: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(shard, text, begin, end) of words that windows at these starts cover, those of one shard and text merged where they touch.
    Sorted by shard, text and begin."""
    if not len(start):
        return iter(())
    order = np.lexsort((start, text, shard))
    shard, text, start = shard[order], text[order], start[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (shard[1:] != shard[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + WINDOW)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return zip(shard[first].tolist(), text[first].tolist(), start[first].tolist(), (start[last] + WINDOW).tolist(), strict=True)


# --- suffix automaton


class Automaton:
    """Suffix automaton of stretches of words. Documents are streamed through it in order, and what they have that is new is added."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.last, self.ended = [-1], [0], 0, 0

    def add(self, word) -> None:
        nxt, link, size = self.next, self.link, self.size
        cur, p = len(nxt), self.last
        nxt.append({})
        size.append(size[p] + 1)
        link.append(0)
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = twin
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = twin
                    p = link[p]
        self.last = cur

    def stream(self, words: list, n: int = WINDOW) -> tuple[list[int], list[int]]:
        """Spans [begin, end), as a flat list, of `words` that the automaton holds in runs of n or more, counting words of this
        stretch that came before; and the places where such a run of n begins. Adds the words that end none."""
        nxt, link, size = self.next, self.link, self.size
        spans: list[int] = []
        found: list[int] = []
        state = have = 0
        added = -2  # the place of the last word that was added
        for i, word in enumerate(words):
            to = nxt[state].get(word)
            while to is None and state:
                state = link[state]
                have = size[state]
                to = nxt[state].get(word)
            if to is not None:
                state = to
                have += 1
            if have >= n:
                found.append(i - n + 1)
                begin = i - have + 1
                if spans and begin <= spans[-1]:
                    spans[-1] = i + 1
                else:
                    spans += (begin, i + 1)
                continue
            if added != i - 1:  # a new stretch, with the words that windows ending here begin with
                self.ended += 1
                self.add(self.ended)  # a number; no text has one among its words, which are bytes
                for k in range(max(0, i - n + 1), i):
                    self.add(words[k])
            self.add(word)
            added = i
            # a state that was split meanwhile keeps its longest runs, and the part that it is linked to has the shorter ones
            while state and have <= size[link[state]]:
                state = link[state]
        return spans, found


# --- blocks


def _block_writer(folder: str, block_bytes: int, buckets: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher = WordHasher()

        def flush(held: dict[bytes, list]) -> pa.RecordBatch:
            name = uuid.uuid4().hex
            none_last = lambda x: (x is None, x or 0)
            rows = sorted(((sorted(ids, key=none_last), xxhash.xxh64_intdigest(t), t) for t, ids in held.items()), key=lambda r: (none_last(r[0][0]), r[1]))
            texts = [t for *_, t in rows]
            words = Words(texts, hasher)
            sha = [hashlib.sha256(b" ".join(t.split())).digest() for t in texts]
            table = pa.table(
                {
                    "text": pa.array(texts, pa.binary()), "ids": pa.array([ids for ids, *_ in rows], pa.list_(pa.int64())),
                    "tie": pa.array([h >> 1 for _, h, _ in rows], pa.int64()), "n_words": pa.array(words.sizes), "sha": pa.array(sha, pa.binary(32)),
                }
            )
            with storage.create(f"{folder}/{name}") as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_table(table)
            return _by_bucket(name, words.anchors(), buckets)

        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = held.setdefault(text or b"", [])
                size += 16 if ids else 100 + len(text or b"")
                ids.append(doc_id)
                if size >= block_bytes:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return write


BUCKET_SCHEMA = "bucket int, block string, a binary, b binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "block", "a", "b"])


def _by_bucket(name: str, values: np.ndarray, buckets: int, numbers: np.ndarray | None = None, note: bytes = b"") -> pa.RecordBatch:
    """A row for each bucket of hashes that the block has, ascending, with their numbers; and one with bucket -1, which stands for
    the block. So rows are no more than hashes, however many buckets there are."""
    bucket = (values % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((values, bucket))
    values, bucket = values[order], bucket[order]
    cuts = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
    numbers = numbers[order].astype(np.uint32) if numbers is not None else None
    rows = [(int(bucket[x]), name, values[x:y].tobytes(), numbers[x:y].tobytes() if numbers is not None else b"") for x, y in pairwise(cuts)]
    return _rows([(-1, name, note, b""), *rows])


def _read(folder: str, name: str) -> pa.Table:
    with storage.open_ranges(f"{folder}/{name}") as f:
        return pa.ipc.open_file(f).read_all()


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each bucket, from rows sorted by bucket."""
    now: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now and now[0][0] != row[0]:
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, the anchors of a bucket that occur elsewhere too."""
    for rows in _buckets(batches):
        lists = [np.frombuffer(r[2], np.uint64) for r in rows]
        value, n = np.unique(np.concatenate(lists), return_counts=True)
        value = value[n > 1]
        out = []
        for (bucket, block, *_), own in zip(rows, lists, strict=True):
            own = np.unique(own)
            own = own[value[np.minimum(np.searchsorted(value, own), len(value) - 1)] == own] if len(value) else own[:0]
            if len(own):
                out.append((bucket, block, own.tobytes(), b""))
        yield _rows(out)


def _window_rows(folder: str, buckets: int):
    """Rows (block, list of repeated anchors): removes within the block, and deals out the windows that are left by hash."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for name, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                repeated = np.unique(np.frombuffer(b"".join(lists.as_py()), np.uint64))
                texts = _read(folder, name).column("text").to_pylist()
                words = Words(texts, hasher)
                windows = words.among(repeated)
                marks = words.marks(windows)
                # of windows with one hash, the first in the order of documents names the automaton
                order = np.argsort(marks, kind="stable")
                group = np.cumsum(np.concatenate(([0], marks[order][1:] != marks[order][:-1]))) if len(order) else np.zeros(0, int)
                many = np.bincount(group)[group] > 1 if len(order) else np.zeros(0, bool)
                first = windows[order][np.searchsorted(group, group)]
                again = windows[order][many]
                text = np.searchsorted(words.first_window, again, "right") - 1
                spans, gone = _removed(texts, first[many] // LOCAL_WINDOWS, text, again - words.first_window[text], words.first_window)
                left = ~np.isin(windows, gone)
                yield _by_bucket(name, marks[left], buckets, windows[left], note=flat_bytes(spans))

    return deal


def _removed(texts: list[bytes], shard: np.ndarray, text: np.ndarray, start: np.ndarray, first_window: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Flat rows (text, begin, end) that go within a block, and the numbers of the windows that do."""
    now, auto, spans, gone = None, Automaton(), [], []
    split: tuple[int, list] = (-1, [])
    for group, k, a, b in stretches(shard, text, start):
        if group != now:
            now, auto = group, Automaton()
        if split[0] != k:
            split = k, texts[k].split()
        found, begins = auto.stream(split[1][a:b])
        for x, y in zip(found[::2], found[1::2], strict=True):
            spans += (k, a + x, a + y)
        gone += [int(first_window[k]) + a + x for x in begins]
    return spans, np.array(gone, np.int64)


def flat_bytes(values: list[int]) -> bytes:
    return np.array(values, np.int32).tobytes()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block, its windows of a bucket that other blocks have as well, and the part of the shards where they meet."""
    for rows in _buckets(batches):
        marks = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        numbers = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
        sizes = [len(r[2]) // 8 for r in rows]
        source = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(marks, kind="stable")  # of equal ones, those of the first block by name come first
        fresh = np.ones(len(order), bool)
        fresh[1:] = marks[order][1:] != marks[order][:-1]
        group = np.cumsum(fresh) - 1
        many = np.bincount(group)[group] > 1
        first = order[np.flatnonzero(fresh)[group]]
        names = np.array([int(r[1][:16], 16) for r in rows], np.uint64)
        with np.errstate(over="ignore"):
            meet = (mixed(names[source[first]] + (numbers[first] // SHARD_WINDOWS).astype(np.uint64) * BASE) >> np.uint64(32)).astype(np.uint32)
        at, meet = order[many], meet[many]
        place = np.argsort(source[at], kind="stable")
        at, meet = at[place], meet[place]
        cuts = np.searchsorted(source[at], np.arange(len(rows) + 1))
        yield _rows([(r[0], r[1], numbers[at[x:y]].tobytes(), meet[x:y].tobytes()) for r, (x, y) in zip(rows, pairwise(cuts.tolist()), strict=True) if x < y])


STRETCH = "shard int, none boolean, id long, tie long, block string, text int, begin int"
STRETCH_TYPES = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
PIECE_SCHEMA, DIGEST_SCHEMA = f"{STRETCH}, piece binary", f"{STRETCH}, n int, digest binary"


def _piece_rows(folder: str, shards: int, digests: bool):
    """Rows (block, lists of window numbers, lists of meeting parts, stretches to leave out): the stretches that go to each shard,
    with their words or with their number and a digest of them."""
    names = [f.split()[0] for f in (DIGEST_SCHEMA if digests else PIECE_SCHEMA).split(", ")]
    kinds = (*STRETCH_TYPES, pa.int32(), pa.binary()) if digests else (*STRETCH_TYPES, pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, a, b, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                windows = np.frombuffer(b"".join(a.as_py()), np.uint32).astype(np.int64)
                shard = np.frombuffer(b"".join(b.as_py()), np.uint32).astype(np.int64) % shards
                left_out = {(x["shard"], x["text"], x["begin"]) for x in out.as_py() or ()}
                table = _read(folder, name)
                sizes = np.maximum(table.column("n_words").to_numpy() - WINDOW + 1, 0)
                first = np.cumsum(sizes) - sizes
                text = np.searchsorted(first, windows, "right") - 1
                texts, tie, ids = table.column("text"), table.column("tie").to_pylist(), [x[0] for x in table.column("ids").to_pylist()]
                rows, split = [], (-1, [])
                # one text after the other, so that each is split once
                for k, group, x, y in sorted((k, group, x, y) for group, k, x, y in stretches(shard, text, windows - first[text])):
                    if (group, k, x) in left_out:
                        continue
                    if split[0] != k:
                        split = k, texts[k].as_py().split()
                    piece = b" ".join(split[1][x:y])
                    rows.append((group, ids[k] is None, ids[k] or 0, tie[k], name, k, x, *((y - x, hashlib.sha256(piece).digest()) if digests else (piece,))))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return cut


def _copy_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, stretches): the spans that they cover."""
    for batch in batches:
        for name, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield _rows([(0, name, flat_bytes([v for x in found.as_py() for v in (x["text"], x["begin"], x["begin"] + x["n"])]), b"")])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of stretches, sorted by shard and in the order of documents: the spans that go, as flat (text, begin, end). Stretches
    of one document that several blocks hold, since its row is repeated, are streamed once where they overlap."""
    now, auto, tested = None, Automaton(), []
    for batch in batches:
        out: dict[str, list[int]] = {}
        for shard, none, i, tie, block, text, begin, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now[0] != shard:
                auto = Automaton()
            if now != (shard, none, i, tie):
                now, tested = (shard, none, i, tie), []
            words = piece.split()
            # those before began earlier, so what they tested of this stretch is its begin
            at = max([begin, *(end for end, _ in tested)])
            gone = sorted({x for _, found in tested for x in found if begin <= x <= begin + len(words) - WINDOW})
            spans = [y for x in gone for y in (text, x, x + WINDOW)]
            if at + WINDOW <= begin + len(words):
                fresh, found = auto.stream(words[at - begin :])
                for a, b in zip(fresh[::2], fresh[1::2], strict=True):
                    spans += (text, at + a, at + b)
                tested.append((begin + len(words) - WINDOW + 1, [at + x for x in found]))
            if spans:
                out.setdefault(block, []).extend(spans)
        yield _rows([(0, block, flat_bytes(x), b"") for block, x in out.items()])


def _results(folder: str, columns: dict[str, pa.DataType]):
    """Rows (block, lists of spans): what is left of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, lists in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = _read(folder, name)
                flat = np.frombuffer(b"".join(lists.as_py()), np.int32).reshape(-1, 3)
                flat = flat[np.argsort(flat[:, 0], kind="stable")]
                cuts = np.searchsorted(flat[:, 0], np.arange(len(table) + 1))
                rows: list[dict] = []
                for k, (text, ids, n, sha) in enumerate(zip(*(table.column(c) for c in ("text", "ids", "n_words", "sha")), strict=True)):
                    own = flat[cuts[k] : cuts[k + 1], 1:]
                    text, ids, n, sha = text.as_py, ids.as_py(), n.as_py(), sha.as_py()
                    first = _left(text, n, sha, own, "kept" in columns)
                    rows += [first | {"doc_id": x} for x in ids if x == ids[0]]
                    if ids[-1] != ids[0]:  # a later document of the same words holds nothing new
                        whole = np.array([[0, n]] if n >= WINDOW else np.zeros((0, 2)), np.int32)
                        later = _left(text, n, sha, whole, "kept" in columns)
                        rows += [later | {"doc_id": x} for x in ids if x != ids[0]]
                for at in range(0, len(rows), C.BATCH_ROWS):
                    some = rows[at : at + C.BATCH_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], t) for c, t in columns.items()], list(columns))

    return cut


def _left(text, n: int, sha: bytes, spans: np.ndarray, with_text: bool) -> dict:
    """The result of one text; `text` is a function, since most texts aren't needed again."""
    merged: list[int] = []
    for a, b in sorted(map(tuple, spans.tolist())):
        if merged and a <= merged[-1]:
            merged[-1] = max(merged[-1], b)
        else:
            merged += (a, b)
    gone = sum(merged[1::2]) - sum(merged[::2])
    kept = None
    if gone or with_text:
        words = text().split()
        edges = [0, *merged, len(words)]
        kept = b" ".join(x for a, b in zip(edges[::2], edges[1::2], strict=True) for x in words[a:b])
        sha = hashlib.sha256(kept).digest()
    return {"n_words": n, "n_removed": gone, "spans": merged, "kept": kept, "kept_sha256": sha.hex()}


# --- the whole

OUTPUTS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.int32()), "kept": pa.binary()}
TYPES = {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept_sha256": "string", "spans": "array<int>", "kept": "binary"}


def dedup(docs: DataFrame, outputs: tuple[str, ...] = ("doc_id", "n_words", "n_removed", "kept_sha256"), block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For every document, of these: doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by a space), spans ([begin,
    end) pairs of words removed, as a flat list) and kept (the words left, in UTF-8)."""
    spark = docs.sparkSession
    C.ready_python(spark)
    folder, wide = C.fresh_path(spark, "substring-blocks"), C.shuffle_width(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(max(wide * BUCKETS_A_TASK, -(-size // bucket_bytes)), (1 << 31) - 1)

    def meet(rows: DataFrame) -> DataFrame:
        return rows.where("bucket >= 0").repartition(wide, "bucket").sortWithinPartitions("bucket", "block")

    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_block_writer(folder, block_bytes, buckets), BUCKET_SCHEMA)
    anchors = C.stage(found, "substring-anchors")
    blocks = C.stage(anchors.where("bucket < 0").select("block", "a"), "substring-names")
    # partitions of a number of their own: blocks are much more work than their rows' bytes tell
    own = lambda rows: rows.repartition(wide * 2, "block").groupBy("block")
    again = own(meet(anchors).mapInArrow(_repeated, BUCKET_SCHEMA)).agg(F.collect_list("a").alias("a"))
    windows = C.stage(again.mapInArrow(_window_rows(folder, buckets), BUCKET_SCHEMA), "substring-windows")
    C.discard(anchors)
    shared = C.stage(meet(windows).mapInArrow(_grouped, BUCKET_SCHEMA), "substring-shared")
    n = shared.agg(F.coalesce(F.sum(F.length("a")), F.lit(0))).first()[0] // 4
    by_block = own(shared).agg(F.collect_list(F.struct("a", "b")).alias("x")).select("block", "x.a", "x.b")
    shards, leave = max(1, n // shard_words), "array<struct<shard:int,text:int,begin:int,n:int>>"
    found = by_block.withColumn("c", F.lit(None).cast(leave)).mapInArrow(_piece_rows(folder, shards, True), DIGEST_SCHEMA)
    found = C.stage(found, "substring-stretches")
    place = F.struct("none", "id", "tie", "begin")
    first = found.groupBy("shard", "digest").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    later = found.join(first, ["shard", "digest"]).where(place > F.col("first"))
    copies = C.stage(own(later).agg(F.collect_list(F.struct("shard", "text", "begin", "n")).alias("c")), "substring-copies")
    C.discard(found)
    pieces = by_block.join(copies, "block", "left").mapInArrow(_piece_rows(folder, shards, False), PIECE_SCHEMA)
    pieces = pieces.repartition(wide * 2, "shard").sortWithinPartitions("shard", "none", "id", "tie", "begin")
    spans = C.stage(pieces.mapInArrow(_stream, BUCKET_SCHEMA), "substring-spans")
    spans = spans.union(copies.mapInArrow(_copy_spans, BUCKET_SCHEMA))
    spans = spans.select("block", "a").union(windows.where("bucket < 0").select("block", "a")).union(blocks)
    by_block = own(spans).agg(F.collect_list("a").alias("a"))
    return by_block.mapInArrow(_results(folder, {c: OUTPUTS[c] for c in outputs}), ", ".join(f"{c} {TYPES[c]}" for c in outputs))
