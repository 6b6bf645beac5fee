"""Packing, the prefix trie and spelling variants against brute force, on nulls, empty and long texts, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from strataflow.llm import oracles, packing, prefix_trie, spelling, token_records

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DOCS = "doc_id long, text string, size int, part int, wid long, word string, n long, row long, ids string"


def doc_rows():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 8))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(rng.randint(0, 400)))) for i in range(90)]
    long_word = "xyz" * 40
    rows += [(200, f"{long_word} {long_word} {long_word}\n" + f"{long_word[1:]} " * 7 + f"q{long_word[1:]} " * 3 + ("a" * 65 + " ") * 3 + ("a" * 64 + " ") * 8)]
    rows += [(300, "Grüße GRÜßE grÜße "), (301, "ÀB×÷ÿ, àb×÷ÿ Àb×÷ÿ; ÀB×÷ÿ日本語ab×÷ÿ"), (302, None), (303, ""), (304, " \n"), (305, "word " * 9000)]
    rows += [rows[4], rows[4], (None, "abcabc abcabc abcabc aabcabc"), (None, None)]
    rng.shuffle(rows)
    return [(*r, 1, 2, 3, "w", 4, 5, "i") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS).repartition(5)


def test_classes():
    for capacity, slack in ((2048, 8), (2048, 0), (100, 3)):
        found = packing.classes(capacity, slack)
        assert found[0] == (1, capacity) and found[-1] == (capacity, 1) and all(0 <= capacity - s * k <= slack for s, k in found)
        sizes = [s for s, _ in found]
        for total in (*range(1, 40), capacity - 1, capacity, 3 * capacity + 77):
            got = list(packing.cut(total, sizes))
            assert [a for a, _ in got] == [sum(s for _, s in got[:i]) for i in range(len(got))] and sum(s for _, s in got) == total
    assert packing.tail_cuts(2048 * 2 + 11, 2048) == [(0, 2048), (2048, 4096), (4096, 4104), (4104, 4106), (4106, 4107)] and packing.tail_cuts(0, 2048) == []


@pytest.mark.parametrize(("capacity", "slack"), [(2048, 8), (64, 0), (100, 3)])
def test_packing(spark, docs, capacity, slack):
    got = packing.pack(docs, capacity=capacity, slack=slack)
    rows, whole = got.collect(), {r.sequence_id: r for r in packing.sequences(got).collect()}
    tokenizer = Tokenizer.from_file(token_records.default_tokenizer())
    want = sorted((str(r.doc_id), *tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1) for r in docs.collect())
    made, tiles, bins = defaultdict(list), defaultdict(list), defaultdict(Counter)
    for r in rows:
        ids = np.frombuffer(r.ids, f"<u{len(r.ids) // r.length}").astype("<u4")
        assert len(ids) == r.length and zlib.crc32(ids) == r.ids_crc32
        made[r.part, r.row].append((r.start, str(r.doc_id), r.doc_tokens, ids.tolist()))
        tiles[r.sequence_id].append((r.offset, r.length, ids.tobytes()))
        bins[r.sequence_id][r.length] += 1
    assert sorted((sorted(x)[0][1], *[i for p in sorted(x) for i in p[3]]) for x in made.values()) == want
    for pieces in made.values():
        at = 0
        for start, _, total, ids in sorted(pieces):
            assert start == at and total == sum(len(p[3]) for p in pieces)
            at += len(ids)
    assert sorted(tiles) == list(range(len(tiles))) == sorted(whole)
    shared = 0
    for s, parts in tiles.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (capacity - at <= slack or at & (at - 1) == 0)
        raw = np.frombuffer(whole[s].ids, f"<u{len(whole[s].ids) // at}").astype("<u4").tobytes()
        assert whole[s].n_tokens == at and raw == b"".join(x for _, _, x in sorted(parts))
        one = len(bins[s]) == 1 and sum(bins[s].values()) == capacity // next(iter(bins[s]))
        shared += not one
    # all but the last few sequences have a fixed count of pieces of one class
    assert shared <= len(packing.classes(capacity, slack)) + capacity.bit_length()


def test_packing_of_nothing(docs):
    assert packing.pack(docs.limit(0)).count() == 0
    assert [(r.length, r.offset, r.sequence_id) for r in packing.pack(docs.where("doc_id = 303")).collect()] == [(1, 0, 0)]


def brute_trie(rows, group=20, shared=4):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    own = {c: [(b[1], d[1]) for _, b, d in sorted(v)] for c, v in held.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (c % group if c >= 0 else -(-c % group))
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, below, sums = defaultdict(list), defaultdict(set), {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for path in members:
        if path:
            below[path[:-1]].add(path)
    for path in sorted(members, key=len, reverse=True):
        own_tokens = (len(members[path]) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        sums[path] = (sum(sums[x][0] for x in below[path]) if below[path] else 1, own_tokens + sum(sums[x][1] for x in below[path]))
    out = []
    for path, who in members.items():
        ended = ",".join(map(str, sorted(c for c in who if len(made[c]) == len(path))))
        above = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), above, len(who), len(below[path]), *sums[path], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string, depth int, owner long, pid int, place int, s0 long"


def talk_rows():
    rng = random.Random(5)
    rows = []
    for c in range(-25, 60):
        rows += [(c, rng.choice([t, t, None]), rng.choice(["a", "b", None]), rng.choice(["x y", "z", None, ""])) for t in range(rng.randint(0, 7))]
    rows += [(None, 1, "a", "b"), (3, 1, "a", "x"), (3, 1, "a", "x"), (90, 0, "ab", "c"), (91, 0, "a", "bc")]
    rows += [(c, t, "u", "w w") for c in range(100, 130) for t in range(c - 98)]  # chains on chains
    return rows + [(7, i % 50, "a", "w " * 5) for i in range(150)]


def test_prefix_trie(spark):
    rows = talk_rows()
    turns = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], TURNS).repartition(4)
    assert sorted(map(tuple, prefix_trie.nodes(turns).collect()), key=str) == sorted(brute_trie(rows), key=str)
    # the SQL is another form of the same
    con = duckdb.connect()
    con.register("conversations", turns.select("conv_id", "turn", "role", "text").toArrow())
    found = con.execute(oracles.OP12).fetchall()
    assert sorted(found, key=str) == sorted(brute_trie(rows), key=str)


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.nodes(none).count() == 0
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its one turn gives way to those of a conversation that isn't there
    turnless = spark.createDataFrame([(c, 0, "a", "b", 0, 0, 0, 0, 0)], TURNS)
    assert [tuple(r) for r in prefix_trie.nodes(turnless).collect()] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def brute_words(rows, min_letters=5, min_count=3, noise=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_letters and n >= min_count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, **how):
    words = brute_words(rows, **how)
    out, form = [], {}
    for w in words:
        close = [x for x in words if is_near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = (best if best and words[best] >= 2 * words[w] else None, len(close))
    for w, (f, n_near) in form.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, f, root, words[w], n_near, words[f] if f else None))
    return sorted(out)


@pytest.mark.parametrize(("min_letters", "noise"), [(5, 97), (4, 3)])
def test_spelling(docs, min_letters, noise):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_variants(rows, min_letters=min_letters, noise=noise)
    assert sum(w[1] is not None for w in want) > 3 and any(len(w[0]) > spelling.LONG and w[4] for w in want)
    got = spelling.variants(docs, min_letters=min_letters, noise=noise).collect()
    assert sorted(map(tuple, got)) == want


def test_roots(spark):
    chain = [(i, i - 1) for i in range(1, 40)] + [(100, 50), (101, 50)]
    got = {r.wid: r.root for r in spelling.roots(spark.createDataFrame(chain, "wid long, form long")).collect()}
    assert got == {i: 0 for i in range(1, 40)} | {100: 50, 101: 50}


def test_long_keys():
    words = ["ab" * 40, "ab" * 40 + "b", "a" * 70, "a" * 69, "ab" * 39 + "aa", "ba" * 40]
    for a in words:
        for b in words:
            (wild, less, own), (wild_b, less_b, own_b) = spelling.keys(a), spelling.keys(b)
            if a != b:
                assert is_near(a, b) == (len(set(wild) & set(wild_b)) == 1 or own in less_b or own_b in less)
            assert len(set(less)) == len(less) == len({a[:i] + a[i + 1 :] for i in range(len(a))})


def test_spelling_of_nothing(docs):
    assert spelling.variants(docs.limit(0)).count() == 0 and spelling.variants(docs.where("text is null")).count() == 0
