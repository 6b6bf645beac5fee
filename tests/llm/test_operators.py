"""The training-data operators against brute force, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from strataflow.llm import classifier, decontam, graph, hashing, jaccard, mixing, quality_rules, sharding, simhash, storage, substring, token_records, url_filter, warc_zip
from strataflow.llm import common as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, h string, uid string, kept string"


def make_texts(seed: int = 7, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    made: list[str | None] = [text(rng.randint(1, 120)) for _ in range(n)]
    passage = text(45)
    for i in range(5, n, 6):
        made[i] = f"{text(8)} {passage} {text(rng.randint(0, 30))}"
    made += [made[0], made[3], made[3], (made[7] or "") + " extra", None, "", " \n\t ", "one", "one two", "a b " * 60, "same line\n" * 9 + "# $ *", text(6000), "Ünï    cödé 😀 x", "UP down\r\nUP down\x0bq"]
    return made


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 5}" if i % 9 else None, 0, -1, 0, "x", "y", "z") for i, t in enumerate(make_texts())]
    rows += [rows[5], rows[5], (None, "null id " * 30, None, "s1", 0, 0, 0, "", "", ""), (None, None, None, None, None, None, None, None, None, None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall(text or "")


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)] + [(None, 1), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_mixing(docs, none):
    got = mixing.take(docs, block_words=16).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    assert sorted(r["size"] for r in got) == sorted(len(words(r.text)) for r in docs.collect())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        level = (total - sum(held.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        held |= {s: 2.0 * sizes[s] for s in over}
    target = {s: held.get(s, level * weight[s]) for s in order}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    key = lambda rows: sorted((str(r.doc_id), r["size"], r.taken) for r in rows)
    assert key(got) == key(mixing.take(docs.repartition(7), block_words=16).collect())
    assert {(str(r.doc_id), r.h, r.position) for r in got} == {(str(r.doc_id), r.h, r.position) for r in mixing.take(docs.repartition(7), block_words=16).collect()}
    slots, first, whole = brute_mix(got, 16)
    assert {r.uid: r.position for r in got} == first
    mixed = mixing.mix(docs, block_words=16)
    assert mixed.columns == docs.columns and [(r.doc_id, r.source) for r in mixed.collect()] == [(r.doc_id, r.source) for r in whole]
    for s in order:
        off = sum(len(words(r.text)) for r in mixed.collect() if r.source == s) - round(target[s])
        assert 2 * abs(off) <= max(r["size"] for r in got if r.source == s)
    assert mixing.take(none).count() == 0 and mixing.mix(none).count() == 0


def brute_mix(rows, block):
    """The slots in order, each row's first position, and the rows of whole documents in order, by plain loops."""
    names = sorted({r.source for r in rows if r.source is not None}, key=lambda s: s.encode()) + [None]
    goal = {r.source: round(r.target) for r in rows}
    need = {s: -(-goal[s] // block) for s in names}
    total, edge, n = sum(need.values()), {}, 0
    bits = (total - 1).bit_length()
    for s in names:
        edge[s] = (-(-n * 2**bits // total), -(-(n + need[s]) * 2**bits // total))
        n += need[s]
    slots, used = [], Counter()
    for position in range(2**bits):
        point = int(f"{position:0{bits}b}"[::-1], 2)
        for s in names:
            if edge[s][0] <= point < edge[s][1] and used[s] < need[s]:
                slots.append((position, s, used[s]))
                used[s] += 1
    place = {(s, k): p for p, s, k in slots}
    first, whole = {r.uid: None for r in rows}, []
    for s in names:
        own = sorted((r for r in rows if r.source == s), key=lambda r: (r.h, r.doc_id is not None, r.doc_id or 0, r.uid))
        own.sort(key=lambda r: r.h % 2**64)
        size, at = sum(r["size"] for r in own), 0
        for lap in range(3):
            for r in own:
                if at < goal[s] and r["size"]:
                    seen = [place[s, x // block] for x in range(at, min(at + r["size"], goal[s]))]
                    first[r.uid] = min([*seen, *([first[r.uid]] if first[r.uid] is not None else [])])
                if r["size"] and 2 * at + r["size"] <= 2 * goal[s]:
                    whole.append((place[s, at // block], at, r))
                at += r["size"]
        assert size * 3 == at
    return slots, first, [r for *_, r in sorted(whole, key=lambda x: x[:2])]


def test_mixed_copies(spark):
    """Equal rows are taken as often as the target says, not each rounded by itself."""
    text = " ".join(f"w{k}" for k in range(500))
    rows = [(1, text, "a")] * 20 + [(i, " ".join(f"x{i}y{k}" for k in range(300)), "b") for i in range(2, 40)]
    mine = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target = {r.source: r.target for r in mixing.take(mine).collect()}
    got = Counter(r.source for r in mixing.mix(mine).collect())
    assert abs(got["a"] * 500 - target["a"]) <= 250 and abs(got["b"] * 300 - target["b"]) <= 150


def test_schedule_is_even(docs):
    per, _ = mixing.source_targets(mixing.measure(docs))
    slots = mixing.schedule(per, 8)[0].orderBy("position").collect()
    need = Counter(s.sid for s in slots)
    seen = Counter()
    for i, s in enumerate(slots, 1):
        assert s.rank == seen[s.sid]
        seen[s.sid] += 1
        assert all(abs(seen[x] - i * need[x] / len(slots)) < 8 for x in need)


def test_url_filter(spark):
    rows = [
        (1, "http://A.com/x", '<link rel="canonical" href="/en/1">'), (2, "http://q.org/a#z", '<META http-equiv="refresh" content="0; url=http://a.com/x#k">'),
        (3, "http://q.org/a", None), (4, None, "x"), (5, "abc", None), (6, "http://q.net/de/8", ""), (7, "http://www.example.net/de/81?x=/en/", ""),
        (8, "https://com/en/", ""), (9, "http://example.com/en/7", ""), (10, "http://u.io/p/q", '<link href="../w" rel=canonical>'),
        (11, "http://v.io", '<link rel="canonical" href="http://x.com/en/5">'), (12, "http://v2.io", '<link rel=canonical href="http://v.io">'),
        (13, "http://w.io", '<link rel=canonical href="http://x.com/en/5"><link rel=canonical href="http://example.com/en/72">'), (3, "http://q.org/a", None), (None, None, None),
        (16, "http://long.io/" + "p" * 20_000, "x < y " * 60_000 + '<link rel=canonical href="http://x.com/en/9">'),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[1] == ("a.com", "/x", None, "block") and got[2][3] == got[3][3] == "block" and got[4] == ("", "", None, "allow") == got[5]
    assert got[6][2:] == ("net/de/", "allow") and got[7] == ("www.example.net", "/de/81", "example.net/de/8", "block")
    assert got[8][2:] == ("com/en/", "block") and got[9][2:] == ("example.com/en/7", "allow") and got[10][3] == "allow"
    assert got[16][1:] == ("/" + "p" * 20_000, None, "block")
    assert got[11][3] == got[12][3] == got[13][3] == "allow"  # an alias is explicitly allowed
    assert url_filter.judge(pages).count() == len(rows) and url_filter.judge(pages.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big, other = "b" * 1500, "ü" * 700
    rows = [(1, "http://a", big), (2, "http://b\n", big), (9, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (3, "u", other), (None, None, None), (9, None, big), (10, "http://long", "q" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    archives = warc_zip.write_archives(pages, str(tmp_path / "w"), archive_bytes=600, member_bytes=200)
    got = warc_zip.read_archives(archives).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = last[h or ""] if len(raw) >= 1000 and last[h or ""] != i else None
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "response" if first is None else "revisit", first))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=str) or sorted(map(str, want)) == sorted(
        str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got
    )
    assert warc_zip.read_archives(warc_zip.write_archives(pages.limit(0), str(tmp_path / "e"))).count() == 0
    with zipfile.ZipFile(archives.first().archive) as z:  # another reader agrees
        assert z.testzip() is None and gzip.decompress(z.read("00000.warc.gz")).startswith(b"WARC/1.1")


def test_zip64(tmp_path):
    """A directory whose sizes and offsets are all in 64-bit fields."""
    name, data = b"00000.idx", b"0 10\n"
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    entry = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    tail = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(entry), 1) + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + entry + end64 + tail
    assert zipfile.ZipFile(io.BytesIO(raw)).read("00000.idx") == data
    (tmp_path / "z.zip").write_bytes(raw)
    with storage.open_ranges(str(tmp_path / "z.zip")) as f:
        [(n, method, at, size)] = warc_zip.directory(f, f.size())
        assert (n, method, at, size) == ("00000.idx", 0, 0, len(data)) and f.read_at(size, warc_zip.data_start(f, at)) == data


def test_quality_rules(docs, none):
    got = quality_rules.rated(docs).collect()
    want = []
    for r in docs.collect():
        t = r.text or ""
        w = words(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 2 * len(cover) > len(w)
        want.append((str(r.doc_id), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert all(r.kept <= (not r.base_failed) for r in got)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.rated(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def brute_verdicts(rows):
    """{source: verdict} from (source, flags of the rules), by plain sums."""
    hosts, verdict = defaultdict(list), {}
    for source, flags in rows:
        hosts[source].append(flags)
    for k in range(len(quality_rules.RULES)):
        d = {s: len(x) for s, x in hosts.items()}
        f = {s: sum(y[k] for y in x) for s, x in hosts.items()}
        t, n = sum(d.values()), len(hosts)
        m = (sum(f.values()) + 0.5) / (t + 1)
        excess = sum(d[s] * (f[s] / d[s] - m) ** 2 for s in d) / (m * (1 - m)) - (n - 1)
        room = t - sum(x * x for x in d.values()) / t - (n - 1)
        strength = 1 / min(max(excess / room if room > 0 else 0, 1 / (t + 1)), 0.5) - 1 if n > 1 else 1
        sd = (m * (1 - m) / (strength + 1)) ** 0.5
        for s in d:
            rate = (f[s] + m * strength) / (d[s] + strength)
            worst = 2 if rate > 0.8 or (rate - m > 3 * sd and rate > 0.5) else int(rate - m > 1.5 * sd)
            verdict[s] = max(verdict.get(s, 0), worst)
    return {s: ("good", "suspect", "rejected")[v] for s, v in verdict.items()}


def test_hosts(spark):
    """Twelve hosts that are alike, one that fails the base rules, one full of symbols, one with more symbols than the others, a new one."""
    rng = random.Random(4)
    plain = lambda k, n=60: " ".join(f"w{k}x{rng.randrange(10**6)}" for _ in range(n))
    odd = lambda k: plain(k) + " " + "### $$$ %%% *** " * 20
    rows = [(f"h{h}", odd(i) if i % 20 == 0 else "few" if i % 10 == 1 else plain(i)) for h in range(12) for i in range(40)]
    rows += [("bad", plain(i) if i % 10 == 0 else "bad") for i in range(40)] + [("symbols", odd(i) if i % 10 else plain(i)) for i in range(40)]
    rows += [("more", odd(i) if i % 5 < 3 else plain(i)) for i in range(40)] + [("new", plain(1)), (None, plain(2)), (None, None)]
    mine = spark.createDataFrame([(i, t, s, "clash") for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string, kept string")
    got = {r.doc_id: r for r in quality_rules.rated(mine).collect()}
    symbols = [r.n_symbols * 100 > r.word_chars * 5 for _, r in sorted(got.items())]
    length = [r.word_chars > r.n_words * 9 or r.word_chars < r.n_words * 3 for _, r in sorted(got.items())]
    flags = [(r.n_words < 50, 2 * r.n_repeat_words > r.n_words, symbols[i], False, length[i]) for i, r in sorted(got.items())]
    want = brute_verdicts([(s, flags[i]) for i, (s, _) in enumerate(rows)])
    assert want["bad"] == want["symbols"] == "rejected" and want["more"] == "suspect" and {want[f"h{h}"] for h in range(12)} == {want["new"]} == {"good"}
    for i, (s, _) in enumerate(rows):
        assert got[i].host == want[s]
        assert got[i].kept == (not any(flags[i][:2]) and want[s] != "rejected" and not (want[s] == "suspect" and any(flags[i])))
    kept = quality_rules.keep_good(mine)
    assert kept.columns == mine.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, r in sorted(got.items()) if r.kept]
    assert any(r.kept is False and not r.base_failed for r in got.values())


def brute_substring(rows):
    """{(doc_id, text): words and what is removed} by a set of the windows that came before."""
    order = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in rows if r.text is not None}, key=lambda x: x[:2])
    seen, want = set(), {}
    for missing, i, text in order:
        w = text.encode().split()
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(g)
        want[None if missing else i, text] = (len(w), len(w) - sum(keep), b" ".join(x for x, k in zip(w, keep, strict=True) if k))
    return want


@pytest.mark.parametrize(("block", "bucket"), [(1 << 23, 1 << 23), (3000, 1 << 23), (3000, 100)])
def test_substring(docs, none, block, bucket):
    rows = docs.collect()
    want = brute_substring(rows)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = substring.dedup(docs, outputs=(*substring.OUTPUTS,), block_bytes=block, shard_words=500, bucket_bytes=bucket).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(
        (str(r.doc_id), *(lambda n, m, kept: (n, m, sha(kept)))(*want.get((r.doc_id, r.text), (0, 0, b"")))) for r in rows
    )
    assert any(r.n_removed for r in got) and all(sha(r.kept) == r.kept_sha256 and sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_removed for r in got)
    assert substring.dedup(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substring_of_likely_repeats(spark, seed):
    """Texts of few words, periodic ones, passages cut from one another, and edges of every length."""
    rng = random.Random(seed)
    base = [rng.choice("abcdefghijklm") * rng.randrange(1, 3) for _ in range(400)]
    texts = []
    for _ in range(70):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(380)
            parts += base[a : a + rng.choice([5, 19, 20, 21, 22, 33, 60])] if rng.random() < 0.6 else [rng.choice("xyz") for _ in range(rng.randrange(30))]
        texts.append(" ".join(parts))
    texts += ["p q " * 40, "q p " * 33, "r " * 70, "r " * 19, "r " * 20, " ".join(base[:100] * 2)]
    mine = spark.createDataFrame([(rng.randrange(10**6), t) for t in texts], "doc_id long, text string").repartition(5)
    want = brute_substring(mine.collect())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(mine, outputs=("doc_id", "n_words", "n_removed", "kept"), block_bytes=1500, shard_words=300).collect()}
    assert got == {k[0]: (n, m, bytearray(kept)) for k, (n, m, kept) in want.items()}


def test_substring_of_copies_in_every_block(spark):
    """A document and a passage that stand in every block, rows that repeat id and text in several, null ids, periodic copies."""
    rng = random.Random(4)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "mn"])
    whole, passage = (" ".join(f"{x}{i}" for i in range(90)) for x in "qz")
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = [(100 + i, whole) for i in range(40)] + [(300 + i, f"{t} {passage} {t}") for i, t in enumerate(texts)]
    rows += [(7, f"{passage} x {passage}")] * 30 + [(None, whole), (None, passage), (50, f"{whole} {whole}"), (5, "p q r " * 30), (9, "p q r " * 30)]
    rng.shuffle(rows)
    mine = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_substring(mine.collect())
    got = substring.dedup(mine, outputs=("doc_id", "n_words", "n_removed", "kept"), block_bytes=2500, shard_words=300).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept)) for r in got) == sorted((str(i), *want[i, t]) for i, t in rows)


@pytest.mark.parametrize("buckets", [1, 7, 1 << 30])
def test_buckets_of_a_block(buckets):
    """Each hash in its bucket with its number, no empty bucket, the block's row first; so rows are no more than hashes."""
    values = np.random.default_rng(3).integers(0, 1 << 63, 500, dtype=np.uint64)
    rows = substring._by_bucket("b", values, buckets, np.arange(500)).to_pylist()
    assert rows[0]["bucket"] == -1 and 1 <= len(rows) - 1 <= min(buckets, 500) and [r["bucket"] for r in rows] == sorted({r["bucket"] for r in rows})
    for r in rows[1:]:
        a, b = np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint32)
        assert len(a) and (values[b] == a).all() and (a % np.uint64(buckets) == r["bucket"]).all()
    assert sum(len(r["b"]) // 4 for r in rows[1:]) == 500
    assert len(substring._by_bucket("b", values[:0], buckets)) == 1


@pytest.mark.parametrize("seed", range(20))
def test_automaton(seed):
    """Spans of several stretches against the runs that came before, in all of them."""
    rng = random.Random(seed)
    auto, seen = substring.Automaton(), set()
    for _ in range(6):
        run = [rng.choice("ab") for _ in range(rng.randrange(60))]
        spans, found = auto.stream(run, 5)
        want = []
        for i in range(len(run) - 4):
            g = tuple(run[i : i + 5])
            want += [i] if g in seen else []
            seen.add(g)
        covered = {k for i in want for k in range(i, i + 5)}
        assert found == want and {k for a, b in zip(spans[::2], spans[1::2], strict=True) for k in range(a, b)} == covered
        assert spans == sorted(set(spans))


def test_word_hashes():
    hasher = hashing.WordHasher()
    texts = ["a b\tc  \x0bab", "", " ", "ab a\u00a0b \x00 \x00\x00", "b a c"]
    value, sizes = hasher([t.encode() for t in texts])
    split = [w for t in texts for w in t.encode().split()]
    assert sizes.tolist() == [len(t.encode().split()) for t in texts] and len(value) == len(split)
    assert {w: {int(h) for x, h in zip(split, value, strict=True) if x == w} for w in split} == {w: {int(h)} for w, h in zip(split, value, strict=True)}
    assert len(set(value.tolist())) == len(set(split))


def test_decontamination(spark, docs, none):
    bench = [(1, "A farmer named Tom has 12 cows and 5 kg of feed so Tom asks how many days the feed lasts for 12 cows"), (2, "short one"), (3, None), (None, "x " * 9), (4, "plain words that follow one another in a question without any number at all")]
    items = spark.createDataFrame([(*b, "clash") for b in bench], "item_id long, text string, doc_id string")
    ask = lambda n, m, p, q: f"xx yy A farmer named {n} has {m} cows and 7 lb of feed so {p} asks how many days the feed lasts for {q} cows zz"
    rows = [(1, ask("Bob", 99, "Bob", 99)), (2, ask("Bob", 99, "Jim", 98)), (3, None), (4, ""), (5, "So: " + bench[4][1].upper().lower() + "!"), (5, "other"), (6, "plain words that follow nothing"), (None, bench[4][1])]
    mine = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, th int")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(mine, items).collect()}
    assert found == {(1, 1), (5, 4), (None, 4)}
    left = decontam.clean(mine, items)
    assert left.columns == mine.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "4", "5", "6"]
    assert decontam.leaks(docs, items).count() == 0 and decontam.clean(none, items).count() == 0 and decontam.leaks(mine, items.limit(0)).count() == 0


def test_decontamination_of_placeholders(spark):
    bench = ["What is 12 + 35 * 4 - 7 / 2?", "Add 15 kg, 20 kg and 30 kg, then convert 65 kg to pounds.", "Which city is larger, Paris, London, Berlin, Madrid, Rome or Vienna?", "12 + 35 * 4 - 7 / 2 - 11 + 9"]
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    texts = [*(f"so we ask. {x} yes" for x in bench), "ok. What is 3 + 5 * 9 - 1 / 8? Fine", "ok. Add 3 lb, 4 lb and 5 lb, then convert 6 lb to pounds.", "Which city is larger, Oslo, Rome, Bonn, Lyon, Kiel or Graz?"]
    texts += ["it is 3 5 9 1 8 or so", "9 + 8 * 7 - 6 / 5 - 4 + 3", "Add 3 lb, 4 kg and 5 g, then convert 6 t to pounds.", "Which house is older, Oslo, Rome, Bonn, Lyon, Kiel or Graz?", "1 2 3 4 5 6 7 8 9"]
    mine = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(mine, items).collect()}
    assert found == dict.fromkeys([(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (5, 1), (6, 2)], 1.0)


def test_decontamination_of_short_items(spark):
    bench = ["Capital of France?", "Name two big rivers there", "Compute 12 + 35 * 4 - 7 / 2", "Rivers flow past some towns", "Who?", "...", "Tom met Ann and Bob and Eve today"]
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    texts = ["First, Capital of France? It is known", "the capital of France.", "Capital of Spain", "so, Name two big rivers there!", "so, Sum two big rivers there!", "name two big rivers there", "so, Compute 12 + 35 * 4 - 7 / 2"]
    texts += ["so, Compute 3 + 5 * 4 - 7 / 2", "ok. Compute 3 + 5 * 4 - 7 / 2", "hey Rivers flow past some towns", "hey Who", "", None, "Capital", "then Tom met Jim and Lee and Sue today", "then Max met Jim and Lee and Sue"]
    mine = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontam.leaks(mine, items).collect())
    assert found == [(0, 0), (1, 0), (3, 1), (5, 1), (6, 2), (7, 2), (8, 2), (9, 3), (10, 4), (14, 6)]


def test_decontamination_of_other_parameters(spark):
    """Items of the benchmark with numbers, names and units put into them, copied with other values, and with values that don't agree."""
    rng = random.Random(9)
    names = [("Anna", "Peter"), ("Marie", "Lukas"), ("Clara", "Bruno")]
    items, texts, want = [], [], {}
    filler = lambda k: " ".join(f"z{rng.randrange(9)}q{rng.randrange(10**6)}" for _ in range(k))
    for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect():
        w = r.text.split()
        if len(w) < 8:
            continue
        one, other = rng.choice(names)
        n, m = rng.randrange(10, 50), rng.randrange(50, 99)
        at = sorted(rng.sample(range(1, len(w) - 1), 2))
        # a number with a unit, a name after a word, and the number once more at the end
        make = lambda number, name, last: " ".join([*w[: at[0]], number, "kg", *w[at[0] : at[1]], "und", name, *w[at[1] :], "x", last])  # noqa: E731,B023
        items.append((r.item_id, make(str(n), one, str(n))))
        for text, caught in ((make(str(m), other, str(m)), True), (make(str(n), one, str(n)), True), (filler(40), False)):
            want[len(texts)] = r.item_id if caught else None
            texts.append(f"{filler(12)} {text} {filler(9)}")
    mine = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(mine, spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {(d, i) for d, i in want.items() if i is not None}
    assert len(found & expected) >= 0.9 * len(expected) and {d for d, _ in found} <= {d for d, _ in expected}


def test_decontamination_against_plain_search(spark):
    """Items of words alone: the parts of an item that lie in runs of five words of a document, found by plain loops."""
    rng = random.Random(3)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 16)))) for i in range(30)]
    texts = []
    for _ in range(120):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "other"
        cut = rng.randrange(len(w)) if rng.random() < 0.3 else 0
        texts.append(" ".join([*(rng.choice(vocab) for _ in range(rng.randrange(20))), *w[cut:], "end", *w[:cut]]))
    want = {}
    for d, text in enumerate(texts):
        w = text.split()
        runs = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, item in items:
            q = item.split()
            held = {k + j for k in range(len(q) - 4) if tuple(q[k : k + 5]) in runs for j in range(5)}
            if len(held) >= 0.8 * len(q):
                want[d, i] = len(held)
    mine, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert want and {(r.doc_id, r.item_id): r.covered_words for r in decontam.leaks(mine, bench).collect()} == want


def plain_discriminant(rows, label):
    """Scores by the definition: densities of two normal distributions, with determinants and inverses."""
    x = np.array([r.x for r in rows])
    y = np.array([label.get(r.doc_id, -1) if not r.held_out else -1 for r in rows])
    known = x[y >= 0]
    z = np.clip((x - known.mean(axis=0)) / known.std(axis=0), -6, 6)
    cov = {c: np.cov(z[y == c].T, bias=True) for c in (0, 1)}
    both = sum(cov[c] * (y == c).sum() for c in cov) / (y >= 0).sum()
    log = {}
    for c in cov:
        s = 0.8 * cov[c] + 0.2 * both
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 0.02 * np.eye(len(s))
        d = z - z[y == c].mean(axis=0)
        log[c] = np.log((y == c).sum() / (y >= 0).sum()) - 0.5 * np.log(np.linalg.det(s)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)
    return {r.doc_id: p for r, p in zip(rows, 1 / (1 + np.exp((log[0] - log[1]) / 2)), strict=True)}


def test_classifier(spark, docs, none):
    data = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = {r.doc_id: r for r in classifier.classify(d, labels).collect()}
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    test = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in test) / len(test) > 0.95
    twisted = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality")
    assert {r.doc_id: r.score for r in classifier.classify(d, twisted).collect()} == pytest.approx({i: r.score for i, r in got.items()})
    plain = plain_discriminant(classifier.statistics(d).collect(), {r.doc_id: r.quality for r in labels.collect()})
    assert {i: r.score for i, r in got.items()} == pytest.approx(plain, abs=1e-6)
    bad = spark.createDataFrame([(1, None, "q"), (1, 1, "q"), (None, 1, "q")], "doc_id long, quality int, text string")
    assert classifier.classify(docs, bad).count() == docs.count() and classifier.classify(none, bad).count() == 0


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    import xxhash

    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("limit", [20_000, 7])
def test_simhash(docs, none, limit):
    rows = docs.collect()
    codes = [brute_simhash(r.text) for r in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        c = find(i)
        if r.doc_id is not None and (least[c] is None or r.doc_id < least[c]):
            least[c] = r.doc_id
    got = simhash.classes(docs, limit).select("doc_id", simhash.hex_code().alias("f"), "component_id").collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={r.doc_id}, f='{codes[i]:016x}', component_id={least[find(i)]})" for i, r in enumerate(rows))
    first = simhash.keep_first(docs)
    assert first.columns == docs.columns and first.count() == len({find(i) for i in range(len(rows))})
    assert simhash.classes(none).count() == 0 and simhash.keep_first(none).count() == 0


@pytest.mark.parametrize("limit", [2_000_000, 300])
def test_jaccard(spark, docs, none, limit):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(k)) for k in (300, 150, 60, 25, 5, 4)]
    texts = [*base, *base[:2], base[0].upper(), None, " "]
    for text in base:
        for edits in (1, 2, 3, 4, 6, 8):
            w = text.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(w))
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, base[1], 1)]
    mine = spark.createDataFrame(rows, "doc_id long, text string, code int")

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, codes, root = [grams(r[1]) for r in rows], [brute_simhash(r[1]) for r in rows], list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    far = 0
    for i in range(len(rows)):
        for j in range(i):
            like, bits = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0, (codes[i] ^ codes[j]).bit_count()
            far += like and bits > 3
            if like or bits <= 3:
                root[find(i)] = find(j)
    want = defaultdict(set)
    for i, r in enumerate(rows):
        want[find(i)].add(r[0])
    got = defaultdict(set)
    for r in simhash.classes(mine, near=lambda d, p: jaccard.links(d, p, group_limit=limit)).collect():
        got[r.root].add(r.doc_id)
    assert far and sorted(map(str, got.values())) == sorted(map(str, want.values()))
    left = corpus_pipeline.near_duplicates(spark, mine, "")
    assert left.columns == mine.columns and left.count() == len(want)
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0


def test_alike():
    """The classes that the found pairs make, against all pairs."""
    rng = random.Random(1)
    for _ in range(100):
        base, sets = [rng.randrange(1000) for _ in range(30)], []
        for _ in range(rng.randrange(2, 25)):
            s = set(base if rng.random() < 0.6 else [rng.randrange(1000) for _ in range(rng.randrange(1, 40))])
            sets.append({x for x in s if rng.random() < 0.96} | {rng.randrange(1000) for _ in range(rng.randrange(1, 4))})
        sets.sort(key=len)

        def classes(pairs):
            root = list(range(len(sets)))  # noqa: B023
            for i, j in pairs:
                root = [root[i] if x == root[j] else x for x in root]
            return [root.index(x) for x in root]

        want = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
        assert classes(jaccard.alike([np.array(sorted(s), np.uint64) for s in sets], 0.8)) == classes(want)


def test_shingles():
    texts = [b"A b c D e f", b"a B c d e f", None, b" ", b"one", b"one two", b"a b c d e a b c d e", b"z " * 700_000, b"one"]
    got = hashing.Shingles(5)(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or b"").lower().split() for t in texts)]
    assert [len(x) for x in got] == [len(x) for x in sets]
    for x, a in zip(got, sets, strict=True):
        assert [set(x.tolist()) & set(y.tolist()) != set() for y in got] == [bool(a & b) for b in sets] and (np.diff(x.astype(object)) > 0).all()


@pytest.mark.parametrize("distinct", [1000, 1 << 22, 1 << 32])
def test_block_masks(distinct):
    """Whatever the number of fingerprints, two within the budget agree in one mask at least, and no mask is short."""
    rng = random.Random(6)
    masks = simhash.block_masks(distinct)
    assert min(m.bit_count() for m in masks) >= {1000: 16, 1 << 22: 25, 1 << 32: 31}[distinct]
    for _ in range(3000):
        flipped = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & flipped == 0 for m in masks)


def test_trie():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)]))
    found = {(int(i), int(j)) for a, b in simhash.trie_links(codes, np.array([0]), np.array([len(codes)])) for i, j in zip(a, b, strict=True)}
    assert found == {(i, j) for j in range(len(codes)) for i in range(j) if int(codes[i] ^ codes[j]).bit_count() <= 3}


def test_sharding(docs, none):
    rows = sharding.assign(docs).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.place)
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and sharding.assign(none).count() == 0
    held, load, slot_bytes = defaultdict(set), Counter(), Counter()
    for r in rows:
        held[r.vslot].add((r.shard, r.grown_shard, r.balanced_shard))
        load[r.balanced_shard] += r["size"]
        slot_bytes[r.vslot] += r["size"]
    edited = sharding.rebalance(sharding.slot_map(24), [slot_bytes[s] for s in range(sharding.SLOTS)])
    assert all(x == {(sharding.slot_map(24)[s], sharding.slot_map(25)[s], edited[s])} for s, x in held.items())
    assert max(load.values()) <= max(1.02 * sum(load.values()) / 24, sum(load.values()) / 24 + max(slot_bytes.values()))
    assert sharding.rebalance(sharding.slot_map(24), [0] * sharding.SLOTS) == sharding.slot_map(24)
    for n in (1, 2, 24, 25):
        size = Counter(sharding.slot_map(n))
        assert len(size) == n and max(size.values()) - min(size.values()) <= 2
    rng = random.Random(1)
    weights = [rng.randrange(1, 99) for _ in range(sharding.SLOTS)]
    weights[:200] = [999] * 200
    load = Counter()
    for slot, shard in enumerate(sharding.rebalance(sharding.slot_map(24), weights)):
        load[shard] += weights[slot]
    assert max(load.values()) <= max(1.02 * sum(weights) / 24, sum(weights) / 24 + 999)  # whole slots move


def plain_map(shards):
    """Shard of each slot, grown one shard at a time by plain loops."""
    where = [0] * sharding.SLOTS
    for new in range(1, shards):
        for _ in range(sharding.SLOTS // (new + 1)):
            counts = [where.count(s) for s in range(new)]
            giver = counts.index(max(counts))
            where[max(i for i, s in enumerate(where) if s == giver)] = new
    return where


def test_sharding_by_plain_loops(docs, monkeypatch):
    """Slots, shards before and after growth, and places, from the documents alone."""
    monkeypatch.setattr(sharding, "SLOTS", 128)
    rows = sharding.assign(docs, 5, 128).collect()
    now, grown = plain_map(5), plain_map(6)
    want = []
    for r in docs.collect():
        h = 42 if r.doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        slot = (h - (1 << 64) if h >= 1 << 63 else h) % 128
        raw = (r.text or "").encode()
        want.append((str(r.doc_id), len(raw) + 8, zlib.crc32(raw), slot, now[slot], grown[slot]))
    assert sorted((str(r.doc_id), r["size"], r.text_crc32, r.vslot, r.shard, r.grown_shard) for r in rows) == sorted(want)
    for shard in range(5):
        assert sorted(r.place for r in rows if r.shard == shard) == list(range(sum(w[4] == shard for w in want)))


def test_short_items(spark):
    """An item of a few words is reported, and takes documents away only where that is asked for."""
    texts = spark.createDataFrame([(1, "Who knows what the owl sees at night"), (2, "who is it"), (3, "the quick brown fox jumps over the lazy dog"), (4, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "Who?"), ("b", "The quick brown fox jumps over the lazy dog.")], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(texts, items).collect()} == {(1, "a"), (2, "a"), (3, "b")}
    kept = lambda **how: sorted(r.doc_id for r in decontam.clean(texts, items, **how).collect())
    assert kept() == [1, 2, 4] and kept(least_words=1) == [4] and kept(least_words=20) == [1, 2, 3, 4]


def test_repeated_rows_of_a_shard(spark):
    """A row that is repeated more often than a piece has rows."""
    mine = spark.range(9000).selectExpr("if(id % 3 = 0, id, 7) as doc_id", "if(id % 3 = 0, 'x', null) as text")
    rows = sharding.assign(mine).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.place)
    assert len(rows) == 9000 and all(sorted(x) == list(range(len(x))) for x in by.values())
    places = sorted(r.place for r in rows if r.doc_id == 7)
    assert len(places) == 6000 and places == list(range(places[0], places[0] + 6000))


def test_token_records(docs, none, tmp_path):
    path = token_records.default_tokenizer()
    plain = Tokenizer.from_file(path)
    files = token_records.write_records(docs, str(tmp_path / "t"), file_bytes=4000)
    got = sorted(token_records.read_records(files, with_ids=True).collect(), key=lambda r: r.start)
    rows = sorted(docs.selectExpr("doc_id", "text", "xxhash64(text) as h").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (r.doc_id, start, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    name = files.first().file
    raw = bytearray(open(name + ".bin", "rb").read())
    raw[-6] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        index = np.frombuffer(open(name + ".idx", "rb").read(), "<u8").reshape(-1, 3)
        token_records.unframe(bytes(raw), int(index[-1, 0]), int(index[-1, 1]))
    assert token_records.read_records(token_records.write_records(none, str(tmp_path / "e"))).count() == 0


def test_special_tokens():
    enc = token_records.Encoder(token_records.default_tokenizer())
    got = enc.encode(pa.array(["a<|endoftext|>b c", "<|endoftext|>", "a <| b |> c", None]))
    assert [np.frombuffer(x, enc.dtype).tolist() for x in got[:2]] == [[64, 50256, 65, 269], [50256]] and got[3] == b""


def test_remembered_words(monkeypatch):
    """The words remembered stay within their bytes, long words aren't, and no id changes with what is remembered."""
    monkeypatch.setattr(token_records, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(token_records, "CHARS_OF_WORDS", 50)
    monkeypatch.setattr(token_records, "BYTES_AT_ONCE", 300)
    enc, plain = token_records.Encoder(token_records.default_tokenizer()), Tokenizer.from_file(token_records.default_tokenizer())
    texts = [t for t in make_texts(11) if t] + ["x" * 5000, "y" * 5000 + ". z" + "9" * 70 + ","]
    for some in (texts, texts[::-1]):
        got = enc.encode(pa.array(some))
        assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in some]
        assert enc.held <= 20_000 and max(map(len, [*enc.known, *enc.older])) <= token_records.CACHED_WORD


@pytest.mark.parametrize("text", ["a<|endoftext|>b c", "it's  two", "x\n\ny z", " lead", "trail ", "tab\tin it", "1,000. 2,a. b,, c.", "é f　g h", "a,\nb. c", "don't can't.", "q\x00 r", "\x1c s t", "...", "é, ü. 日本語, 中. ok", "", "\n", "\na.\nb", "a.!! b$$$ x'' 's", "a\x85b c", "🙂! a🙂 ²! 一!"])
def test_encoder(text):
    enc = token_records.Encoder(token_records.default_tokenizer())
    want = Tokenizer.from_file(token_records.default_tokenizer()).encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert np.frombuffer(enc.encode(pa.array([text]))[0], enc.dtype).tolist() == want


def test_pipeline_of_odd_rows(spark, docs, none, tmp_path):
    """Nulls, repeated rows, clashing columns and an empty table through every stage."""
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, rows in (("odd", docs), ("empty", none)):
        folder = tmp_path / name
        rows.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert (len(got) > 0) == (name == "odd")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = C.stage(stage(spark, now, str(tmp_path)), "test")
        assert now.columns == docs.columns
    assert Counter(str(r.doc_id) for r in corpus_pipeline.tokenize(spark, now, "").collect()) == Counter(str(r.doc_id) for r in now.collect())


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = C.stage(stage(spark, docs, data), "test")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = out
    copies = Counter(r.doc_id for r in docs.collect())
    assert Counter(r.doc_id for r in out.collect()) == copies and max(copies.values()) <= 2
    assert sorted(map(str, corpus_pipeline.run(spark, data).collect())) == sorted(map(str, out.collect()))


def test_jaccard_chains_need_more_than_a_passage(spark):
    """Texts that share a passage alone make no pair; texts that are alike do, through counted and through large groups."""
    rng = random.Random(7)
    made = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        passage = made(54)
        texts += [made(250) + passage + made(250) for _ in range(3)]
    apart = len(texts)
    for copies in (2, 3, 9):
        base = made(300)
        texts += [base[:j] + made(3) + base[j:] for j in range(10, 10 + 30 * copies, 30)]
    texts.append(texts[0])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    sets = jaccard.set_table(docs, 5, 0.8)
    key = {r.doc_id: r.key for r in sets.collect()}
    assert key[0] == key[len(texts) - 1]
    grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    for limit in (2, 4, 32):
        pairs = {(r.a, r.b) for r in jaccard.chains(sets, 0.8, limit).collect()}
        root = {k: k for k in key.values()}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {k: new if r == old else r for k, r in root.items()}
        assert all(root[key[i]] == root[key[j]] for i, j in alike)
        if limit > 3:
            assert len({root[key[i]] for i in range(apart)}) == apart


def test_jaccard_chains_cross_batches(spark):
    """Groups that go on over many gathered blocks lose no neighbour."""
    rows = [(i, i % 97 + 400, [5, 7 + i // 40, 1000 + i]) for i in range(3000)] + [(i, i % 97 + 400, [5]) for i in range(100)]
    sets = spark.createDataFrame(rows, "key long, n int, prefix array<long>")
    found = {(r.a, r.b) for r in jaccard.chains(sets, 0.8, gather=700).collect()}
    by_size = [k for _, k in sorted((n, k) for k, n, _ in rows[:3000])]
    assert set(zip(by_size, by_size[1:], strict=False)) <= found and all(a != b for a, b in found)


def test_driver_heap_is_tidied(spark, monkeypatch):
    """Between steps the driver's garbage is collected if there is much, and left alone if there is little."""
    from strataflow.llm import common

    collected = []
    runtime = type("Runtime", (), {"totalMemory": lambda s: 400 << 20, "freeMemory": lambda s: 100 << 20})()
    system = type("System", (), {"gc": staticmethod(lambda: collected.append(1))})
    lang = type("Lang", (), {"Runtime": type("R", (), {"getRuntime": staticmethod(lambda: runtime)})})
    jvm = type("Jvm", (), {"java": type("Java", (), {"lang": lang}), "System": system})
    fake = type("Session", (), {"sparkContext": type("Context", (), {"_jvm": jvm})})
    common.tidy(fake)
    assert collected == [1]
    monkeypatch.setattr(common, "HEAP_MB", 301)
    common.tidy(fake)
    assert collected == [1]
    asked = []
    monkeypatch.setattr(common, "tidy", asked.append)
    assert common.stage(spark.range(3)).count() == 3 and len(asked) == 1


def test_jaccard_sample_follows_the_texts(spark, monkeypatch):
    """A shingle of more than SHARED sets shows in the sample however many texts there are; shingles go in rounds without losing a pair."""
    rng = random.Random(3)
    made = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, base = made(9), made(200)
    texts = [made(20) + (passage if i % 4 == 0 else []) for i in range(600)] + [base[:j] + made(2) + base[j:] for j in (30, 90, 150)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    known, counts = jaccard.frequent(docs, 5, sample=20)
    assert set(known.tolist()) == {int(h >> np.uint64(32)) for h in hashing.Shingles(5)([" ".join(passage).encode()])[0]}
    assert len(known) == 5 and min(counts) >= jaccard.LEAST
    sets = jaccard.set_table(docs, 5, 0.8)
    whole = {(r.a, r.b) for r in jaccard.chains(sets, 0.8).collect()}
    assert len(jaccard.front_pairs(sets, 0.8)) == 1
    monkeypatch.setattr(jaccard, "ROUND_SETS", 100)
    assert len(jaccard.front_pairs(sets, 0.8)) == jaccard.ROUNDS > 1 and {(r.a, r.b) for r in jaccard.chains(sets, 0.8).collect()} == whole
    assert len(whole) == 3
