"""Graphs, reservations, trigram indexes, stored tables and databases against plain Python."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strataflow import catalogue
from strataflow.functions.text import trigrams
from strataflow.operators import graphs, reservations, trigram_index
from strataflow.plans import table_queries
from strataflow.sources import databases, seeds
from strataflow.sources.store import BucketStore

DATA = "/root/testdata/sf0.001"


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(3)
    path = list(range(10_000))
    rng.shuffle(path)
    pairs = [(path[i], path[i + 1]) for i in range(9_999)] + [(20_000 + rng.randrange(60), 20_000 + rng.randrange(60)) for _ in range(40)] + [(30_000, 30_000)]
    got = graphs.components(spark.createDataFrame([*pairs, (None, 3), (1, None)], "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == plain_components(pairs)
    names = [("b", "c"), ("a", "b"), ("x", "y")]
    assert {r.node: r.component for r in graphs.components(spark.createDataFrame(names, "a string, b string"), "a", "b").collect()} == plain_components(names)
    assert graphs.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_levels(pairs):
    nodes, after, need = set(), {}, {}
    for a, b in set(pairs):
        nodes |= {a, b}
        after.setdefault(a, []).append(b)
        need[b] = need.get(b, 0) + 1
    level = {n: 0 for n in nodes if n not in need}
    ready, out = list(level), {}
    while ready:
        n = ready.pop()
        out[n] = level[n]
        for b in after.get(n, []):
            level[b] = max(level.get(b, 0), level[n] + 1)
            need[b] -= 1
            if not need[b]:
                ready.append(b)
    return {n: out.get(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "random", "cycles", "ring"])
def test_levels(spark, kind):
    rng = random.Random(5)
    pairs = {
        "path": [(i, i + 1) for i in range(10_000)] + [(50, 20_001), (20_001, 20_002), (20_002, 70)],
        "random": [tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)] * 2,
        "cycles": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (0, 1), (7, 8), (9, 9), (9, 10)],
        "ring": [(i, (i + 1) % 7) for i in range(7)] + [(20, 21), (21, 22)],
    }[kind]
    got = graphs.levels(spark.createDataFrame([*pairs, (None, 1), (2, None)], "a long, b long"), "a", "b").collect()
    assert {r.node: r.level for r in got} == plain_levels(pairs)
    assert graphs.levels(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_decisions(draws):
    left, out = {}, {}
    for seq in sorted({d[0] for d in draws}):
        own = [d for d in draws if d[0] == seq]
        out[seq] = all(h is not None and left.get(a, 0) + m <= h for _, a, m, h in own)
        if out[seq]:
            for _, a, m, _ in own:
                left[a] = left.get(a, 0) + m
    return out


def test_reservations_in_a_chain(spark):
    # every order shares an account with the one before, which holds enough for one of them
    draws = [(i, f"a{i + k}", 6.0, 10.0) for i in range(2_000) for k in (0, 1)] + [(5_000 + i, "one", 4.0, 10.0) for i in range(40)] + [(9_000, "one", 1.0, 10.0), (9_001, "none", 1.0, None)]
    got = {r.seq: r.accepted for r in reservations.decide(spark.createDataFrame(draws, "seq long, account string, amount double, held double").repartition(5)).collect()}
    assert got == plain_decisions(draws) and got[0] and not got[1] and got[1998]


@pytest.mark.parametrize("seed", [1, 2])
def test_reservations_with_few_rounds(spark, seed):
    rng = random.Random(seed)
    held = {a: float(rng.randint(5, 60)) for a in "abcdefghij"}
    draws = [(s, a, float(rng.randint(1, 12)), held[a]) for s in range(150) for a in rng.sample("abcdefghij", rng.randint(1, 3))]
    df = spark.createDataFrame(draws, "seq long, account string, amount double, held double")
    for rounds in (0, 1, 4):
        assert {r.seq: r.accepted for r in reservations.decide(df, rounds).collect()} == plain_decisions(draws)


NAMES = [(1, "small widget"), (2, "small widgets"), (3, "Small  Widget"), (4, "large bolt"), (5, "large bolts"), (6, None), (7, ""), (8, "?!"), (9, "small widget"), (10, "été chaud"), (11, "été chauds"), (12, "a")]


def grams(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", trigrams(F.col("t")).alias("g"))
    return {texts[r.i]: set(r.g or []) for r in df.collect()}


def test_trigram_index(spark):
    rng = random.Random(2)
    rows = NAMES + [(100 + i, " ".join(rng.choice(["small", "widget", "bolt", "nut", "large", "nuts"]) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string")
    known = grams(spark, [t for _, t in rows if t is not None] + ["smal widget"])
    like = lambda a, b: len(known[a] & known[b]) / max(len(known[a] | known[b]), 1)
    found = trigram_index.look_up(trigram_index.index(df, "id", "name"), "smal widget", 0.3)
    want = {i: round(like(t, "smal widget"), 6) for i, t in rows if t is not None and like(t, "smal widget") > 0.3}
    assert {r.id: r.score for r in found.collect()} == want
    best = trigram_index.look_up(trigram_index.index(df, "id", "name"), "smal widget", 0.0, 3).collect()
    assert [r.id for r in best] == sorted(want, key=lambda i: (-want[i], i))[:3]
    for least in (0.4, 0.7, 1.0):
        pairs, members = trigram_index.join(df, "id", "name", least)
        first = {}
        for i, t in sorted(rows):
            if t is not None:
                first.setdefault(t, i)
        texts = sorted(first, key=first.get)
        close = {(first[a], first[b]): round(like(a, b), 6) for x, a in enumerate(texts) for b in texts[x + 1 :] if known[a] and known[b] and like(a, b) >= least}
        assert {(r.a, r.b): r.score for r in pairs.collect()} == close and close
        assert {(r.id, r.member) for r in members.collect()} == {(first[t], i) for i, t in rows if t is not None}
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_store(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, v string, n int").schema
    store = BucketStore(spark, str(tmp_path / "s"), schema, "k", ["v"], 8)
    load = lambda rows: spark.createDataFrame(rows, schema)
    assert store.rows().count() == 0 and store.upsert(load([]), "n") == {"new": 0, "updated": 0, "same": 0}
    first = [(f"k{i}", f"v{i}", 1) for i in range(40)] + [("x", None, 1), ("e", "", 1), (None, "lost", 1), ("k3", "older", 0), ("k4", "v4", 1)]
    assert store.upsert(load(first), "n") == {"new": 42, "updated": 0, "same": 0}
    before = store.files()
    assert store.upsert(load([("k1", "v1", 2), ("x", None, 2), ("e", "", 2)]), "n") == {"new": 0, "updated": 0, "same": 3}
    assert store.files() == before
    second = [("k1", "new", 3), ("k1", "newer", 4), ("k2", "v2", 3), ("e", None, 3), ("x", "", 3)]
    assert store.upsert(load(second), "n") == {"new": 0, "updated": 3, "same": 1}
    state = {r.k: (r.v, r.n) for r in store.rows().collect()}
    want = {k: (v, n) for k, v, n in first if k is not None and v != "older"} | {"k1": ("newer", 4), "e": (None, 3), "x": ("", 3)}
    assert state == want
    bucket = lambda p: p.split("bucket=")[1].split("/")[0]
    gone = {bucket(p) for p in before if p not in store.files()}
    kept = {bucket(p) for p in before if p in store.files()}
    assert gone and kept and not gone & kept and len(gone) <= 3


def test_jdbc(spark):
    url = "jdbc:derby:memory:test;create=true"
    rows = [(i, f"n{i}", i / 4) for i in range(200)] + [(900, None, None)]
    seeds.write_jdbc(spark.createDataFrame(rows, "k long, name string, v double").repartition(6), url, "t", parts=3, batch=17)
    back = seeds.read_jdbc(spark, url, "t", key="k", bounds=(0, 200), parts=4)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == rows
    some = back.where("k > 190").select("k")
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(k), *GreaterThan(k,190)]" in plan.replace("K", "k") and some.count() == 10
    seeds.write_jdbc(spark.createDataFrame([(901, "more", 1.0)], "k long, name string, v double"), url, "t", mode="append")
    assert seeds.read_jdbc(spark, url, "t").count() == 202


def test_databases_of_a_cluster(spark, tmp_path, monkeypatch):
    """Without a database's url a cluster has the same rows; nulls, text of any kind and odd names come back; no rows make none."""
    want = sorted(map(tuple, table_queries.jdbc_roundtrip(spark, DATA).collect()))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://some:7077")
    monkeypatch.setattr(table_queries.files, "scratch_path", lambda spark, kind: f"file://{tmp_path}/{kind}")
    found = table_queries.jdbc_roundtrip(spark, DATA)
    assert want and sorted(map(tuple, found.collect())) == want
    rows = [(i, f"n'{i}\"\n", i / 4) for i in range(200)] + [(-(2**63), "é\u0400", None), (None, None, float("inf"))]
    df = spark.createDataFrame(rows, 'k long, `a "b` string, v double')
    for some in (df, df.limit(0)):
        made = databases.write(some, str(tmp_path / "x"), "t", "k", parts=3, batch=7)
        back = databases.read(spark, str(tmp_path / "x"), made, "t", some.schema, batch=9)
        assert back.dtypes == some.dtypes and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, some.collect()), key=str)
    made = databases.write(df, str(tmp_path / "y"), "t", "k", parts=3)
    assert len(made) == 3 and databases.read(spark, str(tmp_path / "y"), made, "t", df.schema, "k > 190").count() == 9


def test_jobs_in_order(spark):
    edges = [(r.needs, r.job) for r in [*_jobs(spark)]]
    place = {r.job: r.place for r in table_queries.dag_order(spark, DATA).collect()}
    assert edges and all(place[a] < place[b] for a, b in edges)


def _jobs(spark):
    spark.read.parquet(f"{DATA}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(table_queries.JOBS).collect()


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_levels_in_blocks(spark, size):
    """Rounds are as many as the blocks that a path crosses: a ladder of 400 layers, whose nodes have two edges in and two out, takes few."""
    rng = random.Random(9)
    ladder = [(2 * i + x, 2 * i + 2 + y) for i in range(400 if size > 7 else 12) for x in (0, 1) for y in (0, 1)]
    hub = [(5_000, 5_001 + i) for i in range(30)] + [(5_001 + i, 6_000) for i in range(30)]
    ring = [(7_000 + i, 7_000 + (i + 1) % 40) for i in range(40)] + [(7_005, 8_000), (8_000, 8_001)]
    free = [(9_000 + i, 9_000 + (i + 1) % 23) for i in range(23)]
    pairs = [*ladder, *hub, *ring, *free, *((rng.randrange(10_000, 10_030), rng.randrange(10_030, 10_060)) for _ in range(60))]
    ran = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"levels {size}", "levels")
    got = graphs.levels(spark.createDataFrame(pairs, "a long, b long"), "a", "b", size).collect()
    assert {r.node: r.level for r in got} == plain_levels(pairs)
    assert size < 1000 or len(ran.getJobIdsForGroup(f"levels {size}")) < 300
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_store_counts_rows(spark, tmp_path):
    """Two pages of a load under one url are told one after the other, as the SQL does, page by page."""
    pages = [(i, None if i == 17 else f"u{i // 2 if i < 20 else i}", "a" if i in (4, 5) else f"h{i}") for i in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    state, told = {}, {}
    for i in range(table_queries.LOADS):
        for p, u, h in sorted(pages):
            if p % 3 == i or u is None:
                continue
            html = h + "!" * (p % 5 == i)
            kind = "new" if u not in state else "same" if state[u][1] == html else "updated"
            told[i, kind] = told.get((i, kind), 0) + 1
            state[u] = (p, html, i if kind != "same" else state[u][2])
    assert {(r.loaded, r.kind): r.n for r in table_queries.store_loads(spark, str(tmp_path)).collect()} == told and told[0, "updated"]
    got = {r.url: (r.digest, r.loaded) for r in table_queries.store_state(spark, str(tmp_path)).collect()}
    assert got == {u: (hashlib.md5(h.encode()).hexdigest(), i) for u, (_, h, i) in state.items()}


def test_store_equals_sql(spark, tmp_path):
    """Null pages, and same pages under another number, against the SQL; pages of one url are alike where a load has both, so that no order matters."""
    pages = [(i, f"u{i}", None if i % 4 == 0 else f"h{i}") for i in range(60)]
    pages += [(154, "a", "h"), (158, "a", "h"), (169, "b", None), (173, "b", None), (112, None, "h"), (None, "d", "h")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    found = duckdb.connect()
    found.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("store_state", "store_loads"):
        got = catalogue.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(found.sql(catalogue.oracle_sql()[name]).fetchall()), name
