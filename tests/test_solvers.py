"""Matrices of any size with nulls and singular ones; the cache with a time to live against a plain loop."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strataflow.operators import linear
from strataflow.plans import registry, solver_queries
from strataflow.session import ship, views
from strataflow.sources import files
from strataflow.streaming import streams

DATA = "/root/testdata/sf0.001"


def test_solve(spark):
    ship(spark)
    # fixed values: a system of four unknowns
    a, b = [-9, 8, 8, 6, -7, -9, 5, 4, -3, -1, 8, 0, 3, -1, -4, -5], [-81, -50, -69, 48]
    rows = [(0, a, b), (1, [2.0], [4.0]), (2, [1, 2, 2, 4], [1, 1]), (3, None, [1]), (4, [1, 2, 3], [1]), (5, [1, 0, 0, 1], [1]), (6, [], [])]
    rows = [(i, m and [float(x) for x in m], [float(x) for x in s]) for i, m, s in rows]
    df = spark.createDataFrame(rows, "i int, m array<double>, b array<double>")
    got = {r.i: r for r in df.select("i", linear.solve("m", "b").alias("x"), linear.inverse("m").alias("v")).collect()}
    assert np.allclose(np.reshape(a, (4, 4)) @ got[0].x, b) and got[1].x == [2.0]
    assert np.allclose(np.reshape(got[0].v, (4, 4)) @ np.reshape(a, (4, 4)), np.eye(4))
    assert [got[i].x for i in range(2, 7)] == [None] * 5 and got[2].v is None


def test_complex_pair(spark):
    ship(spark)
    # fixed values: a matrix with a complex pair
    a = [1.0, 7.0, -1.0, -2.0, 2.0, -2.0, 9.0, -7.0, 3.0]
    one = spark.createDataFrame([(a,)], "m array<double>").select(linear.eigenvalues("m").alias("v")).first().v
    want = np.linalg.eigvals(np.reshape(a, (3, 3)))
    assert np.allclose(np.poly([complex(x.re, x.im) for x in one]), np.poly(want))


def test_cache(spark):
    want = {}
    filled = {}
    rows = pq.read_table(f"{DATA}/events.parquet").to_pylist()
    for r in sorted(rows, key=lambda r: (int(r["ts"].timestamp()), r["event_id"])):
        user, at = r["user_id"], int(r["ts"].timestamp())
        hit = user in filled and at < filled[user] + streams.CACHE_SECONDS
        if not hit:
            filled[user] = at
        want.setdefault(user, [0, 0])[0 if hit else 1] += 1
    assert {r.user_id: [r.hits, r.misses] for r in streams.cache_hits(spark, DATA).collect()} == want


def test_csv(spark):
    rows = [(1, 'a "b", c'), (2, "two\nlines"), (3, None), (4, "nul\0l"), (5, "")]
    df = spark.createDataFrame(rows, "k long, s string")
    got = files.read_csv(spark, files.write_csv(df, files.scratch_path(spark, "csv")), "k long, s string")
    assert {r.k: r.s for r in got.select("k", F.coalesce("s", F.lit("none")).alias("s")).collect()} == {1: 'a "b", c', 2: "two\nlines", 3: "none", 4: "null", 5: ""}


def test_positions_of_texts_that_share_an_id(spark, tmp_path):
    """Against the SQL's window over the same rows; pieces of a text of its own are not shuffled."""
    rows = [(1, "It's -a- test, «да» x"), (2, None), (3, ""), (4, "--"), (5, "Éa b'"), (5, "c 'dé' e"), (None, "f g"), (None, "hh i"), (6, "z")]
    for some in (rows, [r for r in rows if r[0] not in (5, None)]):
        path = str(tmp_path / str(len(some)))
        spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        found = solver_queries.tokenize_positions(spark, path)
        views(spark, path, "documents")
        want = spark.sql(registry._render(solver_queries.POSITIONS, 0))
        assert found.dtypes == want.dtypes
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
