"""Neighbours, trees, linear models and clusters against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import clusters, linear_models, neighbours, ranking, trees
from strataflow.plans import learning_queries


def vectors(n, dims=3, seed=1, spread=4):
    rng = random.Random(seed)
    return [(i, [float(rng.choice([0, 8, 30]) + rng.randint(0, spread)) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("n", "k", "pivots"), [(400, 5, None), (60, 7, 3), (4, 9, 2), (1, 2, None)])
def test_nearest(spark, n, k, pivots):
    rows = vectors(n)  # few distinct values, so that many distances tie
    df = spark.createDataFrame([*rows, (1000, None)], "id long, v array<double>").repartition(3)
    index = neighbours.build(df, "id", "v", pivots)
    asked = df.where("id % 3 = 0")
    got = {}
    for r in neighbours.nearest(index, asked, k).collect():
        got.setdefault(r.q, []).append((r.place, r.dist, r.id))
    for q, v in rows:
        if q % 3 == 0:
            want = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:k]
            assert [(p, d, i) for p, d, i in sorted(got.get(q, []))] == [(p + 1, d, i) for p, (d, i) in enumerate(want)]


def test_nearest_prunes(spark):
    df = spark.createDataFrame(vectors(900), "id long, v array<double>")
    index = neighbours.build(df, "id", "v")
    asked = df.where("id % 20 = 0")
    assert neighbours.compared(index, asked, 5) < 0.5 * 45 * 900
    plan = neighbours.nearest(index, asked, 5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert neighbours.nearest(neighbours.build(df.limit(0), "id", "v"), df, 5).count() == 0


@pytest.mark.parametrize(("n", "k", "block"), [(400, 5, 64), (400, 5, 10_000), (4, 7, 2), (0, 3, 8)])
def test_nearest_in_blocks(spark, n, k, block):
    rows = vectors(n)
    df = spark.createDataFrame([*rows, (1000, None)], "id long, v array<double>").withColumn("label", F.col("id") % 7).repartition(3)
    got = {}
    found = neighbours.nearest_in_blocks(df, df.where("id % 3 = 0"), "id", "v", k, ["label"], block)
    for r in found.collect():
        assert r.label == r.id % 7
        got.setdefault(r.q, []).append((r.place, r.dist, r.id))
    for q, v in rows:
        if q % 3 == 0:
            want = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:k]
            assert [(p, d, i) for p, d, i in sorted(got.get(q, []))] == [(p + 1, d, i) for p, (d, i) in enumerate(want)]


def test_knn_compares_in_blocks(spark):
    """Vectors meet by blocks, not as rows of pairs whose distances Spark's expressions compute."""
    plan = learning_queries.knn_classify(spark, "/root/testdata/sf0.01")._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan


def test_knn_regress_asks_for_every_vector(spark):
    data = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    want = {}
    for r, v in zip(rows, x, strict=True):
        near = sorted((round(d, 6), o.vec_id, o.label) for d, o in zip(((x - v) ** 2).sum(1), rows, strict=True) if o.vec_id != r.vec_id)
        want[r.vec_id] = round(sum(label for _, _, label in near[:5]) / 5, 6)
    assert {r.q: r.value for r in learning_queries.knn_regress(spark, data).collect()} == want and len(want) == len(rows)


def plain_tree(x, ys, w, depth, min_split, min_leaf, cut, node=0):
    """{leaf or split by node}, by trying every cut."""
    n = sum(w)
    value = [sum(a * b for a, b in zip(w, y, strict=True)) / n for y in ys]
    alike = all(len({v for v, a in zip(y, w, strict=True) if a}) == 1 for y in ys)
    best = None
    if depth and n >= max(min_split, 2 * min_leaf) and not alike:
        squares = sum(a * v * v for y in ys for a, v in zip(w, y, strict=True))
        for f in range(len(x[0])):
            values = sorted({r[f] for r, a in zip(x, w, strict=True) if a})
            for v, after in zip(values, values[1:], strict=False):
                left = [r[f] <= v for r in x]
                ln = sum(a for a, s in zip(w, left, strict=True) if s)
                if ln < min_leaf or n - ln < min_leaf:
                    continue
                gain = 0.0
                for y in ys:
                    ly = sum(a * b for a, b, s in zip(w, y, left, strict=True) if s)
                    ry = sum(a * b for a, b, s in zip(w, y, left, strict=True) if not s)
                    gain += ly * ly / ln + ry * ry / (n - ln)
                at = {"middle": (v + after) / 2, "lower": v, "upper": after}[cut]
                best = min(best or (math.inf,), (-round(gain / squares, 9), f, at, left))
    if best is None:
        return {node: value}
    _, f, at, left = best
    out = {node: (f, at)}
    for side, child in ((True, 2 * node + 1), (False, 2 * node + 2)):
        keep = [i for i, s in enumerate(left) if s == side]
        out |= plain_tree([x[i] for i in keep], [[y[i] for i in keep] for y in ys], [w[i] for i in keep], depth - 1, min_split, min_leaf, cut, child)
    return out


def tree_rows(n=160, seed=2):
    rng = random.Random(seed)
    x = [[float(rng.randint(0, 12)), rng.choice([0.5, 1.5, 2.5]), 7.0] for _ in range(n)]
    y = [float((r[0] > 4) != (r[1] > 1) and rng.random() > 0.1) for r in x]
    return x, y, [rng.randint(0, 3) for _ in x]


@pytest.mark.parametrize(("cut", "min_split", "min_leaf", "weighted", "large"), [("middle", 2, 1, False, False), ("lower", 20, 7, False, True), ("upper", 2, 3, True, False), ("middle", 2, 2, True, True)])
def test_tree(spark, monkeypatch, cut, min_split, min_leaf, weighted, large):
    if large:
        monkeypatch.setattr(trees, "WINDOW_ROWS", 0)  # ranges of values are summed first
    x, y, w = tree_rows()
    w = w if weighted else [1] * len(x)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(x, y, w, strict=True))] + [(900, None, 1.0, 1), (901, [1.0, None, 2.0], 0.0, 1), (902, [1.0, 2.0, 3.0], None, 1)], "id int, x array<double>, y double, w int").repartition(4)
    df, names = trees.indicators(df, "y", [0.0, 1.0])
    got = trees.grow(df, names, 4, min_split, min_leaf, cut, "w" if weighted else None)
    want = plain_tree(x, [[float(v == c) for v in y] for c in (0.0, 1.0)], w, 4, min_split, min_leaf, cut)
    assert {n: s for n, s in want.items() if isinstance(s, tuple)} == got.splits
    assert all(got.values[n] == pytest.approx(v) for n, v in want.items() if isinstance(v, list))
    said = {r.id: r.s for r in df.select("id", got.at("x").alias("s")).collect()}
    for i, r in enumerate(x):
        node = 0
        while node in got.splits:
            f, at = got.splits[node]
            node = 2 * node + (1 if (r[f] <= at if cut == "lower" else r[f] < at) else 2)
        assert said[i] == got.values[node]
    assert said[900] is None


def test_tree_of_nothing(spark):
    none = spark.createDataFrame([], "x array<double>, y double")
    assert trees.grow(none, ["y"], 3).values == {} and trees.boost(none, "y", 2, 0.1, 1, True) == (0.0, [])
    alike = spark.createDataFrame([([1.0], 2.0), ([2.0], 2.0)], "x array<double>, y double")
    assert trees.grow(alike, ["y"], 3).values == {0: [2.0]}


@pytest.mark.parametrize("logistic", [True, False])
def test_boost(spark, logistic):
    x, y, _ = tree_rows()
    df = spark.createDataFrame(list(zip(x, y, strict=True)), "x array<double>, y double")
    start, made = trees.boost(df, "y", 3, 0.3, 2, logistic)
    mean = sum(y) / len(y)
    assert start == pytest.approx(math.log(mean / (1 - mean)) if logistic else mean)
    score = [start] * len(x)
    for tree in made:
        left = [v - (1 / (1 + math.exp(-s)) if logistic else s) for v, s in zip(y, score, strict=True)]
        want = plain_tree(x, [left], [1] * len(x), 2, 2, 1, "upper")
        assert {n: s for n, s in want.items() if isinstance(s, tuple)} == tree.splits
        for i, r in enumerate(x):
            node = 0
            while node in tree.splits:
                node = 2 * node + (1 if r[tree.splits[node][0]] < tree.splits[node][1] else 2)
            score[i] += 0.3 * want[node][0]
    said = [r[0] for r in df.select(trees.boosted(start, made, 0.3, "x")).collect()]
    assert sorted(said) == pytest.approx(sorted(score))


def test_forest(spark):
    x, y, _ = tree_rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double")
    drawn = df.select(*[trees.bootstrap(["id"], t).alias(f"t{t}") for t in range(30)]).collect()
    counts = [v for r in drawn for v in r]
    assert abs(sum(counts) / len(counts) - 1) < 0.05 and abs(counts.count(0) / len(counts) - math.exp(-1)) < 0.02
    made = trees.forest(df, ["y"], ["id"], 2, 3, feature_share=0.6)
    assert [t.splits for t in made] == [t.splits for t in trees.forest(df.repartition(7), ["y"], ["id"], 2, 3, feature_share=0.6)]
    assert made[0].splits != made[1].splits
    votes = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.1, 0.2, 0.7],), (None,)], "s array<double>").select(trees.vote(F.col("s"), ["a", "b", "c"])).collect()
    assert [r[0] for r in votes] == ["a", "c", None]


@pytest.mark.parametrize("newton", [False, True])
def test_logistic(spark, newton):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=200) > 0.3).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)] + [(None, 1.0), ([1.0, None, 2.0], 0.0), ([1.0, 2.0, 3.0], None)], "x array<double>, y double").repartition(3)
    got_w, got_b = linear_models.fit_logistic(df, "y", 3, 8, 0.2, c=0.5, decay=0.1, newton=newton)
    w, b, rate, penalty = np.zeros(3), 0.0, 0.2, 1 / (0.5 * 200)
    for step in range(8):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        if newton:
            ext = np.column_stack([np.ones(200), x])
            grad = ext.T @ (p - y) / 200 + np.append(0, penalty * w)
            move = np.linalg.solve((ext * (p * (1 - p))[:, None]).T @ ext / 200 + np.diag([0] + [penalty] * 3), grad)
        else:
            move = rate * np.append(np.mean(p - y), x.T @ (p - y) / 200 + penalty * w)
        b, w, rate = b - move[0], w - move[1:], 0.2 / (1 + 0.1 * step)
    assert np.allclose(got_w, w, atol=1e-6) and got_b == pytest.approx(b, abs=1e-6)
    assert linear_models.fit_logistic(df.limit(0), "y", 3, 2)[1] == 0.0


def test_ridge(spark):
    rng = np.random.default_rng(4)
    x, fold = rng.normal(size=(150, 2)) + 3, np.arange(150) % 5
    y = x @ [2.0, -1.0] + 4 + rng.normal(size=150)
    df = spark.createDataFrame([(r.tolist(), float(v), int(f)) for r, v, f in zip(x, y, fold, strict=True)], "x array<double>, y double, fold int")
    scores = linear_models.ridge_scores(linear_models.moments(df, "y", 2, "fold"), [0.1, 50.0])
    for alpha, got in scores.items():
        want = []
        for f in range(5):
            a, c = x[fold != f], y[fold != f]
            w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + alpha * np.eye(2), (a - a.mean(0)).T @ (c - c.mean()))
            said = (x[fold == f] - a.mean(0)) @ w + c.mean()
            want.append(1 - ((y[fold == f] - said) ** 2).sum() / ((y[fold == f] - y[fold == f].mean()) ** 2).sum())
        assert got == pytest.approx(np.mean(want))


def test_lloyd(spark):
    rows = vectors(120, dims=2)
    df = spark.createDataFrame([*rows, (500, None)], "id long, x array<double>")
    start = clusters.seeds(df, "id", "x", 4)
    assert start == clusters.seeds(df.repartition(5), "id", "x", 4) and all(c in [v for _, v in rows] for c in start)
    centres = [list(c) for c in start]
    for _ in range(4):
        near = [min(range(4), key=lambda c: (round(sum((a - b) ** 2 for a, b in zip(v, centres[c], strict=True)), 9), c)) for _, v in rows]
        centres = [np.mean([v for (_, v), c in zip(rows, near, strict=True) if c == i], axis=0).tolist() if i in near else centres[i] for i in range(4)]
    assert np.allclose(clusters.lloyd(df, "x", start, 4), centres)
    assert df.where("id = 500").select(clusters.nearest("x", start)).first()[0] is None and clusters.lloyd(df.limit(0), "x", [], 3) == []


def test_running_by(spark):
    rng = random.Random(6)
    rows = [(g, float(v), rng.randint(1, 9)) for g in "abc" for v in rng.sample(range(500), 90)] + [("d", 1.0, 2)]
    got = ranking.running_by(spark.createDataFrame(rows, "g string, v double, n long").repartition(5), ["g"], "v", {"upto": "n"}).collect()
    want = set()
    for g in "abcd":
        own, total = sorted(r[1:] for r in rows if r[0] == g), 0
        for i, (v, n) in enumerate(own):
            total += n
            want.add((g, v, float(total), own[i + 1][0] if i + 1 < len(own) else None))
    assert {(r.g, r.v, r.upto, r.next_v) for r in got} == want


def test_rows_of_models_in_pieces(spark, tmp_path, monkeypatch):
    """A model's task holds a piece of the lines, however many there are."""
    held = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    lines.coalesce(1).write.option("parquet.block.size", 1 << 16).parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    assert learning_queries._lines(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(learning_queries, "MODEL_BYTES", 1 << 17)
    rows = learning_queries._lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 4 and rows.count() == lines.count()
    for n in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(n)
    for n, v in held.items():
        spark.conf.set(n, v)
