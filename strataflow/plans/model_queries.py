"""Models fitted by Spark aggregations (trees, forests, boosting, logistic and ridge regression, k-means), and their forms in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, linear_models, trees
from ..session import table
from .registry import query

VECTORS = "select vec_id, label % 2 as y, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings"
LINES = "select l_orderkey, l_linenumber, round(l_extendedprice) as y, [l_quantity, l_discount, l_tax] as x from lineitem"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("y"), F.col("embedding").cast("array<double>").alias("x"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round("l_extendedprice").alias("y"), F.array("l_quantity", "l_discount", "l_tax").alias("x"))


def _tree_sql(name: str, rows: str, targets: list[str], depth: int, cut: str, weight: str = "1") -> str:
    """CTEs of a tree: {name} has the rows of the CTE {rows}, with t0, t1, … for what the tree predicts. Every level is one
    aggregation by node, feature and value, and one window."""
    ys = [f"y{i}" for i in range(len(targets))]
    each = lambda form: ", ".join(form.format(y=y) for y in ys)
    where, op = {"middle": ("(v + next_v) / 2", "<"), "lower": ("v", "<="), "upper": ("next_v", "<")}[cut]
    gain = " + ".join(f"(l{y} * l{y} / ln + (a{y} - l{y}) * (a{y} - l{y}) / (an - ln))" for y in ys)
    out = [f"{name}_0 as (select *, 0 as node, {weight} as w, {', '.join(f'cast({t} as double) as {y}' for t, y in zip(targets, ys, strict=True))} from {rows})"]
    for i in range(depth):
        here = f"{name}_{i}"
        out += [
            f"{here}t as (select node, sum(w) as an, {each('sum(w * {y}) as a{y}')}, {' + '.join(f'sum(w * {y} * {y})' for y in ys)} as sq from {here} where w > 0 group by node having {' or '.join(f'max({y}) > min({y})' for y in ys)})",
            f"{here}v as (select node, f, v, sum(w) as n, {each('sum(w * {y}) as {y}')} from (select node, w, {', '.join(ys)}, unnest(range(len(x))) as f, unnest(x) as v from {here} where w > 0) group by node, f, v)",
            f"{here}c as (select node, f, v, lead(v) over k as next_v, sum(n) over k as ln, {each('sum({y}) over k as l{y}')} from {here}v window k as (partition by node, f order by v rows between unbounded preceding and current row))",
            f"{here}b as (select node, f, cut from (select node, f, cut, row_number() over (partition by node order by loss, f, cut) as r from (select node, f, {where} as cut, -round(({gain}) / sq, 9) as loss from {here}c join {here}t using (node) where next_v is not null)) where r = 1)",
            f"{name}_{i + 1} as (select l.* exclude (node), case when b.node is null then l.node when l.x[b.f + 1] {op} b.cut then 2 * l.node + 1 else 2 * l.node + 2 end as node from {here} l left join {here}b b on l.node = b.node)",
        ]
    last = f"{name}_{depth}"
    out.append(f"{name} as (select l.* exclude (node, w, {', '.join(ys)}), {', '.join(f't{i}' for i in range(len(ys)))} from {last} l join (select node, {', '.join(f'sum(w * {y}) / sum(w) as t{i}' for i, y in enumerate(ys))} from {last} where w > 0 group by node) using (node))")
    return ",\n".join(out)


@query(f"with r as ({VECTORS}), {_tree_sql('g', 'r', ['y = 0', 'y = 1'], 2, 'middle')} select vec_id, y, round(t1, 6) as share, case when t0 >= t1 then 0 else 1 end as prediction from g")
def tree_levels_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gini tree of depth 2 on vectors: the share of odd labels in each vector's leaf, and the class voted."""
    rows, names = trees.indicators(_vectors(spark, sf_dir), "y", [0, 1])
    tree = trees.grow(rows, names, 2)
    return rows.select("vec_id", "y", F.round(tree.predict("x", 1), 6).alias("share"), trees.vote(tree.at("x"), [0, 1]).alias("prediction"))


@query(f"with r as ({LINES}), {_tree_sql('g', 'r', ['y'], 2, 'lower')} select l_orderkey, l_linenumber, y, round(t0, 2) as prediction from g")
def tree_levels_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A squared-error tree of depth 2 on the price of lines."""
    rows = _lines(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", "y", F.round(trees.grow(rows, ["y"], 2, cut="lower").predict("x"), 2).alias("prediction"))


_START = "start as (select ln(p / (1 - p)) as s from (select avg(y) as p from r))"
_LEFT = "{to} as (select r.*, {f} as f, y - 1 / (1 + exp(-({f}))) as left_over from {frm})"


@query(f"""with r as ({VECTORS}), {_START},
one as (select r.*, s as f, y - 1 / (1 + exp(-s)) as left_over from r cross join start), {_tree_sql('g', 'one', ['left_over'], 1, 'upper')},
two as (select vec_id, y, x, f + 0.1 * t0 as f, y - 1 / (1 + exp(-(f + 0.1 * t0))) as left_over from g), {_tree_sql('h', 'two', ['left_over'], 1, 'upper')}
select vec_id, y, round(1 / (1 + exp(-(f + 0.1 * t0))), 6) as chance, case when f + 0.1 * t0 >= 0 then 1 else 0 end as prediction from h""")
def boost_cls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of boosted stumps on vectors, from the logit of the mean, each on what is left of the labels."""
    rows = _vectors(spark, sf_dir)
    start, made = trees.boost(rows, "y", 2, 0.1, 1, logistic=True)
    score = trees.boosted(start, made, 0.1, "x")
    return rows.select("vec_id", "y", F.round(1 / (1 + F.exp(-score)), 6).alias("chance"), (score >= 0).cast("int").alias("prediction"))


@query(f"""with r as ({LINES}),
one as (select r.*, m as f, y - m as left_over from r cross join (select avg(y) as m from r)), {_tree_sql('g', 'one', ['left_over'], 2, 'upper')},
two as (select l_orderkey, l_linenumber, y, x, f + 0.5 * t0 as f, y - (f + 0.5 * t0) as left_over from g), {_tree_sql('h', 'two', ['left_over'], 2, 'upper')}
select l_orderkey, l_linenumber, y, round(f + 0.5 * t0, 2) as prediction from h""")
def boost_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of boosted trees of depth 2 on the price of lines."""
    rows = _lines(spark, sf_dir)
    start, made = trees.boost(rows, "y", 2, 0.5, 2, logistic=False)
    return rows.select("l_orderkey", "l_linenumber", "y", F.round(trees.boosted(start, made, 0.5, "x"), 2).alias("prediction"))


def _draws(key: str, tree: int) -> str:
    u = f"cast('0x' || left(md5({key} || ':{tree}'), 8) as bigint) / 4294967296.0"
    return " + ".join(f"cast({u} >= {p} as int)" for p in trees.POISSON)


_FOREST = 3


@query(f"""with r as ({VECTORS}), {", ".join(_tree_sql(f"g{i}", "r", ["y = 0", "y = 1"], 2, "middle", _draws("cast(vec_id as varchar)", i)) for i in range(_FOREST))}
select vec_id, y, round((g0.t1 + g1.t1 + g2.t1) / 3, 6) as share, case when (g0.t0 >= g0.t1)::int + (g1.t0 >= g1.t1)::int + (g2.t0 >= g2.t1)::int >= 2 then 0 else 1 end as prediction
from g0 join g1 using (vec_id, y) join g2 using (vec_id, y)""")
def forest_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three Gini trees on samples drawn by a hash: the mean share of odd labels, and what most trees vote."""
    rows, names = trees.indicators(_vectors(spark, sf_dir), "y", [0, 1])
    made = trees.forest(rows, names, ["vec_id"], _FOREST, 2)
    odd = sum((trees.vote(t.at("x"), [0, 1]) for t in made), F.lit(0))
    return rows.select("vec_id", "y", F.round(trees.mean_of(made, "x", 2)[1], 6).alias("share"), (odd * 2 > _FOREST).cast("int").alias("prediction"))


_STEPS, _RATE = 4, 0.5


def _steps_sql() -> str:
    out = [f"r as ({VECTORS})", "w0 as (select list_transform(range(64), lambda i: 0.0::double) as w, 0.0::double as b, (select count(*) from r) as n)"]
    for i in range(_STEPS):
        out += [
            f"e{i} as (select x, 1 / (1 + exp(-(list_dot_product(x, w) + b))) - y as e from r cross join w{i})",
            f"d{i} as (select list(d order by f) as d from (select f, sum(e * v) as d from (select e, unnest(range(len(x))) as f, unnest(x) as v from e{i}) group by f))",
            f"w{i + 1} as (select [w[k] - {_RATE} * (d[k] / n + w[k] / n) for k in range(1, 65)] as w, b - {_RATE} * (select sum(e) from e{i}) / n as b, n from w{i} cross join d{i})",
        ]
    return ", ".join(out)


@query(f"with {_steps_sql()} select vec_id, y, round(1 / (1 + exp(-(list_dot_product(x, w) + b))), 6) as chance from r cross join w{_STEPS}")
def logreg_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression on vectors by a few steps down the gradient, each one aggregation."""
    rows = _vectors(spark, sf_dir)
    w, b = linear_models.fit_logistic(rows, "y", 64, _STEPS, _RATE)
    return rows.select("vec_id", "y", F.round(linear_models.sigmoid(linear_models.linear("x", w, b)), 6).alias("chance"))


ALPHAS = [0.1, 1.0, 10.0, 50.0, 100.0]
_X = ["q", "d", "t"]
_DET = lambda m: " + ".join(f"({m[0][i]} * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]}))" for i in range(3))
_M = [[f"s{min(i, j)}{max(i, j)}" + (" + alpha" if i == j else "") for j in range(3)] for i in range(3)]
_M = [[f"({c})" for c in r] for r in _M]
_CRAMER = [f"({_DET([[f'c{i}' if j == k else _M[i][j] for j in range(3)] for i in range(3)])}) / ({_DET(_M)})" for k in range(3)]


@query(f"""with r as (select l_orderkey % 5 as fold, l_quantity as q, l_discount as d, l_tax as t, round(l_extendedprice) as y from lineitem),
folds as (select distinct fold from r),
m as (select k.fold, {", ".join(f"avg({a}) as m{i}" for i, a in enumerate(_X))}, avg(y) as my,
        {", ".join(f"covar_pop({_X[i]}, {_X[j]}) * count(*) as s{i}{j}" for i in range(3) for j in range(i, 3))}, {", ".join(f"covar_pop({a}, y) * count(*) as c{i}" for i, a in enumerate(_X))}
      from folds k join r on r.fold <> k.fold group by k.fold),
b as (select *, {", ".join(f"{c} as b{k}" for k, c in enumerate(_CRAMER))} from m cross join (select unnest({ALPHAS}) as alpha))
select alpha, round(avg(r2), 6) as r2 from (
  select alpha, b.fold, 1 - sum((y - my - b0 * (q - m0) - b1 * (d - m1) - b2 * (t - m2)) ** 2) / (var_pop(y) * count(*)) as r2 from b join r on r.fold = b.fold group by alpha, b.fold) group by alpha""")
def ridge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean R² of each penalty over five folds, all from one pass that sums each fold's products."""
    rows = _lines(spark, sf_dir).withColumn("fold", F.col("l_orderkey") % 5)
    scores = linear_models.ridge_scores(linear_models.moments(rows, "y", 3, "fold"), ALPHAS)
    return spark.createDataFrame([(a, round(v, 6)) for a, v in scores.items()], "alpha double, r2 double")


_K = 5


def _lloyd_sql(rounds: int) -> str:
    out = [f"r as ({VECTORS})", f"c0 as (select row_number() over (order by md5(cast(vec_id as varchar)), vec_id) - 1 as c, x as m from r qualify c < {_K})"]
    near = "select vec_id, x, arg_min(c, (round(list_sum([(x[i] - m[i]) * (x[i] - m[i]) for i in range(1, len(x) + 1)]), 9), c)) as c from r cross join c{i} group by vec_id, x"
    for i in range(rounds):
        out.append(f"a{i} as ({near.replace('{i}', str(i))})")
        out.append(f"c{i + 1} as (select c, list(s order by f) as m from (select c, f, avg(v) as s from (select c, unnest(range(len(x))) as f, unnest(x) as v from a{i}) group by c, f) group by c)")
    out.append(f"a{rounds} as ({near.replace('{i}', str(rounds))})")
    return ", ".join(out)


@query(f"with {_lloyd_sql(2)} select vec_id, cast(c as int) as cluster from a2")
def kmeans_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of k-means on vectors, from seeds that a hash chooses."""
    rows = _vectors(spark, sf_dir)
    centres = clusters.lloyd(rows, "x", clusters.seeds(rows, "vec_id", "x", _K), 2)
    return rows.select("vec_id", clusters.nearest("x", centres).alias("cluster"))
