"""Decision trees grown level by level, and forests and boosted trees of them.

All nodes of a level are split at once by one aggregation: rows are summed by (node, feature, value), running sums within each
(node, feature) say what lies on either side of every cut, and each node takes the best cut. A tree has one value or more to
predict; splits make the sum of squared errors of them all least. With a 0/1 column for each class that is Gini impurity. A gain
counts as a share of the node's squares, rounded to nine digits; of equal gains the smaller feature, then the smaller cut, wins.

Only what is known of nodes comes to the driver: a row a node, at most twice 2^depth of them. Defined cases: rows with a null among features
or targets are left out of fitting and predicted as null; repeated rows count each; a table without rows gives an empty tree,
which predicts null; a node whose rows are alike in every feature, or in all targets, is a leaf.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running_by, staged

#: Distinct (node, feature, value) rows up to which one window a (node, feature) sums; beyond, ranges of values are summed first.
WINDOW_ROWS = 1_000_000
DIGITS = 9
#: Where a cut lies between two neighbouring values a and b: at their middle (x < cut), at a (x <= cut) or at b (x < cut).
CUTS = {"middle": ("(v + next_v) / 2", "<"), "lower": ("v", "<="), "upper": ("next_v", "<")}


@dataclass
class Tree:
    """Splits by node (feature, cut) and values by leaf; the root is 0, the children of n are 2n + 1 and 2n + 2."""

    op: str
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    values: dict[int, list[float]] = field(default_factory=dict)

    def at(self, x: str, node: int = 0) -> Column:
        """The values that a column of features leads to."""
        if node in self.splits:
            feature, cut = self.splits[node]
            here = F.col(x)[feature]
            left = here < cut if self.op == "<" else here <= cut
            return F.when(left, self.at(x, 2 * node + 1)).when(~left, self.at(x, 2 * node + 2))
        value = self.values.get(node)
        return F.lit(None).cast("array<double>") if value is None else F.array(*[F.lit(float(v)) for v in value])

    def predict(self, x: str, output: int = 0) -> Column:
        return self.at(x)[output]


def _step(tree: Tree, level: list[int]) -> Column:
    """The node of a row after a level was split; null where the row's node is a leaf."""
    out = F.lit(None).cast("int")
    for node in level:
        if node in tree.splits:
            feature, cut = tree.splits[node]
            here = F.col("x")[feature]
            left = here < cut if tree.op == "<" else here <= cut
            out = F.when(F.col("node") == node, F.when(left, F.lit(2 * node + 1)).otherwise(F.lit(2 * node + 2))).otherwise(out)
    return out


def grow(rows: DataFrame, targets: list[str], depth: int, min_split: int = 2, min_leaf: int = 1, cut: str = "middle", weight: str | None = None, features: Column | None = None) -> Tree:
    """A tree for the columns `targets` from the array column `x`. `weight` names a whole-number column by which rows count;
    `features` is a condition on (node, f) that says which features a node may split on."""
    place, op = CUTS[cut]
    tree, level = Tree(op), [0]
    w = F.col(weight) if weight else F.lit(1)
    known = F.exists("x", lambda v: v.isNull())
    ys = [f"y{i}" for i in range(len(targets))]
    base = rows.select("x", w.cast("long").alias("w"), *[F.col(t).cast("double").alias(y) for t, y in zip(targets, ys, strict=True)])
    base = staged(base.where(F.col("x").isNotNull() & ~known & (F.col("w") > 0)).na.drop(subset=ys), "tree-rows")
    now = base.withColumn("node", F.lit(0))
    for step in range(depth + 1):
        whole = now.groupBy("node").agg(
            F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(y)).alias(y) for y in ys], sum((F.sum(F.col("w") * F.col(y) * F.col(y)) for y in ys), F.lit(0.0)).alias("squares"),
            *[(F.max(y) == F.min(y)).alias(f"same_{y}") for y in ys],
        )
        met = {r["node"]: r for r in whole.collect()}
        for node, r in met.items():
            tree.values[node] = [r[y] / r["n"] for y in ys]
        open_nodes = sorted(n for n, r in met.items() if step < depth and r["n"] >= max(min_split, 2 * min_leaf) and not all(r[f"same_{y}"] for y in ys))
        if not open_nodes:
            break
        best = _best(now.where(F.col("node").isin(open_nodes)), met, open_nodes, ys, place, min_leaf, features)
        for node, feature, where in best:
            tree.splits[node] = (feature, where)
            del tree.values[node]
        if not best:
            break
        level = open_nodes
        now = now.withColumn("node", _step(tree, level)).where("node is not null")
        if step % 3 == 2:
            now = staged(now, "tree-rows")
    return tree


def _best(rows: DataFrame, met: dict, nodes: list[int], ys: list[str], place: str, min_leaf: int, features: Column | None) -> list[tuple[int, int, float]]:
    """(node, feature, cut) of the best split of each node that has one."""
    spread = rows.select("node", F.posexplode("x").alias("f", "v"), "w", *ys)
    spread = spread if features is None else spread.where(features)
    values = spread.groupBy("node", "f", "v").agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(y)).alias(y) for y in ys])
    values = staged(values, "tree-values")
    sums = {"left_n": "n"} | {f"left_{y}": y for y in ys}
    if values.count() <= WINDOW_ROWS:
        order = Window.partitionBy("node", "f").orderBy("v")
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cuts = values.withColumns({k: F.sum(v).over(upto) for k, v in sums.items()} | {"next_v": F.lead("v").over(order)})
    else:
        cuts = running_by(values, ["node", "f"], "v", sums)
    facts = rows.sparkSession.createDataFrame([(n, float(met[n]["n"]), float(met[n]["squares"]), *[float(met[n][y]) for y in ys]) for n in nodes], ", ".join(["node int, all_n double, squares double", *[f"all_{y} double" for y in ys]]))
    cuts = cuts.where("next_v is not null").join(F.broadcast(facts), "node")
    cuts = cuts.where((F.col("left_n") >= min_leaf) & (F.col("all_n") - F.col("left_n") >= min_leaf))
    gain = " + ".join(f"(left_{y} * left_{y} / left_n + (all_{y} - left_{y}) * (all_{y} - left_{y}) / (all_n - left_n))" for y in ys)
    scored = cuts.select("node", "f", F.expr(place).alias("cut"), F.expr(f"-round(({gain}) / squares, {DIGITS})").alias("loss"))
    found = scored.groupBy("node").agg(F.min(F.struct("loss", "f", "cut")).alias("b")).collect()  # a row a node
    return [(r["node"], r["b"]["f"], float(r["b"]["cut"])) for r in found]


def indicators(rows: DataFrame, label: str, classes: list) -> tuple[DataFrame, list[str]]:
    """The rows with a 0/1 column for each class, and the names of these columns."""
    names = [f"is_{i}" for i in range(len(classes))]
    return rows.withColumns({n: (F.col(label) == F.lit(c)).cast("double") for n, c in zip(names, classes, strict=True)}), names


def vote(share: Column, classes: list) -> Column:
    """The class with the largest share; of equals the first."""
    out = F.lit(classes[-1])
    for i in range(len(classes) - 2, -1, -1):
        ahead = F.lit(True)
        for j in range(i + 1, len(classes)):
            ahead = ahead & (share[i] >= share[j])
        out = F.when(ahead, F.lit(classes[i])).otherwise(out)
    return F.when(share.isNotNull(), out)


def drawn(key: list[str], *salt: int) -> Column:
    """A number from 0 up to 1 that the key and the salt fix: the first 32 bits of a digest."""
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key], *[F.lit(str(s)) for s in salt]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


#: Chances that a Poisson count of mean 1 is 0, at most 1, and so on.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def bootstrap(key: list[str], tree: int) -> Column:
    """How often a row is drawn into a tree's sample: a Poisson count of mean 1, so that no row has to know of others, and fixed by
    the row's key and the tree, so that reruns draw alike."""
    u = drawn(key, tree)
    return sum(((u >= p).cast("int") for p in POISSON), F.lit(0))


def forest(rows: DataFrame, targets: list[str], key: list[str], trees: int, depth: int, feature_share: float = 1.0, **how) -> list[Tree]:
    """Trees on bootstrap samples; with a share below 1 each node looks at that part of the features, by a hash."""
    made = []
    for i in range(trees):
        some = None if feature_share >= 1 else drawn(["node", "f"], i) < feature_share
        made.append(grow(rows.withColumn("__w", bootstrap(key, i)), targets, depth, weight="__w", features=some, **how))
    return made


def mean_of(trees: list[Tree], x: str, outputs: int = 1) -> Column:
    """The mean of what trees predict, for each output."""
    return F.array(*[sum((t.predict(x, i) for t in trees), F.lit(0.0)) / F.lit(float(len(trees))) for i in range(outputs)])


def boost(rows: DataFrame, target: str, rounds: int, rate: float, depth: int, logistic: bool, min_leaf: int = 1) -> tuple[float, list[Tree]]:
    """A start and trees, each fitted to what is left after those before it: of a 0/1 target in logits, or of a number. The
    scores so far are staged with the rows every few rounds, so that plans stay short."""
    mean = rows.where(F.col(target).isNotNull()).agg(F.avg(target)).first()[0]
    if mean is None:
        return 0.0, []
    clipped = min(max(mean, 1e-5), 1 - 1e-5)
    start = math.log(clipped / (1 - clipped)) if logistic else float(mean)
    now, trees = rows.select("x", F.col(target).cast("double").alias("__y")).withColumn("__f", F.lit(start)), []
    for _ in range(rounds):
        guess = 1 / (1 + F.exp(-F.col("__f"))) if logistic else F.col("__f")
        now = staged(now.withColumn("__left", F.col("__y") - guess), "residuals")
        tree = grow(now, ["__left"], depth, min_leaf=min_leaf, cut="upper")
        trees.append(tree)
        now = now.withColumn("__f", F.col("__f") + F.lit(rate) * tree.predict("x")).drop("__left")
    return start, trees


def boosted(start: float, trees: list[Tree], rate: float, x: str) -> Column:
    """The score of boosted trees: a logit, or a number."""
    return sum((F.lit(rate) * t.predict(x) for t in trees), F.lit(start))
