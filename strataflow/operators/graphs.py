"""Graphs as tables of edges: components, chains, levels and an order, in staged rounds without a bound on their number.

Nodes may be numbers or text. Edges with a null end, and loops in `components`, are left out; repeated edges count once; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sources.files import discard
from .ranking import running, staged_at

#: Nodes and edges that a block of `levels` holds, about.
BLOCK = 1 << 18


class _Stage:
    """Staged tables of one job, each let go of once the next stands."""

    def __init__(self):
        self.held: dict[str, str] = {}

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        made, path = staged_at(df, "graph")
        if name in self.held:
            discard(df.sparkSession, self.held[name])
        self.held[name] = path
        return made


def pointers(links: DataFrame, keep: _Stage | None = None) -> DataFrame:
    """(node, head, steps) from (node, next, steps): where following links from each node ends, and the sum of steps on the way. Rounds
    double the distance that a link spans; links must not go round in circles."""
    keep = keep or _Stage()
    now = keep("pointers", links.select("node", F.col("next").alias("head"), F.col("steps").cast("long").alias("steps")))
    while True:
        ahead = now.select(F.col("node").alias("__node"), F.col("head").alias("__head"), F.col("steps").alias("__steps"))
        joined = now.join(ahead, F.col("head") == F.col("__node"), "left")
        now = keep("pointers", joined.select("node", F.coalesce("__head", "head").alias("head"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.col("__head").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("node", "head", "steps")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for each node that has an edge, the smallest node that it is connected with.

    A round hangs every node on its smallest neighbour if that is smaller, follows these links to their ends, and goes on with the
    graph of the ends. All but local minima vanish in a round; of every two neighbours one isn't a minimum."""
    keep = _Stage()
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    clean = keep("clean", clean.distinct())
    pairs = keep("pairs", clean.where("u <> v"))
    total = keep("total", clean.select(F.col("u").alias("node")).union(clean.select("v")).distinct().withColumn("component", F.col("node")))
    while pairs.limit(1).count():
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("next")).where("next < node")
        ends = pointers(least.withColumn("steps", F.lit(1)), keep).select(F.col("node").alias("__node"), F.col("head").alias("__end"))
        moved = total.join(ends, F.col("component") == F.col("__node"), "left")
        total = keep("total", moved.select("node", F.coalesce("__end", "component").alias("component")))
        left = pairs.join(ends, F.col("u") == F.col("__node"), "left").select(F.coalesce("__end", "u").alias("u"), "v")
        left = left.join(ends, F.col("v") == F.col("__node"), "left").select("u", F.coalesce("__end", "v").alias("v"))
        pairs = keep("pairs", left.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return total


def _chained(links: DataFrame, keep: _Stage) -> DataFrame:
    """(node, head, steps) as `pointers`, of links (node, next) that part into paths and rings, as no two have one next. A ring is cut
    at its smallest node, which has no row then: once a link spans the ring, that node is the least of those ahead of itself."""
    now = keep("chained", links.select("node", F.col("next").alias("head"), F.lit(1).cast("long").alias("steps"), F.col("next").alias("least")))
    while True:
        ahead = now.select(F.col("node").alias("__node"), F.col("head").alias("__head"), F.col("steps").alias("__steps"), F.col("least").alias("__least"))
        joined = now.join(ahead, F.col("head") == F.col("__node"), "left")
        steps = F.col("steps") + F.coalesce("__steps", F.lit(0))
        now = keep("chained", joined.select("node", F.coalesce("__head", "head").alias("head"), steps.alias("steps"), F.least("least", "__least").alias("least"), F.col("__head").isNotNull().alias("moved")))
        on = now.where("moved")
        if on.isEmpty():
            return now.select("node", "head", "steps")
        tops = on.where("least = node").select(F.col("node").alias("__top"))
        if tops.isEmpty() or not on.join(tops, F.col("least") == F.col("__top"), "left_anti").isEmpty():
            continue
        cut = links.join(on.where("least <> node").select(F.col("node").alias("__node")), F.col("node") == F.col("__node"), "left_semi")
        rings = pointers(cut.withColumn("steps", F.lit(1)), keep)
        return now.where("not moved").select("node", "head", "steps").union(rings)


def _run(edges: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
    """A block's nodes after those at hand have handed on their levels along its own edges, as far as that goes."""
    after: dict = {}
    for a, b, w, n in zip(edges["a"].tolist(), edges["b"].tolist(), edges["w"].tolist(), edges["needed"].tolist(), strict=True):
        after.setdefault(a, []).append((b, w, n))
    held = {node: [level, met, n] for node, level, met, n in zip(at["node"].tolist(), at["level"].tolist(), at["met"].tolist(), at["needed"].tolist(), strict=True)}
    ready = [node for node, (_, met, n) in held.items() if met == n]
    while ready:
        node = ready.pop()
        level = held[node][0]
        for b, w, n in after.get(node, ()):
            x = held.setdefault(b, [0, 0, n])
            x[0], x[1] = max(x[0], level + w), x[1] + 1
            if x[1] == n:
                ready.append(b)
    block = at["block"].iloc[0] if len(at) else 0
    return pd.DataFrame([(block, node, *x) for node, x in held.items()], columns=["block", "node", "level", "met", "needed"])


def levels(edges: DataFrame, a: str, b: str, size: int = BLOCK) -> DataFrame:
    """(node, level): the number of edges on the longest path to each node along edges from a to b; null for nodes on a cycle and those
    that come after one.

    Chains, whose nodes have one edge in from a node with one edge out, are first drawn together to their heads, whatever their
    length. The rest is dealt into blocks of neighbouring nodes of about `size` nodes and edges, and peeled: nodes whose edges in have all
    been passed hand on their level. In a round each block that has such nodes goes on by itself as far as its own edges lead, and then
    edges between blocks, and those of nodes that have more than `size`, are passed by a join. So rounds are as many as a path changes
    blocks, not as its edges: where edges lead to larger nodes, no more than there are blocks."""
    keep = _Stage()
    ship(edges.sparkSession)
    e = keep("edges", edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct())
    nodes = keep("nodes", e.select(F.col("a").alias("node")).union(e.select("b")).distinct())
    out_one = e.groupBy(F.col("a").alias("__a")).agg(F.count("*").alias("n_out")).where("n_out = 1")
    in_one = e.groupBy(F.col("b").alias("__b")).agg(F.count("*").alias("n_in")).where("n_in = 1")
    links = e.where("a <> b").join(out_one, F.col("a") == F.col("__a"), "left_semi").join(in_one, F.col("b") == F.col("__b"), "left_semi")
    links = keep("links", links.select(F.col("b").alias("node"), F.col("a").alias("next")))
    heads = keep("heads", _chained(links, keep).select(F.col("node").alias("__node"), F.col("head").alias("__head"), F.col("steps").alias("__steps")))
    near = e.join(heads.select("__node"), F.col("b") == F.col("__node"), "left_anti")
    near = near.join(heads, F.col("a") == F.col("__node"), "left")
    near = keep("near", near.select(F.coalesce("__head", "a").alias("a"), "b", (F.coalesce("__steps", F.lit(0).cast("long")) + 1).alias("w")))
    count = F.count("*")
    need = keep("need", near.groupBy(F.col("b").alias("__b")).agg(count.alias("needed")))
    out = near.groupBy(F.col("a").alias("node")).agg(count.alias("n")).union(need.select("__b", F.lit(0).cast("long")))
    out = out.groupBy("node").agg(F.max("n").alias("n"))
    places = running(out, [F.col("node")], {"upto": F.when(F.col("n") <= size, F.col("n") + 1).otherwise(1)})
    blocks = keep("blocks", places.select("node", F.floor((F.col("upto") - 1) / size).cast("int").alias("block"), (F.col("n") > size).alias("hub")))
    ends = near.join(need, F.col("b") == F.col("__b")).join(blocks.select(F.col("node").alias("__to"), F.col("block").alias("to")), F.col("b") == F.col("__to"))
    ends = ends.join(blocks, F.col("a") == F.col("node")).select("a", "b", "w", "needed", "block", "to", (F.col("hub") | (F.col("block") != F.col("to"))).alias("far"))
    ends = keep("ends", ends)
    inner, cross = ends.where("not far").select("block", "a", "b", "w", "needed"), ends.where("far").select("a", F.col("b").alias("__b"), "w", F.col("needed").alias("n"), "to")
    zero = F.lit(0).cast("long")
    first = nodes.join(heads.select("__node"), F.col("node") == F.col("__node"), "left_anti").join(need, F.col("node") == F.col("__b"), "left_anti")
    # nodes without a block hand on nothing but along their chain
    now = first.join(blocks.select(F.col("node").alias("__n"), "block"), F.col("node") == F.col("__n"), "left")
    now = keep("sums1", now.select("block", "node", zero.alias("level"), zero.alias("met"), zero.alias("needed")))
    schema = f"block int, node {nodes.schema['node'].dataType.simpleString()}, level long, met long, needed long"
    whole, path = staged_at(now.where("block is null"), "layer")
    done, now = [path], now.where("block is not null")
    while True:
        active = keep(f"active{len(done) % 2}", now.where("met = needed").select(F.col("block").alias("__block")).distinct())
        if active.isEmpty():
            break
        on = F.col("block") == F.col("__block")
        moving = now.join(F.broadcast(active), on, "left_semi")
        own = inner.join(F.broadcast(active), on, "left_semi")
        ran, path = staged_at(own.groupBy("block").cogroup(moving.groupBy("block")).applyInPandas(_run, schema), "layer")
        done.append(path)
        passed = cross.join(ran.where("met = needed").select("node", "level"), F.col("a") == F.col("node"))
        passed = passed.select(F.col("to").alias("block"), F.col("__b").alias("node"), (F.col("level") + F.col("w")).alias("level"), F.lit(1).cast("long").alias("met"), F.col("n").alias("needed"))
        waiting = ran.where("met < needed").union(now.join(F.broadcast(active), on, "left_anti"))
        sums = waiting.union(passed).groupBy("block", "node", "needed").agg(F.max("level").alias("level"), F.sum("met").alias("met"))
        now = keep(f"sums{len(done) % 2}", sums.select("block", "node", "level", "met", "needed"))
    peeled = nodes.sparkSession.read.schema(whole.schema).parquet(*done).where("met = needed")
    found = peeled.select(F.col("node").alias("__n"), F.col("level").alias("__l"))
    chained = heads.join(found, F.col("__head") == F.col("__n")).select(F.col("__node").alias("__n"), (F.col("__l") + F.col("__steps")).alias("__l"))
    return nodes.join(found.union(chained), F.col("node") == F.col("__n"), "left").select("node", F.col("__l").alias("level"))
