"""A prefix trie over conversations, as a table of nodes.

A node stands for a distinct sequence of first turns (role and text); conversations that start with it are its members, and the
smallest member owns it. Members of a node are members of the node above, so a conversation that owns a node owns all of its own
deeper ones: what it owns is a chain from a first depth to its end. That depth is found by binary search, all conversations at
once: each round joins one prefix a conversation with the table of minima by prefix. A chain hangs on the node above its first
one; chains with these links form a tree, whose totals are added from the bottom up. A round adds to each chain what stands at a
distance, and doubles the distance, so rounds grow with the logarithm of the tree's height.

Prefixes are told apart by digests: sums of 32-bit parts of a hash of each turn and its place, with 128 bits in all, so that running
sums make them and no task has to hold a conversation. Turns are dealt into ranges, equal ones too, and summed by conversation
and range first.

Defined cases: null roles and texts are empty; turns of one number stand in the order of role and text, nulls first; repeated
rows are turns of their own; rows without a conversation's id belong to none; a conversation without turns of its own left is a
member of the root; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Conversations share the first turns of the conversation that begins their group; a checksum of the id says how many.
GROUP, SHARED = 20, 4
SUMS = ("s0", "s1", "s2", "s3")
#: Nodes of a chain that one task sums up, and members' ids that are joined into one string.
STRETCH, IDS = 4096, 8192


def running(df: DataFrame, keys: list[str], chunk: str, order: list, values: dict[str, str]) -> DataFrame:
    """Add, for each name in `values`, the sum of its column up to this row, by keys, in the order (chunk, *order): sums of
    chunks first, then over the chunks, then within each."""
    zero = F.lit(0).cast("long")
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, chunk).agg(*[F.sum(v).alias(f"__{k}") for k, v in values.items()])
    sums = sums.select(*[F.col(c).alias(f"__k_{c}") for c in (*keys, chunk)], *[F.coalesce(F.sum(f"__{k}").over(before), zero).alias(f"__{k}") for k in values])
    joined = df.join(sums, [df[c].eqNullSafe(sums[f"__k_{c}"]) for c in (*keys, chunk)])
    within = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumns({k: F.col(f"__{k}") + F.sum(v).over(within) for k, v in values.items()}).drop(*[f"__{k}" for k in values], *[f"__k_{c}" for c in (*keys, chunk)])


def placed(turns: DataFrame) -> DataFrame:
    """Every turn with its place (from 1) in its conversation, staged: conv_id, pid, place, role, text."""
    told = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("uid"), F.lit(1).cast("long").alias("one"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text", "uid")]
    ranges = C.ordered_chunks(told, F.struct("conv_id", "turn", "role", "text", "uid"), "turns").withColumnRenamed("__pid", "pid")
    numbered = running(ranges, ["conv_id"], "pid", order, {"place": "one"})
    return C.stage(numbered.select("conv_id", "pid", "place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "places")


def rebuilt(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): each conversation's id and number of turns; each of its turns as conv_id, depth, the parts of its digest
    so far (s0 to s3) and its words. The first turns are those of the conversation that begins its group."""
    own = placed(turns)
    sizes = C.stage(own.groupBy("conv_id").agg(F.max("place").alias("n")), "sizes")
    share = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), share.alias("h"))
    bases = sizes.select(F.col("conv_id").alias("__base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, F.col("base") == F.col("__base"), "left").drop("__base")
    convs = C.stage(convs.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations")
    # at most `group` conversations on either side of zero take a turn
    heads = own.where(F.col("place") < shared).select(F.col("conv_id").alias("__from"), "place", "role", "text")
    taken = convs.join(heads, (F.col("base") == F.col("__from")) & (F.col("place") <= F.col("h")))
    taken = taken.select("conv_id", F.lit(-1).alias("pid"), F.col("place").alias("depth"), "role", "text")
    facts = convs.select(F.col("conv_id").alias("__conv"), "h", "k")
    kept = own.join(facts, F.col("conv_id") == F.col("__conv")).where("place > h")
    kept = kept.select("conv_id", "pid", F.expr("place - h + k").alias("depth"), "role", "text")
    words = F.size(C.words(F.col("text"))).cast("long")
    digest = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = kept.union(taken).select("conv_id", "pid", "depth", words.alias("words"), digest.alias("__d"))
    rows = C.stage(rows.select("conv_id", "pid", "depth", "words", *[F.conv(F.substring("__d", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"p{i}") for i in range(4)]), "rebuilt")
    rows = C.stage(running(rows, ["conv_id"], "pid", ["depth"], {s: f"p{i}" for i, s in enumerate(SUMS)}).select("conv_id", "depth", "words", *SUMS), "prefixes")
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("length"))
    convs = convs.select("conv_id").join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0).cast("long")).alias("length"))
    return C.stage(convs, "lengths"), rows


def first_owned(convs: DataFrame, rows: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, length, first): the first depth whose prefix has the conversation as its smallest member; length + 1 if none has.

    All conversations search at once: a round joins one prefix of each that isn't done with the minima. A prefix that very many
    conversations share is a hot key of one side alone, which Spark splits."""
    found = []
    now = C.stage(convs.where("length > 0").select("conv_id", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high")), "search")
    probes = rows.select(F.col("conv_id").alias("__conv"), "depth", *SUMS)
    least = minima.select(F.col("owner"), F.col("depth").alias("__depth"), *[F.col(s).alias(f"__{s}") for s in SUMS])
    while True:
        found.append(now.where("low = high").select("conv_id", "length", F.col("low").alias("first")))
        left = now.where("low < high").withColumn("mid", F.expr("(low + high) div 2"))
        if not left.limit(1).count():
            break
        asked = left.join(probes, (F.col("conv_id") == F.col("__conv")) & (F.col("mid") == F.col("depth")))
        told = asked.join(least, (F.col("depth") == F.col("__depth")) & (F.col("s0") == F.col("__s0")) & (F.col("s1") == F.col("__s1")) & (F.col("s2") == F.col("__s2")) & (F.col("s3") == F.col("__s3")))
        owned = F.col("owner") == F.col("conv_id")
        now = C.stage(told.select("conv_id", "length", F.when(owned, F.col("low")).otherwise(F.col("mid") + 1).alias("low"), F.when(owned, F.col("mid")).otherwise(F.col("high")).alias("high")), "search")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved): sums over each chain and all that hang on it, directly or not, given (conv_id, parent, leaves, saved).
    After a round each sum reaches twice as far below, and each link twice as far up."""
    now = C.stage(chains.select("conv_id", "parent", "leaves", "saved"), "chains")
    while now.where("parent is not null").limit(1).count():
        below = now.where("parent is not null").groupBy(F.col("parent").alias("__to")).agg(F.sum("leaves").alias("__l"), F.sum("saved").alias("__s"))
        above = now.select(F.col("conv_id").alias("__up"), F.col("parent").alias("__next"))
        after = now.join(below, F.col("conv_id") == F.col("__to"), "left").join(above, F.col("parent") == F.col("__up"), "left")
        zero = F.lit(0).cast("long")
        after = C.stage(after.select("conv_id", F.col("__next").alias("parent"), (F.col("leaves") + F.coalesce("__l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("__s", zero)).alias("saved")), "chains")
        C.discard(now)
        now = after
    return now.select("conv_id", "leaves", "saved")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node joined, in the order of a sorted range: strings of up to IDS ids."""
    key, held, seq, out = None, [], 0, []

    def shut() -> None:
        nonlocal held, seq
        if held:
            out.append((*key, seq, ",".join(map(str, held))))
            held, seq = [], seq + 1

    def handed() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 5
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["owner", "depth", "pid", "seq", "ids"])
        out.clear()
        return made

    for batch in batches:
        for *now, member in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if now != key or len(held) == IDS:
                shut()
            key = now
            held.append(member)
        if sum(len(x[4]) for x in out) > 1 << 20:
            yield handed()
    shut()
    yield handed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings, as they come in order, joined by commas; none is held."""
    key, state, out = None, None, []
    for batch in batches:
        for owner, depth, ids in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (owner, depth) != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (owner, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield _digest_batch(out)
            out = []
    if state is not None:
        out.append((*key, state.hexdigest()))
    yield _digest_batch(out)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["owner", "depth", "sha"])


def ends(members: DataFrame) -> DataFrame:
    """(owner, depth, sha): the digest of the ascending ids of members that end at a node, given (owner, depth, conv_id). Ranges of
    ids become strings first; a node's strings then stream through one digest, so that no task holds a node's members."""
    spark = members.sparkSession
    C.ready_python(spark)
    order = ["owner", "depth", "conv_id"]
    ranged = members.repartitionByRange(C.shuffle_width(spark), *order).sortWithinPartitions(*order)
    strings = ranged.select("owner", "depth", F.spark_partition_id().alias("pid"), "conv_id").mapInArrow(_strings, "owner long, depth long, pid int, seq long, ids string")
    strings = strings.repartition(C.shuffle_width(spark), "owner", "depth").sortWithinPartitions("owner", "depth", "pid", "seq")
    return strings.select("owner", "depth", "ids").mapInArrow(_digests, "owner long, depth long, sha string")


def nodes(turns: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """Per node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rows = rebuilt(turns, group, shared)
    minima = C.stage(rows.groupBy("depth", *SUMS).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")), "minima")
    searched = C.stage(first_owned(convs, rows, minima), "owned")
    root, count = convs.agg(F.min("conv_id"), F.count("*")).first()
    same = lambda a, b: [F.col(f"{a}depth") == F.col(f"{b}depth"), *[F.col(f"{a}{s}") == F.col(f"{b}{s}") for s in SUMS]]
    keyed = minima.select(F.col("depth").alias("m_depth"), *[F.col(s).alias(f"m_{s}") for s in SUMS], "owner", "n_convs")

    # the node that a conversation's chain hangs on; for those that own none, the node at which they end
    above = searched.select(F.col("conv_id").alias("__conv"), "length", "first", (F.col("first") - 1).alias("at"))
    hung = above.join(rows, (F.col("__conv") == F.col("conv_id")) & (F.col("at") == F.col("depth")), "left")
    conditions = same("", "m_")
    on = conditions[0]
    for more in conditions[1:]:
        on = on & more
    hung = hung.join(keyed, on, "left")
    hung = C.stage(hung.select(F.col("__conv").alias("conv_id"), "length", "first", "at", F.when(F.col("at") == 0, F.lit(root).cast("long")).otherwise(F.col("owner")).alias("parent")), "hung")
    chains = hung.where("first <= length")

    # the nodes of every chain: what is owned, and the root
    known = hung.select(F.col("conv_id").alias("__conv"), "length", "first", "parent")
    owned = rows.join(known, F.col("conv_id") == F.col("__conv")).where("depth >= first").join(keyed, on)
    owned = owned.select("conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "length", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    top = convs.where(F.col("conv_id") == F.lit(root)).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(count).cast("long").alias("n_convs"), "length", F.lit(0).cast("long").alias("own"))
    all_nodes = owned.union(top)

    # chains of others by the node that they hang on; the root's owner has the root above its chain, as a part of it
    others = chains.where(F.col("conv_id") != F.lit(root))
    by_node = others.groupBy(F.col("parent").alias("__p"), F.col("at").alias("__at")).agg(F.count("*").alias("hanging"))
    zero = F.lit(0).cast("long")
    all_nodes = all_nodes.join(by_node, (F.col("conv_id") == F.col("__p")) & (F.col("depth") == F.col("__at")), "left")
    goes_on = (F.col("depth") < F.col("length")).cast("long")
    all_nodes = C.stage(all_nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "own", (F.coalesce("hanging", zero) + goes_on).alias("n_children")), "nodes")

    leaf = (F.col("n_children") == 0).cast("long")
    chain_sums = all_nodes.groupBy("conv_id").agg(F.sum(leaf).alias("leaves"), F.sum("own").alias("saved"))
    links = others.select(F.col("conv_id").alias("__c"), "parent", "at")
    linked = C.stage(chain_sums.join(links, F.col("conv_id") == F.col("__c"), "left").select("conv_id", "parent", "at", "leaves", "saved"), "linked")
    full = C.stage(totals(linked), "totals")

    # a node's subtree: the chain from it on, and all that hangs on those nodes
    hanging = linked.where("parent is not null").select("conv_id", "parent", "at").join(full, "conv_id")
    added = hanging.groupBy(F.col("parent").alias("__p"), F.col("at").alias("__at")).agg(F.sum("leaves").alias("add_leaves"), F.sum("saved").alias("add_saved"))
    here = all_nodes.join(added, (F.col("conv_id") == F.col("__p")) & (F.col("depth") == F.col("__at")), "left")
    # summed from a chain's end upwards
    here = here.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (leaf + F.coalesce("add_leaves", zero)).alias("l"), (F.col("own") + F.coalesce("add_saved", zero)).alias("s"), F.expr(f"-(depth div {STRETCH})").alias("stretch"))
    here = running(C.stage(here, "weights"), ["conv_id"], "stretch", [F.col("depth").desc()], {"n_leaves": "l", "saved_tokens": "s"})

    # members that end at a node: owners at their chain's end, others at the node before the first that they would own
    ending = searched_ends(convs, hung, root)
    shas = ends(ending).select(F.col("owner").alias("__o"), F.col("depth").alias("__e"), "sha")
    out = here.join(shas, (F.col("conv_id") == F.col("__o")) & (F.col("depth") == F.col("__e")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"))


def searched_ends(convs: DataFrame, hung: DataFrame, root: int | None) -> DataFrame:
    """(owner, depth, conv_id): the node at which each conversation ends."""
    some = hung.select(F.when(F.expr("first <= length"), F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.col("length").alias("depth"), "conv_id")
    turnless = convs.where("length = 0").select(F.lit(root).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv_id")
    return some.union(turnless)
