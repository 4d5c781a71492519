"""Trie of shared conversation prefixes, rolled up by centroid decomposition.

A prefix is named by its depth and a 128-bit sum of turn digests times powers of a base. Such sums can be cut anywhere:
turns are sorted over all tasks by range, each task sums what it holds, and at most one conversation a task edge is
carried over, so a conversation of any length is never in one task. A node is the group of equal names.

For the rollup every node weighs its members, so the weight of its whole subtree is already known when the node is made:
the turns that its members have from there on. A component is cut at its centroid, the deepest node that carries over
half of the weight; the nodes above it up to the component's top are those that carry over half as well. The total of
the centroid's side is added to them all, their weight falls, and the sides below go on by themselves. Components are cut
across the cluster until they fit a task, and inside tasks from there on. Weights halve, so rounds are logarithmic
whatever the depth of the trie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sarmotion.functions.joins import attach
from sarmotion.llm.common import _BASE, lean, shuffle_partitions, text_buffer, written

SHARED = 6  # a conversation takes over fewer turns than this
FAMILY = 100
LIMIT = 1 << 16
BLOCK = 4096
CHUNK = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()

_BASES = (_BASE, 0xD1B54A32D192ED03)
NAME = ["depth", "k1", "k2"]
COMPONENT = ["cd", "c1", "c2"]


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2^64; the base is odd, so negative exponents are powers of its inverse."""
    low = int(exponent.min(initial=0))
    if low < 0:
        return _power(base, exponent - low) * np.uint64(pow(base, low, 1 << 64))
    out, square, rest = np.ones(len(exponent), dtype=np.uint64), base, exponent.astype(np.uint64)
    while rest.any():
        out = np.where(rest & np.uint64(1) != 0, out * np.uint64(square), out)
        rest = rest >> np.uint64(1)
        square = square * square % (1 << 64)
    return out


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


# ---- places and prefix sums of every conversation's turns ----------------------------------------


def _summed(batches):
    """Places and prefix sums, counted from the first turn of the conversation that this task holds."""
    part = TaskContext.get().partitionId()
    last, place, held = None, 0, [np.uint64(0), np.uint64(0)]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("c").to_numpy()
        fresh = np.r_[last is None or conv[0] != last, conv[1:] != conv[:-1]]
        if fresh[0]:
            place, held = 0, [np.uint64(0), np.uint64(0)]
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(conv)), 0))
        first_run = start == 0
        own = np.arange(len(conv)) - start + np.where(first_run, place, 0)
        marks = text_buffer(batch.column("mark"))[0].copy().view("<u8").reshape(-1, 2)
        columns = []
        for lane in (0, 1):
            terms = marks[:, lane] * _power(_BASES[lane], own)
            sums = np.cumsum(terms, dtype=np.uint64)
            upto = sums - np.where(first_run, np.uint64(0), (sums - terms)[start]) + np.where(first_run, held[lane], np.uint64(0))
            columns += [_signed(upto), _signed(upto - terms)]
            held[lane] = upto[-1]
        last, place = conv[-1], int(own[-1]) + 1
        yield pa.record_batch(
            [pa.array(np.full(len(conv), part, dtype=np.int32)), batch.column("c"), pa.array(own), columns[0], columns[2],
             columns[1], columns[3], batch.column("chars")],
            names=["part", "c", "pos", "u1", "u2", "q1", "q2", "chars"],
        )


def _carried(batches):
    """What the earlier tasks hold of a conversation, for each further task that holds some of it."""
    for batch in batches:
        out = []
        for c, parts in zip(batch.column("c").to_pylist(), batch.column("parts").to_pylist()):
            place, sums = 0, [0, 0]
            for p in parts:
                out.append((p["part"], c, place, *(s - (1 << 64) if s >> 63 else s for s in sums)))
                for lane in (0, 1):
                    sums[lane] = (sums[lane] + pow(_BASES[lane], place, 1 << 64) * (p[f"u{lane + 1}"] % (1 << 64))) % (1 << 64)
                place += p["n"]
        columns = list(zip(*out)) or [()] * 5
        yield pa.record_batch(
            [pa.array(columns[0], pa.int32()), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["part", "c", "pos0", "v1", "v2"]
        )


def _continued(batches):
    for batch in batches:
        before = batch.column("pos0").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = {"c": batch.column("c"), "pos": pa.array(batch.column("pos").to_numpy() + before)}
        for lane in (0, 1):
            start = batch.column(f"v{lane + 1}").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            factor = _power(_BASES[lane], before)
            for kind in "uq":
                out[f"{kind}{lane + 1}"] = _signed(start + factor * _unsigned(batch, f"{kind}{lane + 1}"))
        out["chars"] = batch.column("chars")
        yield pa.record_batch([out[x] for x in _SUM_COLUMNS], names=_SUM_COLUMNS)


_SUM_COLUMNS = ["c", "pos", "u1", "u2", "q1", "q2", "chars"]
_SUMS = "u1 long, u2 long, q1 long, q2 long, chars long"


def turn_sums(turns: DataFrame) -> DataFrame:
    """c, place from 0, prefix sums with (u) and without (q) the turn, and its code points, for every turn."""
    n = shuffle_partitions(turns.sparkSession)
    dealt = turns.repartitionByRange(n, "c", "turn", "mark").sortWithinPartitions("c", "turn", "mark")
    local = written(dealt.mapInArrow(lean(_summed), f"part int, c long, pos long, {_SUMS}"))
    held = local.groupBy("part", "c").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("u1", "pos").alias("u1"), F.max_by("u2", "pos").alias("u2"))
    # Only a conversation that crosses a task edge is in several parts, so carries are fewer than twice the tasks.
    several = held.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "n", "u1", "u2"))).alias("parts")).where("size(parts) > 1")
    carries = several.mapInArrow(_carried, "part int, c long, pos0 long, v1 long, v2 long")
    return local.join(F.broadcast(carries), ["part", "c"], "left").mapInArrow(_continued, f"c long, pos long, {_SUMS}")


# ---- rebuilt conversations -----------------------------------------------------------------------


def _moved(batches):
    """Own turns behind the turns taken over: the sums of the own first turns are taken out, those of the others put in."""
    for batch in batches:
        shift = batch.column("taken").to_numpy() - batch.column("h").to_numpy()
        out = {"c": batch.column("c"), "depth": pa.array(batch.column("pos").to_numpy() + shift + 1)}
        for lane, short in ((0, "1"), (1, "2")):
            factor, gone, put = _power(_BASES[lane], shift), _unsigned(batch, f"own{short}"), _unsigned(batch, f"put{short}")
            out[f"k{short}"] = _signed(put + factor * (_unsigned(batch, f"u{short}") - gone))
            out[f"p{short}"] = _signed(put + factor * (_unsigned(batch, f"q{short}") - gone))
        out["chars"], out["size"] = batch.column("chars"), batch.column("size")
        yield pa.record_batch([out[x] for x in _PATH], names=_PATH)


_PATH = ["c", "depth", "k1", "k2", "p1", "p2", "chars", "size"]


def rebuilt_paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation: c and size; a row for each turn of a rebuilt one: its node, the node above, code points)."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("mark"),
        F.length(text).cast("long").alias("chars"),
    ).where("c is not null")
    sums = written(turn_sums(turns))
    head = F.when(F.col("pos") < SHARED - 1, F.struct("pos", "u1", "u2", "q1", "q2", "chars"))
    families = written(
        sums.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(head)).alias("heads"))
        .withColumn("h", F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(SHARED)).cast("long"))
        .withColumn("base", F.col("c") - F.col("c") % FAMILY)
    )
    given = families.select(F.col("c").alias("base"), F.col("heads").alias("taken_from"))
    zero = F.lit(0).cast("long")
    at = lambda heads, n, name: F.when(n > 0, F.get(heads, (n - 1).cast("int"))[name]).otherwise(zero)
    joined = families.join(given, "base", "left").withColumn(
        "taken", F.least(F.col("h"), F.coalesce(F.size("taken_from"), F.lit(0)).cast("long")))
    convs = joined.select(
        "c", "n", "h", "taken", F.slice("taken_from", F.lit(1), F.col("taken").cast("int")).alias("first_turns"),
        (F.col("taken") + F.greatest(F.col("n") - F.col("h"), zero)).alias("size"),
        *[at(F.col("taken_from"), F.col("taken"), f"u{i}").alias(f"put{i}") for i in (1, 2)],
        *[at(F.col("heads"), F.least("h", "n"), f"u{i}").alias(f"own{i}") for i in (1, 2)],
    )
    convs = written(convs)
    borrowed = convs.select("c", "size", F.inline("first_turns")).select(
        "c", (F.col("pos") + 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"),
        F.col("q1").alias("p1"), F.col("q2").alias("p2"), "chars", "size")
    # A conversation's row is dealt to blocks of its turns, so a long one is no hot key.
    blocks = convs.where("n > h").select(
        "c", "h", "taken", "size", "put1", "put2", "own1", "own2",
        F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / BLOCK))).alias("block"))
    own = sums.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(blocks, ["c", "block"]).where("pos >= h")
    kinds = ", ".join(f"{x} long" for x in _PATH)
    paths = borrowed.select(_PATH).unionByName(own.mapInArrow(lean(_moved), kinds))
    return convs.select("c", "size"), written(paths)


# ---- digests of the conversations that end at a node -----------------------------------------------


def _id_chunks(batches):
    """The ids of each node's conversations in this task, in order, joined by commas in chunks of bounded length."""
    name, first, ids = None, None, []

    def flushed():
        columns = [[name[0]], [name[1]], [name[2]], [first], [",".join(map(str, ids))]]
        return pa.record_batch(
            [*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.string())], names=[*NAME, "first", "ids"])

    for batch in batches:
        for own in zip(*(batch.column(x).to_pylist() for x in (*NAME, "c"))):
            if own[:3] != name or len(ids) >= CHUNK:
                if ids:
                    yield flushed()
                name, first, ids = own[:3], own[3], []
            ids.append(own[3])
    if ids:
        yield flushed()


def _digests(batches):
    """SHA-256 over a node's chunks one after the other; no more than a chunk is held."""
    name, state = None, None
    for batch in batches:
        out = []
        for *own, ids in zip(*(batch.column(x).to_pylist() for x in (*NAME, "ids"))):
            if own != name:
                if name is not None:
                    out.append((*name, state.hexdigest()))
                name, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digest_rows(out)
    if name is not None:
        yield _digest_rows([(*name, state.hexdigest())])


def _digest_rows(rows):
    columns = list(zip(*rows)) or [()] * 4
    return pa.record_batch(
        [*(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())], names=[*NAME, "ends_sha256"])


def end_digests(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """ends_sha256 of every node where a conversation ends.

    A digest is one sequence by definition, so a node's ids pass one task, as a stream of chunks; sorting and
    formatting them is dealt out by range.
    """
    n = shuffle_partitions(convs.sparkSession)
    zero = F.lit(0).cast("long")
    ends = paths.where("depth = size").select(*NAME, "c").unionByName(
        convs.where("size = 0").select(*(zero.alias(x) for x in NAME), "c"))
    chunks = ends.repartitionByRange(n, *NAME, "c").sortWithinPartitions(*NAME, "c").mapInArrow(
        _id_chunks, "depth long, k1 long, k2 long, first long, ids string")
    return chunks.repartition(n, *NAME).sortWithinPartitions(*NAME, "first").mapInArrow(
        _digests, "depth long, k1 long, k2 long, ends_sha256 string")


# ---- rollup --------------------------------------------------------------------------------------


def _preorder(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes in preorder, and where each node's subtree ends in that order."""
    children: list[list[int]] = [[] for _ in parent]
    tops = []
    for node, above in enumerate(parent.tolist()):
        (children[above] if above >= 0 else tops).append(node)
    order, stack = [], tops
    while stack:
        node = stack.pop()
        order.append(node)
        stack += children[node]
    size = np.ones(len(parent), dtype=np.int64)
    for node in reversed(order):
        if parent[node] >= 0:
            size[parent[node]] += size[node]
    order = np.array(order, dtype=np.int64)
    return order, np.arange(len(order)) + size[order]


def decomposed(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` over a forest (parent -1: a top), all components cut at their centroids at a time.

    ``weight`` is the weight of each node's whole subtree.
    """
    order, end = _preorder(parent)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    above = np.where(parent[order] >= 0, place[np.maximum(parent[order], 0)], -1)
    weight, values, sums = weight[order].copy(), values[order], np.zeros_like(values)
    # A component is labelled by its top.
    label = np.maximum.accumulate(np.where(above < 0, np.arange(len(order)), 0))
    left = np.arange(len(order))
    while len(left):
        left = left[np.argsort(label[left], kind="stable")]
        own = label[left]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        number = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(left)]))
        heavy = 2 * weight[left] > weight[left[begin]][number]
        centre = np.maximum.reduceat(np.where(heavy, left, -1), begin)
        c = centre[number]
        below = (left > c) & (left < end[c])
        total = np.add.reduceat(np.where((below | (left == c))[:, None], values[left], 0), begin, axis=0)
        path = left[heavy]
        sums[path] += total[number[heavy]]
        weight[path] -= weight[centre][number[heavy]]
        # The child of the centre that a node is under is the last such child before it in preorder.
        child = left[np.maximum.accumulate(np.where(above[left] == c, np.arange(len(left)), 0))]
        label[left] = np.where(below, child, own)
        left = left[left != c]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _within(part: pa.Table) -> pa.Table:
    """Whole components: subtree sums by decomposition, on top of what was added so far."""
    columns = {x: part.column(x).to_numpy() for x in (*NAME, "p1", "p2", *COMPONENT, "weight", "leaf", "saved", "leaves", "tokens")}
    names = list(zip(*(columns[x].tolist() for x in NAME)))
    at = {name: i for i, name in enumerate(names)}
    tops = list(zip(*(columns[x].tolist() for x in COMPONENT)))
    above = zip(columns["depth"].tolist(), columns["p1"].tolist(), columns["p2"].tolist())
    parent = np.fromiter(
        (-1 if name == top else at[d - 1, p1, p2] for name, top, (d, p1, p2) in zip(names, tops, above)), np.int64, len(names))
    found = decomposed(parent, columns["weight"], np.column_stack([columns["leaf"], columns["saved"]]))
    return pa.table(
        {**{x: part.column(x) for x in NAME}, "leaves": columns["leaves"] + found[:, 0], "tokens": columns["tokens"] + found[:, 1]})


_SUM_TYPES = "depth long, k1 long, k2 long, leaves long, tokens long"
_STATE = [*NAME, "p1", "p2", "m", *COMPONENT, "weight", "leaf", "saved", "leaves", "tokens"]


def _cut(large: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over components too large for a task: (finished centroids with their sums, what goes on)."""
    heavy = F.col("heavy")
    centres = large.where(heavy).groupBy(COMPONENT).agg(
        F.min_by(F.struct(F.col("depth").alias("d"), "k1", "k2", F.col("weight").alias("w")), F.col("weight")).alias("centre"))
    large = attach(large, written(centres), COMPONENT)
    large = large.withColumn("block", F.floor(F.col("depth") / BLOCK))
    # Which child of the centre a node is under is read off the path of its smallest member, once for a block of depths.
    deeper = ~heavy & (F.col("depth") > F.col("centre.d"))
    wanted = large.where(deeper).select("m", "block", *COMPONENT, "centre").distinct()
    seen = paths.select(F.col("c").alias("m"), F.col("depth").alias("at"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), "p1", "p2")
    under = wanted.withColumn("at", F.col("centre.d") + 1).join(seen, ["m", "at"]).where(
        "p1 = centre.k1 and p2 = centre.k2").select("m", "block", *COMPONENT, "at", "n1", "n2")
    placed = written(large.withColumn("deeper", deeper).join(under, ["m", "block", *COMPONENT], "left").withColumn(
        "below", F.col("deeper") & F.col("at").isNotNull()))
    is_centre = heavy & (F.col("depth") == F.col("centre.d"))
    totals = placed.where(F.col("below") | is_centre).groupBy(COMPONENT).agg(
        F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"))
    added = attach(placed.where("heavy"), written(totals), COMPONENT)
    added = added.withColumn("leaves", F.col("leaves") + F.col("t_leaf")).withColumn("tokens", F.col("tokens") + F.col("t_saved"))
    done = added.where(is_centre).select(*NAME, "leaves", "tokens")
    above = added.where(~is_centre).withColumn("weight", F.col("weight") - F.col("centre.w")).select(_STATE)
    new = dict(zip(COMPONENT, ("at", "n1", "n2")))
    rest = placed.where("not heavy").withColumns({x: F.when(F.col("below"), F.col(y)).otherwise(F.col(x)) for x, y in new.items()})
    return written(done), above.unionByName(rest.select(_STATE))


def rolled_up(nodes: DataFrame, paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Sums of ``leaf`` and ``saved`` over every node's subtree, as ``leaves`` and ``tokens``."""
    spark, zero = nodes.sparkSession, F.lit(0).cast("long")
    active = nodes.select(
        *NAME, "p1", "p2", "m", *(zero.alias(x) for x in COMPONENT), "weight", "leaf", "saved", zero.alias("leaves"), zero.alias("tokens"))
    done, small = [], []
    while True:
        active = written(active)
        # A top carries its component's whole weight, and no other node does.
        sizes = active.groupBy(COMPONENT).agg(F.count(F.lit(1)).alias("nodes"), F.max("weight").alias("total"))
        sized = written(attach(active, written(sizes), COMPONENT).withColumn("heavy", 2 * F.col("weight") > F.col("total")))
        small.append(sized.where(F.col("nodes") <= limit).select(_STATE))
        large = sized.where(F.col("nodes") > limit)
        if large.isEmpty():
            break
        finished, active = _cut(large.drop("nodes", "total"), paths)
        done.append(finished)
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    buckets = max(shuffle_partitions(spark), -(-rest.count() // limit))
    out = rest.groupBy(F.pmod(F.xxhash64(*COMPONENT), F.lit(buckets)).alias("bucket")).applyInArrow(lean(_within), _SUM_TYPES)
    for more in done:
        out = out.unionByName(more)
    return out


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves and saved_tokens
    (both over the subtree), ends_sha256. Null roles and texts are empty; turns without a number come first; turns of one
    number are ordered by the digest of role and text, repeated ones all count. Rows without a conv_id are left out. A
    conversation that is left without a turn belongs to the root alone. Only conv_id, turn, role and text are read. An
    empty table gives no node. A task holds components of at most ``limit`` nodes each.
    """
    convs, paths = rebuilt_paths(conversations)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("c").alias("m"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("size") + 1).alias("weight")).where(
        "m is not null").select(*(zero.alias(x) for x in (*NAME, "p1", "p2")), "m", "n_convs", zero.alias("chars"), "weight")
    grouped = paths.groupBy(NAME).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("c").alias("m"), F.count(F.lit(1)).alias("n_convs"),
        F.min("chars").alias("chars"), F.sum(F.col("size") - F.col("depth") + 1).alias("weight"))
    named = written(grouped.unionByName(root))
    children = named.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = named.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("m").alias("parent_conv_id"))
    nodes = attach(named, parents, ["depth", "p1", "p2"], how="left").join(children, NAME, "left")
    nodes = written(
        nodes.withColumn("n_children", F.coalesce("n_children", zero)).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    )
    sums = rolled_up(nodes, paths, limit)
    return (
        nodes.select(*NAME, "m", "parent_conv_id", "n_convs", "n_children").join(sums, NAME)
        .join(end_digests(convs, paths), NAME, "left")
        .select(
            F.col("m").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
            F.col("tokens").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    )
