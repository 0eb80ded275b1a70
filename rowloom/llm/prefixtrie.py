"""Conversation prefix trie: totals over all subtrees by centroid decomposition.

A node is a distinct run of first turns. The member of smallest id names it:
(conv, depth) is a node's key, and the nodes that one conversation names form
one path downwards, from where it leaves an earlier conversation to its end.
So the parent-edge forest is a set of paths, and a conversation's way from the
root is a short list of spans on other paths (``spine``), which answers for
any node whether it lies below another one.

Totals over subtrees come from centroids. The sizes of all subtrees are known
from one aggregate over the members. A component that is too large for one
task is split in tables: its deepest node that holds more than half of it is
its centroid; the total below the centroid is added to the nodes on the path
from the centroid to the component's top, whose sizes shrink by as much; the
centroid is settled, and the parts below each of its children and the part
above it go on as components of at most half the size. Small components meet
in groups of bounded size, where the same recursion runs in memory. A chain of
any length and a node with any number of children both take as many rounds as
the logarithm of the forest.

Rows of turns are numbered through a range shuffle that also splits one large
conversation; prefixes are told apart by two exact sums of 64-bit hashes, each
of a place with its turn.

Cases: rows without conv_id belong to no conversation; null roles and texts
are empty; null turns come first; turns of equal number go by role and text;
equal rows are as many turns; conversations without turns are members of the
root alone; without conversations there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import materialize

#: Nodes of a component that one task takes whole.
COMPONENT = 20_000
#: Turns of one conversation, and ids of one node, in one bucket.
BUCKET = 1 << 12
WORDS = r"[^\x20\x09-\x0D]+"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, pos, role, text): turns of (conv_id, turn, role, text) in order, numbered from 1 within their conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", text("role"), text("text"))
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    placed = materialize(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*keys[1:]))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    offsets = sizes.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counted = placed.select("conv", "part", "role", "text", inside.alias("at")).join(offsets, ["conv", "part"])
    return materialize(counted.select("conv", (F.col("at") + F.col("before")).alias("pos"), "role", "text"))


def _turn_hash(seed: int) -> Column:
    """Of a place and its turn; lengths keep role and text apart."""
    return F.xxhash64("pos", F.char_length("role"), "role", "text", F.lit(seed)).cast("decimal(38,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, pos, words, key): ``key`` names the run of turns 1 to pos."""
    sized = turns.select("conv", "pos", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"), _turn_hash(1).alias("a"), _turn_hash(2).alias("b"))
    rows = materialize(sized.withColumn("bucket", F.expr(f"(pos - 1) div {BUCKET}")))
    upto = Window.partitionBy("conv", "bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "bucket").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    zero = F.lit(0).cast("decimal(38,0)")
    offsets = sums.select("conv", "bucket", *(F.coalesce(F.sum("s" + c).over(before), zero).cast("decimal(38,0)").alias(c + "0") for c in "ab"))
    run = rows.select("conv", "bucket", "pos", "words", *(F.sum(c).over(upto).cast("decimal(38,0)").alias(c) for c in "ab"))
    key = F.unhex(F.md5(F.concat_ws(",", *(c.cast("string") for c in (F.col("pos"), F.col("a") + F.col("a0"), F.col("b") + F.col("b0"))))))
    return run.join(offsets, ["conv", "bucket"]).select("conv", "pos", "words", key.alias("key"))


def members(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, pos, owner, words): each conversation's nodes, the root at 0; ``owner`` is the node's smallest member."""
    rows = materialize(prefixes(turns))
    names = rows.groupBy("key").agg(F.min("conv").alias("owner"))
    least = convs.agg(F.min("conv")).first()[0]
    root = convs.select("conv", *(F.lit(v).cast("long").alias(c) for c, v in (("pos", 0), ("owner", least), ("words", 0))))
    return materialize(rows.join(names, "key").select("conv", "pos", "owner", "words").unionByName(root))


def forest(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From members: nodes, the spans of each conversation's way from the root, and the last node of each."""
    spine = materialize(rows.groupBy("conv", "owner").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    is_own = F.col("owner") == F.col("conv")
    # Owners grow along the way, so the last one before a path's top is the largest other one.
    ways = spine.groupBy("conv").agg(
        F.max(F.when(is_own, F.struct("lo", "hi"))).alias("own"), F.max(F.when(~is_own, F.struct("owner", "hi"))).alias("above"), F.max(F.struct("hi", "owner")).alias("end")
    )
    ways = materialize(ways.select("conv", F.col("own.lo").alias("lo"), F.col("own.hi").alias("hi"), F.col("above.owner").alias("up"), F.col("end.hi").alias("depth"), F.col("end.owner").alias("at")))
    paths = ways.where("lo IS NOT NULL").select("conv", "lo", "hi", "up")
    sized = rows.join(paths.select("conv", (F.col("hi") - F.col("lo") + 1).alias("named")), "conv", "left")
    counted = sized.groupBy("owner", "pos").agg(F.count("*").alias("n_convs"), F.sum("named").alias("below"), F.max("words").alias("words"))
    tops = paths.where("up IS NOT NULL").groupBy(F.col("up").alias("conv"), (F.col("lo") - 1).alias("depth")).agg(F.count("*").alias("branches"))
    nodes = counted.withColumnsRenamed({"owner": "conv", "pos": "depth"}).join(paths, "conv").join(tops, ["conv", "depth"], "left")
    nodes = nodes.select(
        "conv",
        "depth",
        F.when(F.col("depth") > F.col("lo"), F.col("conv")).otherwise(F.col("up")).alias("parent"),
        "n_convs",
        (F.coalesce("branches", F.lit(0)) + (F.col("depth") < F.col("hi")).cast("long")).alias("n_children"),
        # All nodes that the members name, without those of the own path above this one.
        (F.col("below") - (F.col("depth") - F.col("lo"))).alias("size"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    return materialize(nodes), spine, ways.select("conv", "depth", "at")


#: A component is named by its top node.
COMP = ["top", "level"]


def split_components(active: DataFrame, spine: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: (settled centroids, nodes of the new components).

    Rows are (top, level, total, conv, depth, parent, size, values, their sums
    so far); ``total`` is the number of nodes of the component.
    """
    centre = active.where("2 * size > total").groupBy(*COMP).agg(F.max(F.struct("depth", "conv", "size")).alias("g"))
    centre = materialize(centre.select(*COMP, F.col("g.conv").alias("gc"), F.col("g.depth").alias("gd"), F.col("g.size").alias("gs")))
    paths = materialize(active.groupBy(*COMP, "conv").agg(F.max("depth").alias("deepest")))
    way = spine.withColumnsRenamed({"owner": "w_owner", "lo": "w_lo", "hi": "w_hi"})
    # The centroid's way to the top: on which paths, and down to which depth.
    up = centre.join(way.withColumnRenamed("conv", "gc"), "gc").where("w_lo <= gd").select(*COMP, F.col("w_owner").alias("conv"), F.least("w_hi", "gd").alias("to"))
    # Which paths pass the centroid, and by which child of it.
    low = paths.join(centre, COMP).where("deepest >= gd").join(way, "conv").where("w_lo <= gd + 1 AND w_hi >= gd")
    passed = lambda depth: F.max(F.when(F.expr(f"{depth} BETWEEN w_lo AND w_hi"), F.col("w_owner")))
    low = low.groupBy(*COMP, "conv", "gc").agg(passed("gd").alias("at"), passed("gd + 1").alias("child")).where("at = gc").select(*COMP, "conv", "child")
    marks = materialize(paths.select(*COMP, "conv").join(centre, COMP).join(up, [*COMP, "conv"], "left").join(low, [*COMP, "conv"], "left"))
    below = F.expr("(child IS NOT NULL AND depth > gd) OR (conv = gc AND depth = gd)")
    rows = materialize(active.join(marks, [*COMP, "conv"]).withColumn("below", below))
    sums = materialize(rows.where("below").groupBy(*COMP).agg(*(F.sum(v).alias("t_" + v) for v in values)))
    on_way = F.expr("coalesce(depth <= to, false)")  # the centroid included
    grown = {f"s_{v}": F.when(on_way, F.col(f"s_{v}") + F.col(f"t_{v}")).otherwise(F.col(f"s_{v}")) for v in values}
    rows = materialize(rows.join(sums, COMP).withColumns(grown).withColumn("centre", F.expr("conv = gc AND depth = gd")))
    settled = rows.where("centre").select("conv", "depth", *grown)
    moved = rows.where("NOT centre").withColumns(
        {
            "top": F.when(F.col("below"), F.col("child")).otherwise(F.col("top")),
            "level": F.when(F.col("below"), F.col("gd") + 1).otherwise(F.col("level")),
            "size": F.when(on_way, F.col("size") - F.col("gs")).otherwise(F.col("size")),
        }
    )
    return settled, materialize(moved.select(*COMP, "conv", "depth", "parent", "size", *values, *grown))


def rolled_up(rows: list[tuple]) -> list[tuple]:
    """Totals of all subtrees of some components, (parent place or -1, size, values...) a node: recursion on centroids."""
    n, width = len(rows), len(rows[0]) - 2 if rows else 0
    parent, size = [r[0] for r in rows], [r[1] for r in rows]
    out = [[0] * width for _ in rows]
    children: list[list[int]] = [[] for _ in rows]
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    stack = [i for i in range(n) if parent[i] < 0]
    edge = [True] * n  # whether the node still hangs on its parent
    while stack:
        top = stack.pop()
        total, g = size[top], top
        while True:
            heavy = next((c for c in children[g] if edge[c] and 2 * size[c] > total), -1)
            if heavy < 0:
                break
            g = heavy
        sums = [0] * width
        below = [g]
        for i in below:  # grows while it is read
            below += [c for c in children[i] if edge[c]]
            sums = [a + b for a, b in zip(sums, rows[i][2:])]
        weight, at = size[g], g
        while True:
            out[at] = [a + b for a, b in zip(out[at], sums)]
            size[at] -= weight
            if at == top:
                break
            at = parent[at]
        kept = [c for c in children[g] if edge[c]]
        for c in kept:
            edge[c] = False
        stack += kept
        if g != top:
            edge[g] = False
            stack.append(top)
        children[g] = []
    return [tuple(x) for x in out]


def _local(values: list[str]):
    def work(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_pylist() for c in table.column_names}
        # Components only touch at settled centroids, so a parent that is here is of the same one.
        place = {node: i for i, node in enumerate(zip(cols["conv"], cols["depth"]))}
        over = [place.get((p, d - 1), -1) for p, d in zip(cols["parent"], cols["depth"])]
        sums = rolled_up(list(zip(over, cols["size"], *(cols[v] for v in values))))
        done = {f"s_{v}": pa.array([s[i] + b for s, b in zip(sums, cols[f"s_{v}"])], pa.int64()) for i, v in enumerate(values)}
        return pa.table({"conv": table["conv"], "depth": table["depth"], **done})

    return work


def subtree_totals(nodes: DataFrame, spine: DataFrame, values: list[str], component: int = COMPONENT) -> DataFrame:
    """(conv, depth, s_<value>...): the values summed over each node's subtree, its own included.

    ``nodes`` holds (conv, depth, parent, size, values), ``size`` the number of
    nodes in the subtree.
    """
    zero = F.lit(0).cast("long")
    root = nodes.where("parent IS NULL").select("conv", "size").first()
    top, most = (root["conv"], root["size"]) if root else (None, 0)
    named = [F.lit(v).cast("long").alias(c) for c, v in (("top", top), ("level", 0), ("total", most))]
    active = nodes.select(*named, "conv", "depth", "parent", "size", *values, *(zero.alias(f"s_{v}") for v in values))
    small, done = [active.where(F.col("total") <= component)], []
    while most > component:
        settled, rows = split_components(active.where(F.col("total") > component), spine, values)
        active = materialize(rows.join(rows.groupBy(*COMP).agg(F.max("size").alias("total")), COMP))
        small.append(active.where(F.col("total") <= component))
        done.append(settled)
        most = active.agg(F.max("total")).first()[0] or 0
    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s)
    groups = max(1, -(-rest.count() // component))
    schema = "conv bigint, depth bigint, " + ", ".join(f"s_{v} bigint" for v in values)
    solved = rest.groupBy(F.pmod(F.xxhash64(*COMP), F.lit(groups))).applyInArrow(_local(values), schema)
    for s in done:
        solved = solved.unionByName(s)
    return solved


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of nodes at which conversations end.

    Ids are joined to strings in buckets of their values; the strings of a
    node pass its hash one after the other, without meeting in memory.
    """
    bucket = F.floor(F.col("member") / BUCKET).cast("long")
    joined = F.array_join(F.transform(F.sort_array(F.collect_set("member")), lambda x: x.cast("string")), ",")
    parts = ends.groupBy("conv", "depth", bucket.alias("bucket")).agg(joined.alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for conv, depth, ids in zip(*(batch[c].to_pylist() for c in ("conv", "depth", "ids"))):
                if node != (conv, depth):
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _digests(done)
        yield _digests([] if node is None else [(*node, state.hexdigest())])

    def _digests(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("conv", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    placed = parts.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "bucket")
    return placed.mapInArrow(work, "conv bigint, depth bigint, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, component: int = COMPONENT) -> DataFrame:
    """A row per node of the trie over (conv, pos, role, text), ``pos`` counting from 1 without gaps.

    ``convs`` (conv) lists all conversations once, also those without turns.
    Gives (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256).
    """
    nodes, spine, ends = forest(members(materialize(convs), turns))
    valued = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    totals = materialize(subtree_totals(valued, spine, ["leaf", "saved"], component))
    digests = ends_digests(ends.select(F.col("at").alias("conv"), "depth", F.col("conv").alias("member")))
    out = nodes.join(totals, ["conv", "depth"]).join(digests, ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("s_leaf").alias("n_leaves"),
        F.col("s_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def with_shared_starts(convs: DataFrame, turns: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """Turns in which each conversation c begins as conversation c - c % family does.

    It takes the first h turns of that one in place of its own first h, with
    h from 0 to ``shared`` - 1 by the CRC-32 of c.
    """
    heads = convs.select("conv", (F.col("conv") - F.col("conv") % family).alias("base"), F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(shared)).alias("h"))
    starts = turns.where(F.col("pos") < shared).withColumnRenamed("conv", "base")
    taken = materialize(heads.join(starts, "base").where("pos <= h").select("conv", "pos", "role", "text"))
    have = taken.groupBy("conv").agg(F.count("*").alias("have"))
    sizes = heads.join(have, "conv", "left").select("conv", "h", F.coalesce("have", F.lit(0)).alias("have"))
    own = turns.join(sizes, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("have")).alias("pos"), "role", "text")
    return taken.unionByName(own)
