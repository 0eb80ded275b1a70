"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles. All sets are sorted in one order, rare
shingles first, and a document is found by a prefix of that order: two sets
that are similar enough share at least ``l`` of the first
``n - need + l`` shingles of both, for every ``l``. Each document chooses its
own ``l``: a longer prefix is scanned at more cost but must match more often,
which leaves fewer pairs to verify. The costs are estimated from a sketch of
the shingles' frequencies over all documents, of fixed size, which also gives
the order; being off there costs time and changes no result.

Documents with equal sets are one node. Similar nodes are first linked to a
leader, one verified link each, and joined to components; after that only
pairs between different components are listed, by components first, so a
group of thousands of near copies never meets itself pair by pair. A pair is
verified only if its matches in the prefixes leave room for enough overlap.

Sets are identified by 64-bit hashes of their shingles and of the whole set.

Cases: documents without words have no shingles and no links; shorter ones
than a shingle count as one; rows of one id and text get one result each;
null ids never name a component unless all its ids are null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import textnum as T
from rowloom.llm.components import components
from rowloom.session import discard, materialize, scratch

PIECE = 256 << 10
#: Size of the frequency sketch: counters, as a power of two, and counters in a row.
SKETCH_BITS = 22
BLOCK = 1 << 15
#: Sketch rows that one task adds up.
FAN_IN = 64
#: Lengths that a prefix may be extended to, and cost of verifying a pair in scanned postings.
LEVELS = (1, 2, 3, 4, 6, 8, 12)
VERIFY_COST = 32.0
LEADER_ROUNDS = 1
#: Most wanted texts whose numbers are sent to all tasks to spare a shuffle of all texts.
BROADCAST_ROWS = 500_000
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted by row and hash, and where each row begins."""
    data = _UPPER[data]
    starts, ends, rows = T.word_bounds(data, offsets)
    values = T.word_values(data, starts, ends)
    words = rows[1:] - rows[:-1]
    counts = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    row = np.repeat(np.arange(len(words)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + rows[:-1][row]
    end = np.minimum(at + size, rows[1:][row])
    h = T.mix(T.Rolling(values, T.BASE_A).of(at, end) + (end - at).astype(np.uint64))
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(words) + 1))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = T.raw(batch["text"])
    for lo, hi in T.pieces(offsets, PIECE):
        yield lo, hi, *shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)


def _node(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def node_rows(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Per document (id, th, node, n), and per task the sketch of its shingles (block, part, counts)."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "th", "node", "n", "block", "part", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, id_type, part = np.zeros(1 << bits, np.uint32), None, 0
        for batch in batches:
            id_type = batch["id"].type
            for lo, hi, h, at in _sets(batch, size):
                np.add.at(sketch, _bucket(h, bits), 1)
                n = at[1:] - at[:-1]
                nodes = [_node(h[a:b]) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                part = part or next((x for x in nodes if x), 0)
                empty = [pa.nulls(hi - lo, t) for t in (pa.int32(), pa.int64(), pa.binary())]
                ids, ths = (batch[c].slice(lo, hi - lo) for c in ("id", "th"))
                yield pa.RecordBatch.from_arrays([ids, ths, pa.array(nodes, pa.int64()), pa.array(n.astype(np.int64)), *empty], names)
        if id_type is None or not sketch.any():
            return
        blocks = np.minimum(sketch, 0xFFFF).astype(np.uint16).reshape(-1, min(BLOCK, 1 << bits))
        used = np.flatnonzero(blocks.any(1))
        empty = [pa.nulls(len(used), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64())]
        counts = pa.array([blocks[i].tobytes() for i in used.tolist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used.astype(np.int32)), pa.array(np.full(len(used), part, np.int64)), counts], names)

    return docs.mapInArrow(work, f"id {kind}, th bigint, node bigint, n bigint, block int, part bigint, counts binary")


def sketch_levels(blocks: DataFrame, bits: int) -> np.ndarray:
    """Sums the tasks' sketches, few at a time, into the counters of all documents (saturated)."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(min(BLOCK, 1 << bits), np.uint32)
        for c in table["counts"].to_pylist():
            total += np.frombuffer(c, np.uint16)
        counts = np.minimum(total, 0xFFFF).astype(np.uint16).tobytes()
        return pa.Table.from_arrays([table["block"].slice(0, 1), table["part"].slice(0, 1), pa.array([counts], pa.binary())], ["block", "part", "counts"])

    rows = blocks.select("block", "part", "counts")
    parts = max(1, rows.select("part").distinct().count())
    while True:
        parts = -(-parts // FAN_IN)
        grouped = rows.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(parts))).groupBy("block", "group")
        rows = materialize(grouped.applyInArrow(add, "block int, part bigint, counts binary"))
        if parts == 1:
            break
    out = np.zeros((max(1, (1 << bits) // BLOCK), min(BLOCK, 1 << bits)), np.uint16)
    for r in rows.select("block", "counts").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint16)
    return out.ravel()


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of size n with any set similar enough."""
    return -(-n * percent // 100)


def postings(docs: DataFrame, counters: np.ndarray, size: int, percent: int) -> DataFrame:
    """Prefixes of all nodes: (token, node, place): the place in the set, and the node's ``l`` in its last byte."""
    bits = int(len(counters)).bit_length() - 1
    usual = float(counters.mean()) + 1.0
    shared = docs.sparkSession.sparkContext.broadcast(counters)
    names = ["token", "node", "place"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, _, h, at in _sets(batch, size):
                n = at[1:] - at[:-1]
                row = np.repeat(np.arange(len(n)), n)
                often = counts[_bucket(h, bits)].astype(np.float64)
                # By the counter first: a shingle that k documents share stands k higher than its counter's other ones.
                rank = counts[_bucket(h, bits)].astype(np.uint64)
                order = np.argsort(rank << np.uint64(48) | h >> np.uint64(16), kind="stable")
                order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
                often = rank[order].astype(np.float64)
                expected = 1.0 + np.maximum(often - usual, 0)
                scanned = np.concatenate([[0], np.cumsum(expected)])
                pos = np.arange(len(row)) - at[:-1][row]
                least = need(n, percent)
                base = n - least
                best, choice = np.full(len(n), np.inf), np.ones(len(n), np.int64)
                for level in LEVELS:
                    upto = np.minimum(base + level, n)
                    cost = scanned[at[:-1] + upto] - scanned[at[:-1]]
                    total = cost + VERIFY_COST * (cost - upto) / level
                    better = (total < best) & (level <= least)
                    best, choice = np.where(better, total, best), np.where(better, level, choice)
                nodes = np.zeros(len(n), np.int64)
                fresh = np.zeros(len(n), bool)
                for i in np.flatnonzero(n).tolist():
                    nodes[i] = node = _node(h[at[i] : at[i + 1]])
                    if node not in seen:
                        seen.add(node)
                        fresh[i] = True
                keep = np.flatnonzero((pos < (base + choice)[row]) & fresh[row])
                of = row[keep]
                columns = [h[order][keep].view(np.int64), nodes[of], (pos[keep] + 1) << 8 | choice[of]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return docs.select("text").mapInArrow(work, "token bigint, node bigint, place bigint")


def _long_enough(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def shared_rows(found: DataFrame, reps: DataFrame) -> DataFrame:
    """The prefix rows (token, node, n, l, pos, met) of tokens that two nodes hold; met: rows of all the node's tokens."""
    w = Window.partitionBy("token")
    rows = found.withColumns({"low": F.min("node").over(w), "top": F.max("node").over(w), "held": F.count("*").over(w)}).where("low < top")
    shared = materialize(rows.select("token", "node", "place", "held"))
    one = shared.groupBy("token", "node").agg(F.max("place").alias("place"), F.max("held").alias("held"))  # copies of a node in several tasks
    place = F.shiftright("place", 8).cast("int").alias("pos"), F.col("place").bitwiseAND(255).cast("int").alias("l")
    one = materialize(one.select("token", "node", *place, "held"))
    discard(shared)
    met = one.groupBy("node").agg(F.sum("held").alias("met")).join(reps.select("node", "n"), "node")
    out = materialize(one.join(met, "node").drop("held"))
    discard(one)
    return out


def room_for_overlap(n: tuple[str, str], level: tuple[str, str], pos: tuple[str, str], percent: int) -> str:
    """SQL: whether ``m`` matches allow enough overlap, by the rest after the last match and after the prefixes."""
    rest = " , ".join(f"ceil({x} * {percent} / 100.0) - {y}" for x, y in zip(n, level))
    need_ = f"{percent} * ({n[0]} + {n[1]})"
    return (
        f"{100 + percent} * (m + least({n[0]} - {pos[0]}, {n[1]} - {pos[1]})) >= {need_} AND {100 + percent} * (m + greatest({rest})) >= {need_}"
    )


def packed_sets(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, repeated: bool) -> DataFrame:
    """(node, hashes, is_x, is_y): the sorted shingle hashes of the nodes of some pairs, and the sides they stand on."""
    side = lambda c, x: pairs.select(F.col(c).alias("node"), F.lit(x).alias("is_x"), F.lit(not x).alias("is_y"))
    wanted = side("x", True).unionByName(side("y", False)).groupBy("node").agg(F.max("is_x").alias("is_x"), F.max("is_y").alias("is_y"))
    chosen = materialize(reps.join(wanted, "node").select("node", "id", "th", "is_x", "is_y"))
    # A few numbers a row, if ids are made of numbers: then the texts need not be shuffled.
    sized = not re.search("string|binary|array|map", reps.schema["id"].dataType.simpleString())
    small = sized and chosen.count() <= BROADCAST_ROWS
    found = F.broadcast(chosen) if small else chosen
    texts = docs.join(found, docs["id"].eqNullSafe(found["id"]) & (docs["th"] == found["th"])).select("node", "is_x", "is_y", "text")
    names = ["node", "is_x", "is_y"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, at in _sets(batch, size):
                packed = [h[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(batch[n].slice(lo, hi - lo) for n in names), pa.array(packed, pa.binary())], [*names, "hashes"])

    packed = texts.mapInArrow(sets, "node bigint, is_x boolean, is_y boolean, hashes binary")
    return materialize(packed.dropDuplicates(["node"]) if repeated else packed)


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int, repeated: bool) -> DataFrame:
    """The pairs (x, y) whose sets are similar enough, by their sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for a, b in zip(batch["hx"], batch["hy"]):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                same.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch["x"], batch["y"]], ["x", "y"]).filter(pa.array(same, pa.bool_()))

    pairs = materialize(pairs.select("x", "y").distinct())
    packed = packed_sets(pairs, docs, reps, size, repeated)
    # Side x has few nodes with many pairs: the sets of side y move to them.
    left = packed.where("is_x").select(F.col("node").alias("x"), F.col("hashes").alias("hx"))
    right = packed.where("is_y").select(F.col("node").alias("y"), F.col("hashes").alias("hy"))
    both = pairs.join(right, "y").join(left, "x").select("x", "y", "hx", "hy").mapInArrow(compare, "x bigint, y bigint")
    out = materialize(both)
    discard(packed)
    return out


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def leader_pairs(rows: DataFrame, percent: int, turn: int = 0) -> DataFrame:
    """For each node the leader of a token, in another component, that it meets most often.

    A token's leader is first its node that meets the most others, as the text that copies were made from does,
    whose copies need not be alike among themselves; in later turns it is another one, by hash.
    """
    first = F.col("met") if turn == 0 else F.xxhash64("node", F.lit(turn))
    ends = rows.groupBy("token").agg(F.max(F.struct(first.alias("by"), "node", "n", "l", "pos", "comp")).alias("a"), F.max("comp").alias("top"), F.min("comp").alias("low"))
    first = materialize(ends.where("low < top").select("token", *(F.col(f"a.{c}").alias(c + "_a") for c in ("node", "n", "l", "pos", "comp"))))
    met = rows.join(first, "token").where("node <> node_a AND comp <> comp_a").where(_long_enough("n", "n_a", percent))
    counted = met.groupBy("node_a", "node").agg(F.count("*").alias("m"), *(F.max(c).alias(c) for c in ("n", "n_a", "l", "l_a", "pos", "pos_a")))
    likely = counted.where(room_for_overlap(("n_a", "n"), ("l_a", "l"), ("pos_a", "pos"), percent))
    best = likely.groupBy("node").agg(F.max(F.struct("m", "node_a")).alias("best"))
    return best.select(F.col("best.node_a").alias("x"), F.col("node").alias("y"))


def least_overlap(n_a: str, n_b: str, percent: int) -> str:
    """SQL: the overlap that two sets of these sizes need to be similar enough."""
    return f"ceil({percent} * ({n_a} + {n_b}) / {100 + percent}.0)"


def cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components with enough matches in their prefixes and room for the overlap.

    Side a is the smaller set (on ties the smaller node). Sets of these two sizes need an overlap of ``o``. The first
    shingle that they share has at most ``n - o`` others before it on either side, so pairs are listed by shingles
    within the first ``n - o + 1`` only; as ``o`` is least for a partner of a's own size, a's rows beyond that take no
    part on side a. Then the longer prefixes decide: with ``l`` the lower of the two, they have to meet ``l`` times.
    """
    own = least_overlap("n", "n", percent)
    heads = rows.where(f"pos <= n - ceil(n * {percent} / 100.0) + 1").withColumn("leads", F.expr(f"pos <= n - {own} + 1"))
    heads = materialize(heads.select("token", "node", "n", "pos", "comp", "leads"))
    ends = heads.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("top"), F.max("leads").alias("leads"))
    mixed = materialize(ends.where("low < top AND leads").select("token"))
    listed = materialize(heads.join(mixed, "token", "left_semi"))
    discard(heads)

    def held(side: DataFrame, s: str) -> DataFrame:
        aggs = [F.min("n").alias("short" + s), F.max("n").alias("long" + s), F.min("pos").alias("pos" + s)]
        return materialize(side.groupBy("token", F.col("comp").alias("comp" + s)).agg(*aggs))

    a, b = held(listed.where("leads"), "_a"), held(listed, "_b")
    met = a.join(b, "token").where("comp_a <> comp_b AND short_a <= long_b").where(f"100 * long_a >= {percent} * short_b")
    least = least_overlap("short_a", "short_b", percent)
    met = materialize(met.where(f"pos_a <= long_a - {least} + 1 AND pos_b <= long_b - {least} + 1").select("token", "comp_a", "comp_b"))
    side = lambda f, s: f.select("token", *(F.col(c).alias(c + s) for c in ("comp", "node", "n", "pos")))
    pairs = met.join(side(listed.where("leads"), "_a"), ["token", "comp_a"]).join(side(listed, "_b"), ["token", "comp_b"])
    pairs = pairs.where("n_a < n_b OR n_a = n_b AND node_a < node_b").where(f"100 * n_a >= {percent} * n_b")
    need_ = least_overlap("n_a", "n_b", percent)
    pairs = pairs.where(f"pos_a <= n_a - {need_} + 1 AND pos_b <= n_b - {need_} + 1")
    counted = pairs.groupBy("node_a", "node_b").agg(F.count("*").alias("m"), *(F.max(c).alias(c) for c in ("n_a", "n_b", "pos_a", "pos_b")))
    likely = materialize(counted.where(f"m + least(n_a - pos_a, n_b - pos_b) >= {need_}").select("node_a", "node_b"))
    discard(listed)
    prefix = materialize(rows.groupBy("node").agg(F.collect_list("token").alias("tokens"), F.max("l").alias("l")))
    whole = lambda s: prefix.select(*(F.col(c).alias(c + s) for c in ("node", "tokens", "l")))
    both = likely.join(whole("_a"), "node_a").join(whole("_b"), "node_b")
    met = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.where(met >= F.least("l_a", "l_b")).select(F.col("node_a").alias("x"), F.col("node_b").alias("y"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, bits: int = SKETCH_BITS
) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: the smallest id that similar documents lead to."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    with scratch(docs.sparkSession) as scope:
        out = scope.keep(_components(docs, size, percent, bits))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id")
    )


def _components(docs: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """(id, n, component) of every row of (id, text, th)."""
    first = materialize(node_rows(docs, size, bits))
    members = first.where("block IS NULL").select("id", "th", "node", "n")
    counters = sketch_levels(first.where("block IS NOT NULL"), bits)
    repeated = not members.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    reps = members.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "th")).alias("at"), F.min("n").alias("n"))
    reps = materialize(reps.select("node", "at.id", "at.th", "n"))
    rows = shared_rows(postings(docs, counters, size, percent), reps)
    links, labels = None, None
    for turn in range(LEADER_ROUNDS + 1):
        marked = _labelled(rows, labels)
        pairs = leader_pairs(marked, percent, turn) if turn < LEADER_ROUNDS else cross_pairs(marked, percent)
        new = verified(pairs, docs, reps, size, percent, repeated)
        links = new if links is None else links.unionByName(new)
        labels = components(links)
    named = materialize(_labelled(members, labels).where("node IS NOT NULL").groupBy("comp").agg(F.min("id").alias("component")))
    nodes = materialize(_labelled(reps.select("node"), labels).join(named, "comp").select("node", "component"))
    return members.join(nodes, "node", "left").select("id", "n", "component")
