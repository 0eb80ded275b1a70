"""Substring deduplication over bytes with per-shard suffix arrays.

A shard holds all snippets (runs of windows with a common anchor) of some
anchors; its suffix array comes from Larsson-Sadakane refinement in NumPy and
its common prefix lengths from Kasai's bound. Windows whose neighbour in the
array shares ``window`` bytes repeat. The snippets of an anchor that has too
many for one shard are dealt to several; their sorted windows are merged
afterwards, slot by slot, by binary search.

Cases: a null text has no bytes; rows of equal id and text count as two
documents and repeat each other; texts shorter than a window lose nothing. A
cut may part a character, so ``kept`` is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import repeats as R
from rowloom.session import materialize

#: Distinct snippets of one anchor, and bytes of snippets, that meet in one shard.
MEMBERS = 4096
SHARD_BYTES = 1 << 18
#: Windows that one task merges.
SLOT_ROWS = 200_000
#: Symbols (a byte plus one, or 0 for the end of a snippet) in a first key of 63 bits.
FIRST = 7


def joined(units: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all snippets, a 0 after each; each snippet's first place; bytes left at each place."""
    lengths = np.array([len(u) for u in units], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    text = np.frombuffer(b"\0".join([*units, b""]), np.uint8).astype(np.int16) + 1
    text[ends] = 0
    left = (np.repeat(ends, lengths + 1) - np.arange(len(text))).astype(np.int32)
    return text, ends - lengths, left


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by their suffixes, at least by the first ``depth`` symbols.

    Groups of suffixes that still agree are refined by the rank of the suffix
    that starts as many symbols later as they are known to agree in.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(FIRST, text.dtype)])
    key = np.zeros(n, np.int64)
    for j in range(FIRST):
        key <<= 9
        key |= padded[j : n + j]
    order = np.argsort(key, kind="stable").astype(np.int32)  # a shard is far below 2 GB
    rank, open_ = np.empty(n, np.int32), order
    place = np.arange(n, dtype=np.int32)
    sorted_key, agree = key[order], FIRST
    while True:
        new = np.ones(len(open_), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        group = place[np.maximum.accumulate(np.where(new, np.arange(len(open_), dtype=np.int32), 0))]
        rank[open_] = group
        order[place] = open_
        alone = new & np.append(new[1:], True)
        open_, place = open_[~alone], place[~alone]
        if agree >= depth or not len(open_):
            return order
        later = open_ + agree
        key = rank[open_].astype(np.int64) * (n + 1) + np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        open_, sorted_key = open_[by], key[by]
        agree *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each place in the array shares with the one before it, counted up to ``most``.

    Kasai's bound, a place shares at most one byte less than the place before
    it in the text, is applied to ever closer places of the text at once: each
    level starts from what the place to its left is known to share. The order
    of suffixes that agree in ``most`` bytes is open, so there the bound only
    holds between the same two passages.
    """
    n = len(text)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(8, text.dtype)]) - 1
    packed = np.zeros(n, np.uint64)
    for j in range(8):
        packed <<= np.uint64(8)
        packed |= (padded[j : n + j] & 255).astype(np.uint64)
    shared = np.zeros(n, np.int32)
    step = 64
    while step:
        at = np.arange(0, n, step) if step == 64 else np.arange(step, n, 2 * step)
        at = at[before[at] >= 0]
        have = np.zeros(len(at), np.int64)
        if step < 64:
            known = (shared[at - step] < most) | (before[at] - before[at - step] == step)
            have = np.where(known, np.maximum(shared[at - step] - step, 0), 0)
        limit = np.minimum(np.minimum(left[at], left[before[at]]), most)
        have = np.minimum(have, limit)
        go = np.flatnonzero(have < limit)
        while len(go):
            x, y = at[go] + have[go], before[at[go]] + have[go]
            differ = packed[x] ^ packed[y]
            # Leading bytes in common; the double's exponent names the highest bit that differs.
            top = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]
            have[go] = np.minimum(have[go] + (64 - top) // 8, limit[go])
            go = go[(differ == 0) & (have[go] < limit[go])]
        shared[at] = have
        step //= 2
    return shared[order]


def repeated(units: list, widths: np.ndarray, window: int) -> np.ndarray:
    """Mask of the windows, snippet after snippet, that occur twice in this shard."""
    text, first, left = joined(units)
    order = suffix_array(text, window)
    far = common_prefixes(text, order, left, window) >= window
    both = far.copy()
    both[:-1] |= far[1:]
    mask = np.zeros(len(text), bool)
    mask[order] = both
    return mask[np.repeat(first, widths) + np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)]


def solver(window: int):
    return lambda copies, widths, units: repeated(units, widths, window) | np.repeat(copies > 1, widths)


def search_other_shards(shards: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted arrays of (hash, hash) windows of several shards: which are also in another one."""
    marks = [np.zeros(len(s), bool) for s in shards]
    seen = np.zeros(0, shards[0].dtype)
    owner = np.zeros(0, np.int64)
    where = np.zeros(0, np.int64)
    for i, mine in enumerate(shards):
        at = np.searchsorted(seen, mine)
        hit = np.flatnonzero(at < len(seen))
        hit = hit[seen[at[hit]] == mine[hit]]
        marks[i][hit] = True
        for o in np.unique(owner[at[hit]]).tolist():
            chosen = at[hit][owner[at[hit]] == o]
            marks[o][where[chosen]] = True
        fresh = np.ones(len(mine), bool)
        fresh[hit] = False
        add = np.flatnonzero(fresh)
        into = np.searchsorted(seen, mine[add])
        seen, owner, where = (np.insert(x, into, y) for x, y in ((seen, mine[add]), (owner, np.full(len(add), i)), (where, add)))
    return marks


def merged_shards(unit: R.Unit, members: int):
    """For anchors with many snippets: suffix arrays of several shards, then binary search between them.

    Shards send each of their windows' hashes once, however often it stands
    in them; what other shards hold too is joined back to the windows.
    """
    kind = np.dtype([("a", np.int64), ("b", np.int64)])

    def local(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        widths, units = table["width"].to_numpy().astype(np.int64), table["units"].to_pylist()
        mask = repeated(units, widths, unit.window) | np.repeat(table["copies"].to_numpy() > 1, widths)
        of, rel, a, b = R.window_rows(unit, units, widths)
        at = pa.array(of)
        columns = [*(table[n].take(at) for n in ("shard", "anchor", "content")), pa.array(rel.astype(np.int32)), pa.array(mask), pa.array(a), pa.array(b)]
        return pa.Table.from_arrays(columns, ["shard", "anchor", "content", "rel", "local", "ha", "hb"])

    def merge(table: pa.Table) -> pa.Table:
        keys = np.empty(table.num_rows, kind)
        keys["a"], keys["b"] = table["ha"].to_numpy(), table["hb"].to_numpy()
        shard = table["shard"].to_numpy()
        arrays = [np.sort(keys[shard == s]) for s in np.unique(shard).tolist()]
        both = np.unique(np.concatenate([mine[mark] for mine, mark in zip(arrays, search_other_shards(arrays))]))
        return pa.table({"ha": both["a"], "hb": both["b"]})

    def split(shipped: DataFrame) -> DataFrame:
        shipped = materialize(shipped)
        size = shipped.agg(F.count("*"), F.sum("width")).first()
        shards, slots = max(1, -(-size[0] // members)), max(1, -(-(size[1] or 0) // SLOT_ROWS))
        dealt = shipped.withColumn("shard", F.pmod(F.xxhash64("content"), F.lit(shards)))
        rows = materialize(
            dealt.groupBy("shard").applyInArrow(local, "shard bigint, anchor bigint, content bigint, rel int, local boolean, ha bigint, hb bigint")
        )
        once = rows.select("shard", "ha", "hb").distinct().withColumn("slot", F.pmod("ha", F.lit(slots)))
        shared = materialize(once.groupBy("slot").applyInArrow(merge, "ha bigint, hb bigint"))
        hits = rows.where("local").unionByName(rows.where("NOT local").join(shared, ["ha", "hb"], "left_semi").select(*rows.columns))
        return R.placed(hits, unit.window)

    return split


def dedupe_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int = 32, members: int = MEMBERS
) -> DataFrame:
    """Removes every byte inside a string of ``window`` bytes that also starts elsewhere.

    Gives (id_col, n_bytes, n_removed, n_spans, kept); ``kept`` holds the
    remaining bytes.
    """
    unit = R.Unit(False, window, min(gram, window))
    rows = R.repeated_spans(R.keyed(docs, id_col, text_col), unit, solver(window), merged_shards(unit, members), members, SHARD_BYTES)
    return R.cut_documents(rows, unit).withColumnsRenamed({"id": id_col, "n_units": "n_bytes"})
