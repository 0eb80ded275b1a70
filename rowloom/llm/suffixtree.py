"""Substring deduplication over words with prefix-partitioned suffix trees.

Suffixes are split by a prefix of variable length: it runs from the suffix's
first word to the end of its anchor, the word group of least hash among the
first ``window`` words. Suffixes of one anchor lie next to each other in the
text, so they are sent as one snippet, and many small prefixes share a task.
Where an anchor has more distinct snippets than a group may hold, the prefix
grows to the whole window, and a prefix with two suffixes is a deep node by
itself. In a group the suffix tree stands as sorted suffixes with common
prefix lengths: an internal node is a run of neighbours that share at least
its depth, and the nodes of depth ``window`` or more are the maximal repeats.

Cases: a null text has no words; rows of equal id and text count as two
documents and repeat each other; texts shorter than a window lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm import repeats as R

#: Distinct snippets of one anchor, and bytes of snippets, that meet in one group.
MEMBERS = 4096
GROUP_BYTES = 4 << 20


def word_numbers(units: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, a number of its own after each snippet, and each snippet's first place."""
    seen: dict[bytes, int] = {}
    out, first = [], []
    for u in units:
        first.append(len(out))
        out.extend(seen.setdefault(w, len(seen)) for w in u.split())
        out.append(-1)
    ids = np.array(out, np.int64)
    ends = np.flatnonzero(ids < 0)
    ids[ends] = len(seen) + np.arange(len(ends))
    return ids, np.array(first, np.int64)


class SuffixTree:
    """Sorted suffixes of word sequences with common prefix lengths, exact to ``depth`` words."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, depth: int):
        n = len(ids)
        self.levels = [(1, ids)]
        step, rank = 1, ids
        while step * 2 <= depth:
            beyond = np.full(n, n, np.int64)
            beyond[: n - step] = rank[step:] if step < n else rank[:0]
            _, rank = np.unique(rank * (n + 1) + beyond, return_inverse=True)
            step *= 2
            self.levels.append((step, rank))
        tail = np.minimum(starts + depth - step, n - 1)
        order = np.argsort(rank[starts] * (n + 1) + rank[tail], kind="stable")
        self.leaves = order
        a, b = starts[order[:-1]], starts[order[1:]]
        common = np.zeros(len(a), np.int64)
        for step, rank in reversed(self.levels):
            x, y = a + common, b + common
            inside = (x < n) & (y < n)
            common += step * (inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
        self.common = common

    def below_deep_nodes(self, depth: int) -> np.ndarray:
        """Mask of the suffixes that lie under an internal node of at least this depth."""
        deep = self.common >= depth
        under = np.zeros(len(self.leaves), bool)
        under[1:] |= deep
        under[:-1] |= deep
        out = np.zeros_like(under)
        out[self.leaves] = under
        return out


def solver(window: int):
    def solve(copies: np.ndarray, widths: np.ndarray, units: list) -> np.ndarray:
        ids, first = word_numbers(units)
        starts = np.repeat(first, widths) + np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
        tree = SuffixTree(ids, starts, window)
        # A snippet with copies is a leaf that stands for several suffixes.
        return tree.below_deep_nodes(window) | np.repeat(copies > 1, widths)

    return solve


def whole_window_prefixes(unit: R.Unit):
    """For anchors with many snippets: prefixes as long as a window, counted without a tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of, rel, a, b = R.window_rows(unit, batch["units"].to_pylist(), batch["width"].to_numpy().astype(np.int64))
            at = pa.array(of)
            columns = [*(batch[n].take(at) for n in ("anchor", "content", "copies")), pa.array(rel.astype(np.int32)), pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "copies", "rel", "ha", "hb"])

    def split(shipped: DataFrame) -> DataFrame:
        rows = shipped.mapInArrow(work, "anchor bigint, content bigint, copies bigint, rel int, ha bigint, hb bigint")
        often = rows.groupBy("ha", "hb").agg(F.sum("copies").alias("n")).where("n > 1").select("ha", "hb")
        return R.placed(rows.join(often, ["ha", "hb"], "left_semi"), unit.window)

    return split


def dedupe_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8, members: int = MEMBERS
) -> DataFrame:
    """Removes every word inside a window of ``window`` words that also starts elsewhere.

    Gives (id_col, n_words, n_removed, n_spans, kept): ``kept`` is the
    remaining words joined by one space, in UTF-8.
    """
    unit = R.Unit(True, window, min(gram, window))
    rows = R.repeated_spans(R.keyed(docs, id_col, text_col), unit, solver(window), whole_window_prefixes(unit), members, GROUP_BYTES)
    return R.cut_documents(rows, unit).withColumnsRenamed({"id": id_col, "n_units": "n_words"})
