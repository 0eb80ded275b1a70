"""Passages that occur more than once anywhere, found from content-defined anchors.

A window is a fixed number of consecutive units (words or bytes) of one
document. Equal windows choose equal anchors, so only one row for each anchor
is shuffled, not one for each window:

1. every document gives its runs of windows that share an anchor;
2. runs whose anchor occurs once in the corpus hold no repeated window;
3. equal runs are one snippet with a number of copies;
4. the units of each distinct snippet go, with all snippets of the anchor, to
   a group that builds a suffix structure over them and tells which windows
   repeat; anchors with too many distinct snippets for one group are split;
5. the answer is joined to all copies and cut out of the documents.

No step holds all rows of a key: copies are counted by partial aggregates,
joins on hot anchors have two plain shuffles below them, which AQE can split,
and groups are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm import textnum as T
from rowloom.session import discard, materialize, scratch

#: Bytes of texts whose windows are looked at together; a window takes about 140 bytes of arrays.
PIECE = 256 << 10
#: Documents that are cut and handed back at once.
CUT_ROWS = 500
RUN = "array<struct<a:int,b:int>>"


@dataclass(frozen=True)
class Unit:
    """How a text is cut: ``window`` units that must repeat, ``gram`` units of an anchor."""

    words: bool
    window: int
    gram: int

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the units, and the number of each row's first unit."""
        if not self.words:
            return T.byte_values(data), offsets
        starts, ends, first = T.word_bounds(data, offsets)
        return T.word_values(data, starts, ends), first


#: A group's solver: (copies, widths, units of the snippets) -> mask of repeated windows, snippet after snippet.
Solver = Callable[[np.ndarray, np.ndarray, list], np.ndarray]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and the text's hash: rows of the same id and text share all results."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])


def runs_of(docs: DataFrame, unit: Unit) -> DataFrame:
    """One row per run of windows with a common anchor."""
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.raw(batch["text"])
            for lo, hi in T.pieces(offsets, PIECE):
                values, rows = unit.split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                r = T.anchored_runs(values, rows, unit.gram, unit.window)
                at = pa.array(r["row"] + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(at), batch["th"].take(at), *(pa.array(r[n].view(np.int64)) for n in ("anchor", "content")),
                     *(pa.array(r[n].astype(np.int32)) for n in ("first", "width"))],
                    ["id", "th", "anchor", "content", "first", "width"],
                )

    return docs.mapInArrow(work, f"id {kind}, th bigint, anchor bigint, content bigint, first int, width int")


def candidates(docs: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """The runs whose anchor occurs at least twice, and the (id, th) that several rows share."""
    runs = materialize(runs_of(docs, unit))
    # Every row long enough has one run that begins with it.
    twice = materialize(runs.where("first = 0").groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select("id", "th"))
    often = materialize(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    out = materialize(runs.join(often, "anchor", "left_semi"))
    discard(runs)
    return out, twice


def distinct_snippets(found: DataFrame) -> DataFrame:
    """Each snippet once, with its copies, one place, and the number of snippets of its anchor."""
    distinct = materialize(
        found.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "first", "width")).alias("at"))
    )
    sizes = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("members")))
    out = materialize(distinct.join(sizes, "anchor"))
    discard(distinct)
    return out


def each_once(docs: DataFrame, twice: DataFrame) -> DataFrame:
    """The documents with one row for each id and text, given those that several rows share."""
    if twice.isEmpty():
        return docs
    rest = docs.join(twice, _same_row(docs, twice), "left_anti")
    return rest.unionByName(docs.join(twice, _same_row(docs, twice), "left_semi").dropDuplicates(["id", "th"]))


def with_units(docs: DataFrame, distinct: DataFrame, unit: Unit) -> DataFrame:
    """The snippets with their units, read from the documents at their places."""
    listed = distinct.groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th")).agg(
        F.collect_list(
            F.struct("anchor", "content", "copies", F.col("at.first").alias("first"), F.col("at.width").alias("width"))
        ).alias("runs")
    )
    joined = docs.alias("d").join(listed.alias("l"), _same_row(docs, listed)).select("d.text", "l.runs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch["text"], batch["runs"]
            for i in range(batch.num_rows):
                data = (texts[i].as_py() or "").encode()
                listed = runs.slice(i, 1).flatten()
                first, width = (listed.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("first", "width"))
                end = first + width - 1 + unit.window
                if unit.words:
                    starts, ends, _ = T.word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                    first, end = starts[first], ends[end - 1]
                cut = pa.array([data[a:b] for a, b in zip(first.tolist(), end.tolist())], pa.binary())
                columns = [*(listed.field(n) for n in ("anchor", "content", "copies", "width")), cut]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "copies", "width", "units"])

    return joined.mapInArrow(work, "anchor bigint, content bigint, copies bigint, width int, units binary")


def solved(shipped: DataFrame, solver: Solver, window: int, groups: int) -> DataFrame:
    """Runs the solver over groups of whole anchors."""

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        widths = table["width"].to_numpy().astype(np.int64)
        mask = solver(table["copies"].to_numpy(), widths, table["units"].to_pylist())
        return answer(table["anchor"].combine_chunks(), table["content"].combine_chunks(), widths, mask, window)

    grouped = shipped.withColumn("tree", F.pmod("anchor", F.lit(groups)))
    return grouped.groupBy("tree").applyInArrow(work, f"anchor bigint, content bigint, spans {RUN}")


def window_rows(unit: Unit, units: list, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of some snippets: the snippet's number, the place in it, and two hashes of its units."""
    data = np.frombuffer(b"".join(units), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64)
    values, rows = unit.split(data, offsets)
    of = np.repeat(np.arange(len(widths)), widths)
    rel = np.arange(len(of)) - np.repeat(np.cumsum(widths) - widths, widths)
    at = rows[:-1][of] + rel
    hashes = (T.mix(T.Rolling(values, base).of(at, at + unit.window)).view(np.int64) for base in (T.BASE_A, T.BASE_B))
    return of, rel, *hashes


def placed(hits: DataFrame, window: int) -> DataFrame:
    """Repeated windows (anchor, content, rel) as covered spans."""
    span = F.struct(F.col("rel").alias("a"), (F.col("rel") + window).alias("b"))
    return hits.groupBy("anchor", "content").agg(F.collect_list(span).alias("spans"))


def repeated_spans(docs: DataFrame, unit: Unit, solver: Solver, split: Callable[[DataFrame], DataFrame], members: int, group_bytes: int) -> DataFrame:
    """Documents (id, text) with the unit ranges of all repeated windows.

    ``members`` bounds the distinct snippets of an anchor that meet in one
    group; ``split`` answers for anchors with more, with the same result.
    """
    with scratch(docs.sparkSession) as scope:
        found, twice = candidates(docs, unit)
        distinct = distinct_snippets(found)
        size = distinct.agg(F.sum(F.col("at.width") + unit.window)).first()[0] or 0
        groups = max(1, -(-size * (7 if unit.words else 1) // group_bytes))
        small, large = distinct.where(F.col("members") <= members), distinct.where(F.col("members") > members)
        once = each_once(docs, twice)
        verdict = solved(with_units(once, small, unit), solver, unit.window, groups)
        if not large.isEmpty():
            verdict = verdict.unionByName(split(with_units(once, large, unit)))
        spans = scope.keep(covered(found, materialize(verdict)))
    return docs.alias("d").join(spans.alias("l"), _same_row(docs, spans), "left").select("d.id", "d.text", "l.spans")


def mask_runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of True inside each of the ranges between ``bounds``: range, first, one past the last."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[bounds[:-1]] = True
    before = np.zeros(len(mask), bool)
    before[1:] = mask[:-1]
    a = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.zeros(len(mask), bool)
    after[:-1] = mask[1:]
    b = np.flatnonzero(mask & (~after | edge[1:])) + 1
    of = np.searchsorted(bounds, a, "right") - 1
    return of, a - bounds[of], b - bounds[of]


def answer(anchor, content, widths: np.ndarray, mask: np.ndarray, window: int) -> pa.Table:
    """Covered unit ranges of each snippet that has a repeated window."""
    bounds = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
    of, a, b = mask_runs(mask, bounds)
    hit, counts = np.unique(of, return_counts=True)
    spans = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array((b - 1 + window).astype(np.int32))], ["a", "b"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
    at = pa.array(hit)
    return pa.Table.from_arrays([pa.array(anchor).take(at), pa.array(content).take(at), lists], ["anchor", "content", "spans"])


def covered(found: DataFrame, verdict: DataFrame) -> DataFrame:
    """Per document (id, th): the unit ranges to remove."""
    hits = found.join(verdict, ["anchor", "content"])
    spans = F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))
    each = hits.select("id", "th", spans.alias("spans"))
    return each.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: np.ndarray, n: int) -> np.ndarray:
    """Mask of the units inside any span."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, spans[:, 0], 1)
    np.add.at(steps, spans[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def cut_documents(rows: DataFrame, unit: Unit) -> DataFrame:
    """Removes the spans: units before, units removed, removed runs, remaining bytes."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, CUT_ROWS) for b in batches for at in range(0, b.num_rows, CUT_ROWS)):
            counts, removed, number, kept = [], [], [], []
            for text, spans in zip(batch["text"], batch["spans"]):
                data = (text.as_py() or "").encode()
                units = data.split() if unit.words else data
                n = len(units)
                listed = spans.values if spans.is_valid else None
                out, gone, cuts = units, 0, 0
                if listed is not None and len(listed):
                    pairs = np.stack([listed.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], 1)
                    mask = merged(pairs, n)
                    gone, cuts = int(mask.sum()), int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
                    if unit.words:
                        out = [units[i] for i in np.flatnonzero(~mask).tolist()]
                    else:
                        out = np.frombuffer(data, np.uint8)[~mask].tobytes()
                counts.append(n)
                removed.append(gone)
                number.append(cuts)
                kept.append(b" ".join(out) if unit.words else out)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(kept, pa.binary())],
                ["id", "n_units", "n_removed", "n_spans", "kept"],
            )

    return rows.mapInArrow(work, f"id {kind}, n_units bigint, n_removed bigint, n_spans bigint, kept binary")

