"""Nearest vectors by exact search.

Distances are matrix products inside tasks. The smaller side travels as one
matrix when it is of checked size, so the larger side is only streamed; when
both are large they meet as packed blocks. Every task returns its best ``k``
per query, so only those are shuffled. No pair list is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError, quoted, require

TOP_K = 5
THRESHOLD = 0.7
HELD_CELLS = 8_000_000  # numbers in a matrix that travels with the task
BLOCK_CELLS = 2_000_000  # numbers in one packed block
TILE_CELLS = 1 << 20  # distances worked out at once
TILE_SIDE = 1 << 11  # base rows of a tile
OUT_ROWS = 1 << 16  # hits handed out at once
DEAL_QUERIES = 1 << 10  # queries from which the streamed side is dealt out to all cores
_OUT = "query_id long, base_id long, distance double"


def distances(queries: np.ndarray, base: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        a = np.linalg.norm(queries, axis=1)[:, None]
        b = np.linalg.norm(base, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - (queries @ base.T) / (a * b)
    square = (queries**2).sum(axis=1)[:, None] + (base**2).sum(axis=1)[None, :] - 2.0 * queries @ base.T
    return np.sqrt(np.maximum(square, 0.0))


class Hits:
    """The ``k`` nearest base rows of each query among the rows met so far; ties go to the lower id.

    Distances are worked out by tiles of ``TILE_CELLS``, whatever the sizes of
    both sides; between tiles only the hits are kept.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
        self.ids, self.queries, self.k, self.metric, self.seen = ids, queries, k, metric, 0
        self.gap = np.full((len(ids), k), np.inf)
        self.base = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, base_ids: np.ndarray, base: np.ndarray) -> None:
        wide = max(1, min(len(base), TILE_SIDE))
        tall = max(1, TILE_CELLS // max(wide, base.shape[1]))
        for b in range(0, len(base), wide):
            for q in range(0, len(self.ids), tall):
                self._tile(slice(q, q + tall), base_ids[b : b + wide], base[b : b + wide])
        self.seen += len(base)

    def _tile(self, at: slice, base_ids: np.ndarray, base: np.ndarray) -> None:
        gap = distances(self.queries[at], base, self.metric)
        gap[np.isnan(gap)] = np.inf
        some = np.flatnonzero(gap.min(axis=1) <= self.gap[at, -1])
        if not len(some):
            return
        rows = some + at.start
        gap = np.hstack([self.gap[rows], gap[some]])
        limit = np.partition(gap, self.k - 1, axis=1)[:, self.k - 1]
        row, col = np.nonzero(gap <= limit[:, None])
        old = col < self.k
        found = np.where(old, self.base[rows[row], np.minimum(col, self.k - 1)], base_ids[np.maximum(col - self.k, 0)])
        near = gap[row, col]
        order = np.lexsort((found, near, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.gap[rows], self.base[rows] = near[order].reshape(-1, self.k), found[order].reshape(-1, self.k)

    def frames(self) -> Iterator[pd.DataFrame]:
        keep = min(self.k, self.seen)
        step = max(1, OUT_ROWS // max(1, keep))
        for q in range(0, len(self.ids) if keep else 0, step):
            base, gap = self.base[q : q + step, :keep], self.gap[q : q + step, :keep]
            yield pd.DataFrame({"query_id": np.repeat(self.ids[q : q + step], keep), "base_id": base.ravel(), "distance": gap.ravel()})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _held(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = df.toPandas()
    return rows["id"].to_numpy(dtype=np.int64), _matrix(rows["vec"]) if len(rows) else np.zeros((0, 1))


def _dealt(df: DataFrame) -> DataFrame:
    """A table of few partitions, whose files may hold one row group each, dealt out evenly to all cores."""
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(cores) if df.rdd.getNumPartitions() <= 2 * cores else df


def _blocks(df: DataFrame, rows_per_block: int, count: int, name: str) -> DataFrame:
    """Rows packed to matrices: one row per block, of bounded size."""
    blocks = max(1, -(-count // rows_per_block))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at in range(0, len(part), 2 * rows_per_block):
            piece = part.iloc[at : at + 2 * rows_per_block]
            ids, flat = piece["id"].tolist(), _matrix(piece["vec"]).ravel().tolist()
            out.append({f"{name}_ids": ids, f"{name}_flat": flat})
        return pd.DataFrame(out)

    placed = df.withColumn("__b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return placed.groupBy("__b").applyInPandas(pack, f"{name}_ids array<long>, {name}_flat array<double>")


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "cosine",
    held_cells: int = HELD_CELLS,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``query_id, base_id, distance`` of the ``k`` nearest, exact.

    Both tables have a numeric ``id`` and an array ``vec`` of one length; rows
    whose vector is NULL or holds a NULL take no part.
    """
    if metric not in {"cosine", "euclidean"}:
        raise ParameterError("metric must be cosine or euclidean")
    q = queries.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    b = base.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    q, b = (t.filter("vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL)") for t in (q, b))
    first = b.limit(1).collect()
    if not first:
        return queries.sparkSession.createDataFrame([], _OUT)
    width = max(1, len(first[0]["vec"]))
    most = max(1, held_cells // max(width, 2 * k))
    q_rows = q.count()
    if q_rows <= most:
        ids, held = _held(q)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hits = Hits(ids, held, k, metric)
            for part in batches:
                if len(part) and len(ids):
                    hits.meet(part["id"].to_numpy(), _matrix(part["vec"]))
            yield from hits.frames()

        found = (_dealt(b) if q_rows >= DEAL_QUERIES else b).mapInPandas(scan, _OUT)
        return _merge(found, k)
    b_rows = b.count()
    if b_rows <= most:
        ids, held = _held(b)

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if len(part):
                    hits = Hits(part["id"].to_numpy(), _matrix(part["vec"]), k, metric)
                    hits.meet(ids, held)
                    yield from hits.frames()

        return (_dealt(q) if b_rows >= DEAL_QUERIES else q).mapInPandas(probe, _OUT)
    per_block = max(1, block_cells // width)
    packed_b = _blocks(b, per_block, b_rows, "b").withColumn("no", F.monotonically_increasing_id())
    from rowloom.session import materialize

    packed_b = materialize(packed_b)
    numbers = [r["no"] for r in packed_b.select("no").collect()]
    packed_q = _blocks(q, per_block, q_rows, "q").withColumn("no", F.explode(F.lit(numbers)))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples(index=False):
                qm = np.asarray(row.q_flat, dtype=float).reshape(len(row.q_ids), -1)
                bm = np.asarray(row.b_flat, dtype=float).reshape(len(row.b_ids), -1)
                hits = Hits(np.asarray(row.q_ids), qm, k, metric)
                hits.meet(np.asarray(row.b_ids), bm)
                yield from hits.frames()

    return _merge(packed_q.join(packed_b, "no").select("q_ids", "q_flat", "b_ids", "b_flat").mapInPandas(meet, _OUT), k)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of the per-task bests: a list holds tasks x k entries at most."""
    listed = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("distance", "base_id"))).alias("all"))
    top = listed.select("query_id", F.explode(F.slice("all", 1, k)).alias("hit"))
    return top.select("query_id", F.col("hit.base_id").alias("base_id"), F.col("hit.distance").alias("distance"))


def similarity(distance: Column) -> Column:
    return F.when(distance <= 1, 1 - distance).otherwise(1 / (1 + distance))


def matches(metadata: Column, filters: dict[str, Any]) -> Column:
    out = F.lit(True)
    for key, value in filters.items():
        out = out & F.coalesce(F.element_at(metadata, F.lit(str(key))) == F.lit(str(value)), F.lit(False))
    return out


def vector_search(
    df: DataFrame,
    query: list[float],
    top_k: int = TOP_K,
    threshold: float = THRESHOLD,
    filters: dict[str, Any] | None = None,
    id_column: str = "id",
    vector_column: str = "embedding",
    metadata_column: str = "metadata",
) -> DataFrame:
    """The nearest rows with a ``score`` of at least ``threshold``.

    Filters run in the scan; then every partition offers its best rows.
    """
    require(df, vector_column)
    held = df.filter(matches(quoted(metadata_column), filters)) if filters else df
    base = held.select(quoted(id_column).alias("id"), quoted(vector_column).alias("vec"))
    one = df.sparkSession.createDataFrame([(0, [float(x) for x in query])], "id long, vec array<double>")
    hits = nearest(one, base, int(top_k)).withColumn("score", similarity(F.col("distance")))
    hits = hits.filter(F.col("score") >= float(threshold)).select(F.col("base_id").alias("__id"), "score")
    return held.join(F.broadcast(hits), quoted(id_column) == F.col("__id")).drop("__id")


def delete_by_ids(df: DataFrame, ids: list[Any] | DataFrame, id_column: str = "id") -> DataFrame:
    """Rows whose id is not listed; a table of ids goes through an anti-join."""
    if isinstance(ids, DataFrame):
        side = ids.select(F.col(ids.columns[0]).alias("__id"))
        return df.join(side, quoted(id_column) == F.col("__id"), "left_anti")
    return df.filter(~F.coalesce(quoted(id_column).isin(list(ids)), F.lit(False)))


def delete_by_metadata(df: DataFrame, filters: dict[str, Any], metadata_column: str = "metadata") -> DataFrame:
    return df.filter(~matches(quoted(metadata_column), filters)) if filters else df


def delete_by_filenames(df: DataFrame, names: list[str], metadata_column: str = "metadata") -> DataFrame:
    name = F.element_at(quoted(metadata_column), F.lit("filename"))
    return df.filter(~F.coalesce(name.isin(list(names)), F.lit(False)))
