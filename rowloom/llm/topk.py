"""Exact top-k by inner product over integer vectors with an impact-ordered index.

The index of a shard keeps the components of its vectors in segments of equal
quantised impact, the largest first. A query adds segment after segment to its
accumulators; what is still missing of a vector is bounded by the length of
its unprocessed part times the query's length. Processing stops for a block of
queries only when the bounds prove that few vectors can be among the best;
those are scored again from all components.

Queries meet all other rows block by block: every group holds one shard of
the rows and one block of the queries and returns k rows per query.

Cases: vectors that are null or hold null or non-finite components take no
part; shorter vectors count as filled with zeros; rows with the query's id are
not its answers; a null id is the smallest and equal to none; ties go to the
smaller id; equal query rows are asked once, and unequal ones of one id each;
vectors so long that a score may reach 2**53 raise an error; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lower edges of the impact segments as shares of the shard's largest component.
EDGES = (1 / 2, 1 / 4, 1 / 8, 1 / 16, 0.0)
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
TILE_CELLS = 1 << 21


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths(), np.int64)
    out = np.zeros((len(lengths), width), np.float64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()
    return out


class ImpactIndex:
    def __init__(self, rows: np.ndarray):
        self.rows = rows
        size = np.abs(rows)
        top, above = size.max(initial=0), np.inf
        self.segments, self.missing = [], []
        for edge in EDGES:
            here = (size >= edge * top) & (size < above)
            self.segments.append(np.where(here, rows, 0))
            above = edge * top
            self.missing.append(np.sqrt((np.where(size < above, rows, 0) ** 2).sum(1)))

    def best(self, queries: np.ndarray, mine: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best rows per query but for ``mine``; -1 where there are fewer."""
        n, m = len(self.rows), len(queries)
        out, scores = np.full((m, k), -1, np.int64), np.zeros((m, k))
        acc = np.zeros((m, n))
        length = np.sqrt((queries**2).sum(1))
        for segment, missing in zip(self.segments, self.missing):
            acc += queries @ segment.T
            slack = length[:, None] * missing[None, :] * (1 + 1e-9) + 1e-6
            low, high = np.where(mine, -np.inf, acc - slack), np.where(mine, -np.inf, acc + slack)
            least = np.partition(low, max(0, n - k), 1)[:, max(0, n - k)] if n >= k else np.full(m, -np.inf)
            possible = (high >= least[:, None]) & ~mine
            if possible.sum() <= 8 * k * m:
                break
        query, place = np.nonzero(possible)
        exact = np.einsum("ij,ij->i", queries[query], self.rows[place])
        order = np.lexsort((ids[place], -exact, query))
        query, place, exact = query[order], place[order], exact[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < k
        out[query[top], rank[top]], scores[query[top], rank[top]] = place[top], exact[top]
        return out, scores


def search(base: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, id_col, score): the k best rows of ``base`` for each row of ``queries``."""
    ready = lambda df: df.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"))
    rows, asked = ready(base), ready(queries).dropDuplicates(["id", "v"])
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_ROWS))
    number = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("block", number(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("shard", number(shards))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names)
        width = max(int(np.asarray(t["v"].combine_chunks().value_lengths()).max(initial=0)) for t in (left, right))
        base, wanted = matrix(left["v"], width), matrix(right["v"], width)
        if np.sqrt((base**2).sum(1).max(initial=0)) * np.sqrt((wanted**2).sum(1).max(initial=0)) >= 2.0**53:
            raise ValueError("scores may reach 2**53: use a smaller scale")
        index, least = ImpactIndex(base), np.iinfo(np.int64).min
        (ids, own), (nameless, unknown) = ([f(t["id"]) for t in (left, right)] for f in (lambda c: pc.fill_null(c, least).to_numpy(), lambda c: pc.is_null(c).to_numpy()))
        step = max(1, TILE_CELLS // len(ids))
        parts = []
        for i in range(0, len(own), step):
            mine = (own[i : i + step, None] == ids) & ~unknown[i : i + step, None] & ~nameless
            parts.append(index.best(wanted[i : i + step], mine, ids, k))
        place, score = (np.concatenate([p[j] for p in parts]).ravel() for j in (0, 1))
        query = np.repeat(np.arange(len(own)), k)
        real = place >= 0
        place, query = place[real], query[real]
        found = [right["id"].take(pa.array(query)), right["query"].take(pa.array(query)), left["id"].take(pa.array(place)), pa.array(score[real].astype(np.int64))]
        return pa.Table.from_arrays(found, names)

    asked = asked.withColumn("query", F.xxhash64("id", "v"))
    schema = "query_id bigint, query bigint, id bigint, score bigint"
    found = rows.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(work, schema)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
