"""Pearson correlations of many columns in one scan, each over the rows where both values are present."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns whose products are held at once: four matrices of its square a task.
BLOCK_COLUMNS = 256


def pair_correlations(df: DataFrame, values: dict[str, Column], targets: list[str] | None = None) -> DataFrame:
    """(a, b, n, r) of every pair of the columns, in their order, or of each other column with each target.

    ``n`` counts the rows with both values; ``r`` is NULL where one of them
    does not vary there. Tasks multiply their batches as matrices, values less
    the column's mean, and hand on five sums a pair; a pair's sums are added
    up by partial aggregates.
    """
    names = list(values)
    plain = df.select(*(values[c].cast("double").alias(f"v{i}") for i, c in enumerate(names)))
    plain = plain.select(*(F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) for c in plain.columns))
    means = plain.agg(*(F.avg(c).alias(c) for c in plain.columns)).first()
    centre = np.array([means[c] or 0.0 for c in plain.columns])
    picked = [names.index(t) for t in targets] if targets is not None else None
    blocks = [range(at, min(at + BLOCK_COLUMNS, len(names))) for at in range(0, len(names), BLOCK_COLUMNS)]
    if picked is None:
        todo = [(list(x), list(y)) for i, x in enumerate(blocks) for y in blocks[i:]]
    else:
        todo = [(list(x), picked) for x in blocks]
    kinds = [("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), *((c, pa.float64()) for c in ("sa", "sb", "qa", "qb", "p"))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list = [None] * len(todo)
        for batch in batches:
            held = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1) - centre
            there = ~np.isnan(held)
            x, m = np.where(there, held, 0.0), there.astype(float)
            for k, (i, j) in enumerate(todo):
                xi, mi, xj, mj = x[:, i], m[:, i], x[:, j], m[:, j]
                part = np.stack([mi.T @ mj, xi.T @ mj, mi.T @ xj, (xi * xi).T @ mj, mi.T @ (xj * xj), xi.T @ xj])
                sums[k] = part if sums[k] is None else sums[k] + part
        for (i, j), s in zip(todo, sums):
            if s is None:
                continue
            a, b = (g.ravel() for g in np.meshgrid(i, j, indexing="ij"))
            keep = np.flatnonzero(a < b if picked is None else a != b)
            columns = [a[keep], b[keep], *(t.ravel()[keep] for t in s)]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])

    rows = plain.mapInArrow(work, "a int, b int, n bigint, sa double, sb double, qa double, qb double, p double")
    total = rows.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c, _ in kinds[2:]))
    n = F.col("n").cast("double")
    spread = lambda q, s: F.col(q) - F.col(s) * F.col(s) / n
    # Rounding leaves a little of what does not vary.
    varies = lambda q, s: F.when((n > 1) & (spread(q, s) > F.col(q) * 1e-14), spread(q, s))
    r = (F.col("p") - F.col("sa") * F.col("sb") / n) / F.sqrt(varies("qa", "sa")) / F.sqrt(varies("qb", "sb"))
    name = F.array(*(F.lit(c) for c in names))
    within = F.when((n > 1) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return total.where("n > 0").select(name[F.col("a")].alias("a"), name[F.col("b")].alias("b"), "n", within.alias("r"))
