"""Boosted regression over cells in place of rows.

Trees compare a number only with its split points, at most ``maxBins`` - 1 of
them. Rows that no split point and no text parts always meet in one leaf, and
squared error needs only their number and mean label: a node's gains differ by
what the labels vary inside its cells, which no split changes. MLlib's rounds
over cells of that weight and label give the trees of its rounds over the rows,
but for rounding. The rows are read once, for an aggregate, in place of several
times a level of each tree, and are not cached.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import materialize

#: Rows that MLlib draws to place split points; it takes all of a smaller table.
DRAWN_ROWS = 10_000
#: Up to this many rows the rounds over rows cost little, so they stay and with them the draw that MLlib makes itself.
FEW_ROWS = 1_000_000
#: Numbers of more columns than this can't meet in few cells.
MOST_NUMBERS = 32
#: Rows that a cell stands for, on the average and at least.
ROWS_A_CELL = 4
BINNED = "__binned"


def split_points(values: np.ndarray, most: int) -> list[float]:
    """MLlib's rule: between all neighbouring values, or the ``most`` places that part the rows evenly."""
    found, counts = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) <= most:
        return between.tolist()
    upto, stride = np.cumsum(counts), len(values) / (most + 1)
    points, target = [], stride
    for i in range(1, len(found)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            points.append(float(between[i - 1]))
            target += stride
    return points


def _bin(column: str, points: list[float], into: str) -> str:
    """SQL for the number of split points below a value; endless ones stay, for MLlib to refuse or to route."""
    steps = " ".join(f"WHEN {column} <= double('{p!r}') THEN {float(i)}D" for i, p in enumerate(points))
    return (
        f"CASE WHEN {column} = double('-Infinity') THEN {column} {steps} "
        f"WHEN {column} < double('Infinity') THEN {float(len(points))}D ELSE {column} END AS {into}"
    )


def fit_by_cells(estimator, prepared: PipelineModel, rows: DataFrame, n: int, few: int = FEW_ROWS) -> list[Transformer] | None:
    """Stages, the fitted trees last, that follow ``prepared``; None where the rows are few or the cells too many.

    ``rows`` have the feature columns and ``label``; ``n`` is their number.
    The trees know the numbers of the bins, which one of the stages looks up.
    """
    if n <= few:
        return None
    filled, *encoders, assembler = prepared.stages
    inputs = assembler.getInputCols()
    numbers = [c for c in inputs if c.startswith("__num")]
    if not numbers or len(numbers) > MOST_NUMBERS:
        return None
    plain = filled.transform(rows)
    sought = max(estimator.getMaxBins() ** 2, DRAWN_ROWS)
    drawn = plain.select(*numbers)
    if sought < n:
        drawn = drawn.sample(fraction=sought / n, seed=estimator.getSeed())
    values = np.array(drawn.collect(), float).reshape(-1, len(numbers))
    values = np.where(np.isfinite(values), values, 0.0)
    points = {c: split_points(values[:, i], estimator.getMaxBins() - 1) for i, c in enumerate(numbers)}
    words = encoders[0].getInputCols() if encoders else []
    kinds = [len(labels) + 1 for labels in encoders[0].labelsArray] if encoders else []
    if math.prod([len(p) + 1 for p in points.values()] + kinds) * ROWS_A_CELL > n:
        return None
    bins = {c: f"__bin{i}" for i, c in enumerate(numbers)}
    looked_up = SQLTransformer(statement=f"SELECT *, {', '.join(_bin(c, points[c], b) for c, b in bins.items())} FROM __THIS__")
    packed = VectorAssembler(inputCols=[bins.get(c, c) for c in inputs], outputCol=BINNED)
    grouped = looked_up.transform(plain).groupBy(*bins.values(), *words)
    cells = materialize(grouped.agg(F.count("*").cast("double").alias("weight"), F.avg("label").alias("label")))
    size = cells.count()
    if size < 2:  # MLlib wants as many rows as a feature has classes
        return None
    cores = cells.sparkSession.sparkContext.defaultParallelism
    ready = PipelineModel(stages=[*encoders, packed]).transform(cells.repartition(cores)).select(BINNED, "label", "weight")
    # It draws the square of maxBins, so that no bin is missed; a feature keeps its few bins.
    trees = estimator.copy(
        {
            estimator.featuresCol: BINNED,
            estimator.weightCol: "weight",
            estimator.maxBins: max(estimator.getMaxBins(), math.isqrt(size) + 1),
        }
    )
    return [looked_up, packed, trees.fit(ready)]
