"""Feature preparation and train/test split."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import ROW, ParameterError, hashable, is_number, number, quoted, require, text, type_of
from rowloom.functions.quantiles import exact_quantiles
from rowloom.operators.columns import smallest_mode
from rowloom.operators.ordering import with_row_index

MAX_CATEGORIES = 10_000
LEAST_ROWS = 10


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def feature_pipeline(df: DataFrame, features: list[str], output: str = "features") -> Pipeline:
    """Median-filled numbers and one-hot texts, assembled to one vector.

    Fill values are fitted on ``df`` and become literals, so the whole fitted
    pipeline is stock MLlib and can be saved. Unseen texts encode to zeros.
    """
    numeric = [c for c in features if is_number(type_of(df, c))]
    worded = [c for c in features if c not in numeric]
    medians = exact_quantiles(df, numeric, [0.5])
    parts, encoded, stages = ["*"], [], []
    for i, c in enumerate(numeric):
        mid = medians[c][0]
        parts.append(f"coalesce(nanvl(cast({_sql(c)} as double), null), double('{0.0 if mid is None else mid!r}')) AS __num{i}")
        encoded.append(f"__num{i}")
    if worded:
        sizes = df.agg(*[F.approx_count_distinct(text(df, c)).alias(f"s{i}") for i, c in enumerate(worded)]).first()
        for i, c in enumerate(worded):
            if sizes[i] > MAX_CATEGORIES:
                raise ParameterError(f"{c!r} has over {MAX_CATEGORIES} values: leave it out or encode it first")
            mode = smallest_mode(df.select(text(df, c).alias(c)), c) or ""
            literal = str(mode).replace("\\", "\\\\").replace("'", "\\'")
            parts.append(f"coalesce(cast({_sql(c)} as string), '{literal}') AS __cat{i}")
    stages.append(SQLTransformer(statement=f"SELECT {', '.join(parts)} FROM __THIS__"))
    if worded:
        cats = [f"__cat{i}" for i in range(len(worded))]
        stages.append(
            StringIndexer(
                inputCols=cats,
                outputCols=[f"{c}_at" for c in cats],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        stages.append(OneHotEncoder(inputCols=[f"{c}_at" for c in cats], outputCols=[f"{c}_hot" for c in cats]))
        encoded += [f"{c}_hot" for c in cats]
    stages.append(VectorAssembler(inputCols=encoded, outputCol=output))
    return Pipeline(stages=stages)


def clean_target(df: DataFrame, target: str, problem: str) -> DataFrame:
    """Rows with a usable target, as double ``label`` for regression or as
    text ``__class`` for classification."""
    require(df, target)
    value = number(df, target) if problem == "regression" else text(df, target)
    name = "label" if problem == "regression" else "__class"
    held = df.withColumn(name, value).filter(F.col(name).isNotNull())
    if held.limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ParameterError(f"fewer than {LEAST_ROWS} rows have a usable target")
    return held


def split(df: DataFrame, test_size: float = 0.2, seed: int = 42, stratify: str | None = None):
    """Repeatable train and test parts of exact size, per class if asked.

    Rows are numbered in the order of a hash of their row index, or without one
    of their content; equal rows are dealt out one by one, so repeated rows fall
    on both sides. The numbered table is written once and both parts are plain
    filters of it.
    """
    if not 0 < test_size < 1:
        raise ParameterError("test_size must lie between 0 and 1")
    identity = [quoted(ROW)] if ROW in df.columns else hashable(df)
    keyed = df.withColumns({"__h": F.xxhash64(F.lit(int(seed)), *identity), "__copy": F.monotonically_increasing_id()})
    order = [quoted(stratify).asc_nulls_last()] if stratify else []
    placed = with_row_index(keyed.withColumnRenamed(ROW, "__row"), [*order, F.col("__h"), F.col("__copy")])
    placed = placed.withColumnRenamed(ROW, "__at").withColumnRenamed("__row", ROW)
    if stratify:
        sizes = placed.groupBy(quoted(stratify).alias("__c")).agg(F.min("__at").alias("__start"), F.count("*").alias("__all"))
        if sizes.limit(MAX_CATEGORIES + 1).count() > MAX_CATEGORIES:
            raise ParameterError(f"{stratify!r} has over {MAX_CATEGORIES} classes")
        placed = placed.join(F.broadcast(sizes), quoted(stratify).eqNullSafe(F.col("__c")))
        is_test = F.col("__at") - F.col("__start") < F.round(F.col("__all") * F.lit(float(test_size)))
    else:
        rows = placed.count()
        is_test = F.col("__at") < max(1, min(rows - 1, math.ceil(rows * test_size - 1e-9)))
    columns = [quoted(c) for c in df.columns]
    return placed.filter(~is_test).select(*columns), placed.filter(is_test).select(*columns)
