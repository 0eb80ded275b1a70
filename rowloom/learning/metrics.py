"""Metrics as aggregates over a table of predictions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError, number, quoted

POINTS = 200
MAX_PLOT_POINTS = 10_000


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", features: int = 1) -> DataFrame:
    """r2, adjusted r2, mae, mse, rmse and mape (rows with actual 0 skipped)."""
    y, p = number(df, label), number(df, prediction)
    err = y - p
    sums = df.agg(
        F.count(err).cast("double").alias("n"),
        F.sum(err * err).alias("sse"),
        F.var_pop(F.when(p.isNotNull(), y)).alias("v"),
        F.avg(F.abs(err)).alias("mae"),
        (F.avg(F.when(y != 0, F.abs(err / y))) * 100).alias("mape"),
    )
    r2 = F.when(F.col("v") > 0, 1 - F.col("sse") / (F.col("v") * F.col("n")))
    n, k = F.col("n"), features
    mse = F.col("sse") / n
    return sums.select(
        r2.alias("r2"),
        F.when(n > k + 1, 1 - (1 - r2) * ((n - 1) / (n - k - 1))).alias("adjusted_r2"),
        "mae",
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        "mape",
    )


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(quoted(label).alias("label"), quoted(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and macro precision, recall and F1; a class with no rows on
    one side scores 0 there."""
    cells = confusion(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"), hit.alias("hit")),
                F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    per = sides.groupBy("c").agg(*[F.sum(x).cast("double").alias(x) for x in ("actual", "said", "hit")])
    precision = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)
    recall = F.when(F.col("actual") > 0, F.col("hit") / F.col("actual")).otherwise(0.0)
    f1 = F.when(F.col("said") + F.col("actual") > 0, 2 * F.col("hit") / (F.col("said") + F.col("actual"))).otherwise(0.0)
    return per.agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        F.avg(precision).alias("precision_macro"),
        F.avg(recall).alias("recall_macro"),
        F.avg(f1).alias("f1_macro"),
    )


def residual_points(df: DataFrame, order_by: list[str], label: str = "label", prediction: str = "prediction", points: int = POINTS):
    """The first rows with actual, predicted and residual, for a plot."""
    y, p = number(df, label), number(df, prediction)
    first = df.orderBy(*[quoted(c) for c in order_by]).limit(points)
    return first.select(y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"))


def qq_points(residuals: DataFrame) -> DataFrame:
    """Residuals of a plot (a few hundred) against normal quantiles."""
    held = residuals.select("residual").filter("residual is not null")
    if held.count() > MAX_PLOT_POINTS:
        raise ParameterError(f"a plot takes at most {MAX_PLOT_POINTS} points: use residual_points first")
    values = sorted(r["residual"] for r in held.collect())
    n = len(values)
    ddl = "theoretical double, sample double"
    if n < 3:
        return residuals.sparkSession.createDataFrame([], ddl)
    mean = sum(values) / n
    spread = (sum((v - mean) ** 2 for v in values) / n) ** 0.5 or 1.0
    rows = [(NormalDist().inv_cdf((i + 0.5) / n), (v - mean) / spread) for i, v in enumerate(values)]
    return residuals.sparkSession.createDataFrame(rows, ddl)


def compare_metrics(left: DataFrame, right: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """``metric, left, right, winner`` of two ``metric, value`` tables."""
    both = left.select("metric", F.col("value").alias("left")).join(
        right.select("metric", F.col("value").alias("right")), "metric", "full"
    )
    gap = F.col("left") - F.col("right")
    low = F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(False)
    left_wins = F.when(low, gap < 0).otherwise(gap > 0)
    winner = (
        F.when(gap.isNull(), "n/a").when(F.abs(gap) < 1e-12, "tie").when(left_wins, "left").otherwise("right")
    )
    return both.select("metric", "left", "right", winner.alias("winner"))


def long_form(metrics: DataFrame) -> DataFrame:
    """One row per metric instead of one column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), quoted(c).cast("double").alias("value")) for c in metrics.columns])
    return metrics.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def davies_bouldin(df: DataFrame, features: str = "features", cluster: str = "prediction") -> float | None:
    """Mean over clusters of the worst (spread + spread) / centre distance."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    held = df.filter(quoted(cluster) >= 0)
    centres = {
        r[cluster]: r["m"].toArray() for r in held.groupBy(cluster).agg(Summarizer.mean(quoted(features)).alias("m")).collect()
    }
    if len(centres) < 2:
        return None
    names = sorted(centres)
    table = F.create_map(*[x for c in names for x in (F.lit(c), F.array(*[F.lit(float(v)) for v in centres[c]]))])
    arr = vector_to_array(quoted(features))
    apart = F.zip_with(arr, F.element_at(table, quoted(cluster)), lambda a, b: (a - b) * (a - b))
    gap = F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x))
    spread = {r[cluster]: r["s"] for r in held.groupBy(cluster).agg(F.avg(gap).alias("s")).collect()}
    worst = []
    for a in names:
        ratios = []
        for b in names:
            if a != b:
                between = float(((centres[a] - centres[b]) ** 2).sum() ** 0.5)
                ratios.append((spread[a] + spread[b]) / between if between else float("inf"))
        worst.append(max(ratios))
    return sum(worst) / len(worst)
