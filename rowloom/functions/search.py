"""Binary search of a column's values in a short sorted list."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def bounds_below(df: DataFrame, value: str, bounds: list[float], into: str) -> DataFrame:
    """Add how many of the sorted ``bounds`` lie below the value.

    ``Bucketizer`` searches left-closed ranges, so it is run on negated numbers
    to get right-closed ones.
    """
    splits = [-INF, *[-b for b in reversed(bounds)], INF]
    negated = df.withColumn("__neg", -F.col(value).cast("double"))
    found = Bucketizer(splits=splits, inputCol="__neg", outputCol="__at").transform(negated)
    return found.withColumn(into, F.lit(float(len(bounds))) - F.col("__at")).drop("__neg", "__at")
