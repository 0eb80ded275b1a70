"""Nearest-neighbour prediction, exact, on top of the block vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError, quoted
from rowloom.textsearch.vectors import nearest


def knn_predict(
    train: DataFrame,
    rows: DataFrame,
    label: str,
    id_column: str,
    vector_column: str,
    problem: str = "classification",
    n_neighbors: int = 5,
    weights: str = "uniform",
) -> DataFrame:
    """``id, prediction`` from the nearest training rows by Euclid.

    Classes win by vote, ties going to the smaller class; numbers average.
    With ``weights="distance"`` a neighbour counts by inverse distance, and
    exact hits alone decide when there are any.
    """
    if weights not in {"uniform", "distance"}:
        raise ParameterError("weights must be uniform or distance")
    base = train.select(quoted(id_column).alias("id"), quoted(vector_column).alias("vec"))
    asked = rows.select(quoted(id_column).alias("id"), quoted(vector_column).alias("vec"))
    hits = nearest(asked, base, int(n_neighbors), "euclidean")
    labels = train.select(quoted(id_column).cast("long").alias("base_id"), quoted(label).alias("y"))
    known = hits.join(labels, "base_id")
    exact = F.min("distance").over(_per_query()) == 0
    if weights == "distance":
        weight = F.when(exact, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(1 / F.col("distance"))
    else:
        weight = F.lit(1.0)
    weighed = known.withColumn("w", weight)
    if problem == "regression":
        out = weighed.groupBy("query_id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))
    else:
        votes = weighed.groupBy("query_id", "y").agg(F.sum("w").alias("v"))
        out = votes.groupBy("query_id").agg(F.min_by("y", F.struct(-F.col("v"), "y")).alias("prediction"))
    return out.withColumnRenamed("query_id", "id")


def _per_query():
    from pyspark.sql import Window

    return Window.partitionBy("query_id")
