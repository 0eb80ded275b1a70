"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(x, y) to (node, comp): every linked node with the smallest node of its component.

    Labels move along links and then along labels, which shortens chains to
    their logarithm; each round is written, so plans stay short.
    """
    both = materialize(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("low"))
        moved = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        moved = materialize(moved)
        discard(labels)
        far = moved.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        labels = materialize(moved.join(far, "comp").select("node", "was", F.least("comp", "top").alias("comp")))
        discard(moved)
        if labels.where("was <> comp").isEmpty():
            discard(both)
            return labels.select("node", "comp")
        labels = _plain(labels)


def _plain(labels: DataFrame) -> DataFrame:
    out = labels.select("node", "comp")
    out._written_to = labels._written_to
    return out
