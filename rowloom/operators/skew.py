"""Joins against a per-key table when single keys may hold much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import hashable, quoted

HOT_SHARE = 1_000
BROADCAST_ROWS = 500_000
SALTS = 1_024


def lookup(df: DataFrame, key: str, table: DataFrame, added: list[str], weight: str) -> DataFrame:
    """Left join ``table`` (one row per ``key``, with row counts in ``weight``).

    A table of checked size is broadcast. Otherwise keys holding over one
    thousandth of the rows, of which there are at most a thousand, are
    broadcast, and only the remaining rows meet by shuffle; rows with a hot or
    NULL key get a spread-out key there, so no partition collects them.
    """
    total = table.agg(F.count("*").alias("rows"), F.sum(weight).alias("all")).first()
    side = table.select(quoted(key).alias("__k"), *[quoted(c) for c in added])
    if total["rows"] <= BROADCAST_ROWS:
        return df.join(F.broadcast(side), quoted(key) == F.col("__k"), "left").drop("__k")
    is_hot = F.col(weight) > F.lit(total["all"] // HOT_SHARE)
    hot = table.filter(is_hot).select(quoted(key).alias("__h"), *[quoted(c).alias(f"__h_{c}") for c in added])
    cold = table.filter(~is_hot).select(
        quoted(key).alias("__k"), F.lit(0).alias("__s"), *[quoted(c) for c in added]
    )
    marked = df.join(F.broadcast(hot), quoted(key) == F.col("__h"), "left")
    spread = 1 + F.pmod(F.xxhash64(*hashable(df)), F.lit(SALTS)).cast("int")
    apart = F.col("__h").isNotNull() | quoted(key).isNull()
    salted = marked.withColumn("__t", F.when(apart, spread).otherwise(F.lit(0)))
    salted = salted.withColumn("__j", F.when(quoted(key).isNotNull(), quoted(key)))
    joined = salted.join(cold, (F.col("__j") == F.col("__k")) & (F.col("__t") == F.col("__s")), "left")
    picked = [F.coalesce(F.col(f"__h_{c}"), quoted(c)).alias(c) for c in added]
    return joined.select(*[quoted(c) for c in df.columns], *picked)
