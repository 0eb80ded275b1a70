"""Run a recipe of row-wise steps, or fitted constants, on a stream.

Every such step is a projection or filter, so the same functions serve batch
and stream; steps that need the whole table or its order refuse a stream.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rowloom.functions.guards import ParameterError
from rowloom.operators.scaling import Scaler
from rowloom.plans.recipe import Recipe


def prepare_stream(df: DataFrame, recipe: Recipe, scalers: list[Scaler] | None = None) -> DataFrame:
    """A streaming table with the recipe and previously fitted scalings applied."""
    if not df.isStreaming:
        raise ParameterError("prepare_stream takes a streaming table")
    out = recipe.apply(df)
    for scaler in scalers or []:
        out = scaler.apply(out)
    return out


def write_stream(df: DataFrame, path: str, checkpoint: str, **options: Any) -> StreamingQuery:
    """Append the stream to Parquet, once each row, until no input is left."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    for key, value in options.items():
        writer = writer.option(key, value)
    return writer.trigger(availableNow=True).start(path)
