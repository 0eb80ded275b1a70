"""Date parts, date distances, cyclical features and arithmetic."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.formulas import whole
from rowloom.functions.guards import (
    ParameterError,
    number,
    place_after,
    require,
    require_batch,
    require_free,
    text_to_timestamp,
    timestamp,
)

_PARTS = {
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "week": F.weekofyear,
    "day": F.dayofmonth,
    "dayofweek": F.weekday,
    "hour": F.hour,
    "minute": F.minute,
}


def _put(df: DataFrame, source: str, name: str, value: Column) -> DataFrame:
    require_free(df, name, [source])
    return place_after(df, source, {name: value})


def extract_date_part(df: DataFrame, column: str, part: str = "year", new_name: str | None = None) -> DataFrame:
    """Weeks are ISO weeks; the day of week counts from Monday = 0."""
    require(df, column)
    kind = str(part).lower()
    if kind not in _PARTS:
        raise ParameterError(f"unknown date part {part!r}")
    return _put(df, column, str(new_name or "").strip() or f"{column}_{kind}", _PARTS[kind](timestamp(df, column)))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def date_diff_days(
    df: DataFrame,
    column: str,
    reference_column: str | None = None,
    reference_date: str | None = None,
    new_name: str | None = None,
) -> DataFrame:
    """Whole days from the reference to the column, rounded down."""
    require(df, column)
    if reference_column and reference_column in df.columns:
        other = timestamp(df, reference_column)
    else:
        if reference_date in (None, ""):
            raise ParameterError("reference_column or reference_date is required")
        other = text_to_timestamp(F.lit(str(reference_date)))
        if df.sparkSession.range(1).select(other.alias("t")).first()["t"] is None:
            raise ParameterError("reference_date is not a date")
    day = 86_400_000_000
    gap = _micros(timestamp(df, column)) - _micros(other)
    days = ((gap - F.pmod(gap, F.lit(day))) / F.lit(day)).cast("long")
    return _put(df, column, str(new_name or "").strip() or f"{column}_diff_days", days)


def datetime_floor(df: DataFrame, column: str, granularity: str = "day", new_name: str | None = None) -> DataFrame:
    """Cut to the start of the day, week (Monday), month, hour or minute."""
    require(df, column)
    unit = str(granularity).lower()
    if unit not in {"day", "week", "month", "hour", "minute"}:
        raise ParameterError(f"unknown granularity {granularity!r}")
    cut = F.date_trunc(unit, timestamp(df, column)).cast("timestamp_ntz")
    return _put(df, column, str(new_name or "").strip() or column, cut)


_CYCLES = {
    "hour_of_day": (F.hour, 24.0),
    "day_of_week": (F.weekday, 7.0),
    "day_of_month": (F.dayofmonth, 31.0),
    "month_of_year": (F.month, 12.0),
    "week_of_year": (F.weekofyear, 53.0),
}


def cyclical_encoding(
    df: DataFrame,
    column: str,
    value_source: str = "auto",
    period: float | str | None = None,
    offset: float = 0.0,
    prefix: str | None = None,
) -> DataFrame:
    """Sine and cosine of the position within a cycle.

    ``auto`` reads numbers, or hours when under half the rows are numeric but
    some are dates; deciding that takes one aggregate.
    """
    require(df, column)
    source = str(value_source).strip().lower()
    if source in _CYCLES:
        reader, default = _CYCLES[source]
        value = reader(timestamp(df, column)).cast("double")
    elif source in {"raw", "auto", "auto_numeric"}:
        default = None
        value = number(df, column)
        if source == "auto":
            require_batch(df, "automatic cycle detection")
            seen = df.agg(
                F.count("*").alias("n"), F.count(value).alias("num"), F.count(timestamp(df, column)).alias("ts")
            ).first()
            if seen["num"] < 0.5 * max(1, seen["n"]) and seen["ts"]:
                value = F.hour(timestamp(df, column)).cast("double")
    else:
        raise ParameterError(f"unknown value_source {value_source!r}")
    length = default if period in (None, "") else float(period)
    if length is None:
        raise ParameterError("period is required for raw and auto values")
    if length <= 0:
        raise ParameterError("period must be positive")
    angle = (value - F.lit(float(offset or 0.0))) * F.lit(2.0 * math.pi) / F.lit(length)
    stem = str(prefix or "").strip() or f"{column}_{'cyclical' if source == 'auto' else source}"
    for name in (f"{stem}_sin", f"{stem}_cos"):
        require_free(df, name, [column])
    return place_after(df, column, {f"{stem}_sin": F.sin(angle), f"{stem}_cos": F.cos(angle)})


def math_scalar(df: DataFrame, column: str, operator: str, value: Any, new_name: str | None = None) -> DataFrame:
    require(df, column)
    if value in (None, ""):
        raise ParameterError("value is required")
    k, v = float(value), number(df, column)
    kind = str(operator).lower()
    if kind == "divide" and k == 0:
        raise ParameterError("cannot divide by zero")
    table = {
        "add": lambda: v + k,
        "subtract": lambda: v - k,
        "multiply": lambda: v * k,
        "divide": lambda: v / F.lit(k),
        "power": lambda: F.pow(v, F.lit(k)),
    }
    if kind not in table:
        raise ParameterError(f"unknown operator {operator!r}")
    out = table[kind]()
    return _put(df, column, str(new_name or "").strip() or column, F.when(~F.isnan(out), out))


def math_unary(
    df: DataFrame, column: str, func: str = "abs", decimals: int | str | None = None, new_name: str | None = None
) -> DataFrame:
    """Rounding is half-to-even; values outside a function's domain give NULL."""
    require(df, column)
    v = number(df, column)
    digits = 0 if decimals in (None, "") else int(decimals)
    table = {
        "abs": lambda: F.abs(v),
        "sqrt": lambda: F.when(v >= 0, F.sqrt(v)),
        "log": lambda: F.when(v > 0, F.log(v)),
        "log10": lambda: F.when(v > 0, F.log10(v)),
        "exp": lambda: F.exp(v),
        "round": lambda: F.bround(v, digits),
        "floor": lambda: whole(F.floor, v),
        "ceil": lambda: whole(F.ceil, v),
        "negate": lambda: -v,
    }
    kind = str(func).lower()
    if kind not in table:
        raise ParameterError(f"unknown function {func!r}")
    return _put(df, column, str(new_name or "").strip() or column, table[kind]())


def math_between_columns(
    df: DataFrame, left_column: str, right_column: str, operator: str, new_name: str
) -> DataFrame:
    require(df, left_column, "left_column")
    require(df, right_column, "right_column")
    new_name = str(new_name or "").strip()
    if not new_name:
        raise ParameterError("new_name is required")
    require_free(df, new_name, [left_column, right_column])
    a, b = number(df, left_column), number(df, right_column)
    table = {
        "add": lambda: a + b,
        "subtract": lambda: a - b,
        "multiply": lambda: a * b,
        "divide": lambda: F.try_divide(a, b),
    }
    kind = str(operator).lower()
    if kind not in table:
        raise ParameterError(f"unknown operator {operator!r}")
    return place_after(df, left_column, {new_name: table[kind]()})
