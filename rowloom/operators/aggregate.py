"""Group aggregates, dashboard roll-ups and whole-column statistics."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.guards import (
    ParameterError,
    number,
    place_after,
    present,
    quoted,
    require,
    require_batch,
    require_free,
    strip,
    text,
    timestamp,
    type_of,
)
from rowloom.functions.quantiles import DIRECT_ROWS, grouped_quantile

UNKNOWN = "Unknown"
GROUP_FUNCS = ("count", "nunique", "sum", "mean", "median", "min", "max", "std")
TREND_POINTS = 24
DEFAULT_TOP = 12
MAP_POINTS = 1_200


def _attach(base: DataFrame, extra: DataFrame, keys: list[str], added: str) -> DataFrame:
    """Join two tables that have one row per group; NULL keys match."""
    side = extra.select(*[quoted(k).alias(f"__g{i}") for i, k in enumerate(keys)], quoted(added))
    same = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)])
    return base.join(side, same, "left").drop(*[f"__g{i}" for i in range(len(keys))])


def group_aggregate(
    df: DataFrame,
    group_by: list[str] | str,
    aggregations: list[dict[str, str]],
    direct_rows: int | None = None,
) -> DataFrame:
    """One row per key, NULL keys kept. Entries that name an unknown column or
    function are skipped; aliases default to ``{column}_{func}``."""
    require_batch(df, "group_aggregate")
    keys = [k.strip() for k in group_by.split(",")] if isinstance(group_by, str) else [str(k).strip() for k in group_by or []]
    keys = [k for k in keys if k]
    if not keys:
        raise ParameterError("group_by is required")
    for k in keys:
        require(df, k, "group column")
    wanted: dict[str, tuple[str, str]] = {}
    for item in aggregations or []:
        column, func = str(item.get("column", "")).strip(), str(item.get("func", "")).strip().lower()
        if column in df.columns and func in GROUP_FUNCS:
            wanted[str(item.get("alias") or "").strip() or f"{column}_{func}"] = (column, func)
    if not wanted:
        raise ParameterError("no valid aggregation given")
    one_pass: list[Column] = []
    medians: list[tuple[str, str]] = []
    table = {
        "count": lambda c: F.count(present(df, c)),
        "nunique": lambda c: F.count_distinct(present(df, c)),
        "sum": lambda c: F.coalesce(F.sum(present(df, c)), F.lit(0).cast(_sum_type(df, c))),
        "mean": lambda c: F.avg(present(df, c)),
        "min": lambda c: F.min(present(df, c)),
        "max": lambda c: F.max(present(df, c)),
        "std": lambda c: F.stddev_samp(present(df, c)),
    }
    small = True
    if any(func == "median" for _, func in wanted.values()):
        limit = DIRECT_ROWS if direct_rows is None else direct_rows
        small = df.count() <= limit
    for alias, (column, func) in wanted.items():
        if func != "median":
            one_pass.append(table[func](column).alias(alias))
        elif small:
            one_pass.append(F.percentile(number(df, column), F.lit(0.5)).alias(alias))
        else:
            medians.append((alias, column))
    clean = df.withColumns({k: present(df, k) for k in keys})
    grouped = clean.groupBy(*[quoted(k) for k in keys])
    out = grouped.agg(*one_pass) if one_pass else clean.select(*[quoted(k) for k in keys]).distinct()
    for alias, column in medians:
        out = _attach(out, grouped_quantile(clean, keys, number(clean, column), 0.5, alias), keys, alias)
    return out.select(*[quoted(k) for k in keys], *[quoted(a) for a in wanted])


def _sum_type(df: DataFrame, column: str) -> str:
    t = type_of(df, column)
    return "bigint" if isinstance(t, T.IntegralType) else "double"


METRICS = ("count", "distinct_count", "sum", "mean", "min", "max", "median", "variance", "stddev")


def _finite(v: Column) -> Column:
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def _metric_value(df: DataFrame, metric: str | None) -> Column:
    return _finite(number(df, metric)) if metric else F.lit(1.0)


def metric(df: DataFrame, column: str | None, func: str) -> Column:
    """Aggregate of a roll-up; variance and stddev are those of a population."""
    v = _metric_value(df, column)
    if func == "count":
        return F.count(F.lit(1)).cast("double")
    if func == "distinct_count":
        words = strip(text(df, column)) if column else F.lit("1")
        return F.count_distinct(F.when(words != "", words)).cast("double")
    table = {
        "sum": F.sum(v),
        "mean": F.avg(v),
        "min": F.min(v),
        "max": F.max(v),
        "median": F.percentile(v, F.lit(0.5)),
        "variance": F.var_pop(v),
        "stddev": F.stddev_pop(v),
    }
    return F.coalesce(table.get(func, F.sum(v)), F.lit(0.0))


def _as_label(df: DataFrame, name: str, granularity: str = "none") -> Column:
    words = strip(text(df, name))
    if granularity == "none":
        return F.coalesce(F.when(words != "", words), F.lit(UNKNOWN))
    layout = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}.get(granularity)
    if layout is None:
        raise ParameterError(f"unknown granularity {granularity!r}")
    moment = timestamp(df, name)
    return F.coalesce(F.date_format(moment, layout), F.when(words != "", words), F.lit(UNKNOWN))


def rollup_by_dimensions(
    df: DataFrame,
    dimensions: list[str],
    metric_column: str | None = None,
    metric_function: str = "sum",
    granularity: str = "none",
    direct_rows: int | None = None,
) -> DataFrame:
    """``label, value`` over the whole table; labels join dimensions by bars."""
    require_batch(df, "a roll-up")
    dims = [d for d in dimensions or [] if d]
    if not dims:
        raise ParameterError("dimensions are required")
    for d in dims:
        require(df, d, "dimension")
    parts = [_as_label(df, d, granularity if i == 0 else "none") for i, d in enumerate(dims)]
    labelled = df.withColumn("label", F.concat_ws(" | ", *parts))
    if metric_function == "median" and metric_column:
        limit = DIRECT_ROWS if direct_rows is None else direct_rows
        if df.count() > limit:
            base = labelled.select("label").distinct()
            medians = grouped_quantile(labelled, ["label"], _metric_value(labelled, metric_column), 0.5, "value")
            return _attach(base, medians, ["label"], "value").select("label", F.coalesce("value", F.lit(0.0)).alias("value"))
    return labelled.groupBy("label").agg(metric(labelled, metric_column, metric_function).alias("value"))


def kpi(
    df: DataFrame,
    metric_column: str | None,
    metric_function: str = "sum",
    trend_dimension: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """One number for the table and, on request, its first trend points."""
    held = df
    if metric_column and metric_function != "count":
        held = df.filter(_metric_value(df, metric_column).isNotNull())
    total = held.agg(metric(held, metric_column, metric_function).alias("value"))
    if not trend_dimension:
        return total, None
    return total, timeline(df, [trend_dimension], metric_column, metric_function)


def timeline(
    df: DataFrame,
    dimensions: list[str],
    metric_column: str | None = None,
    metric_function: str = "sum",
    granularity: str = "none",
    points: int = TREND_POINTS,
) -> DataFrame:
    rolled = rollup_by_dimensions(df, dimensions, metric_column, metric_function, granularity)
    return rolled.orderBy("label").limit(points)


def chart(
    df: DataFrame,
    dimensions: list[str],
    metric_column: str | None = None,
    metric_function: str = "sum",
    top_n: int = DEFAULT_TOP,
) -> DataFrame:
    """Rows of a pie, bar, area, scatter, radar or funnel: the top labels."""
    rolled = rollup_by_dimensions(df, dimensions, metric_column, metric_function)
    return rolled.orderBy(F.desc("value"), F.asc("label")).limit(max(1, int(top_n)))


def hierarchical_rollup(
    df: DataFrame,
    dimensions: list[str],
    metric_column: str | None = None,
    metric_function: str = "sum",
    top_n: int = DEFAULT_TOP,
) -> DataFrame:
    """Tree of sizes as ``level, path, name, size``.

    A leaf holds the metric of its rows; a parent holds the sum of its
    children, whatever the metric. Rows are grouped once; each upper level
    sums the level below it. Only the greatest roots and their branches stay.
    """
    require_batch(df, "a roll-up")
    dims = [d for d in dimensions or [] if d]
    if not dims:
        raise ParameterError("dimensions are required")
    named = df.withColumns({f"__d{i}": _as_label(df, d) for i, d in enumerate(dims)})
    keys = [f"__d{i}" for i in range(len(dims))]
    if metric_function == "median" and metric_column and df.count() > DIRECT_ROWS:
        median = grouped_quantile(named, keys, _metric_value(named, metric_column), 0.5, "size")
        leaves = _attach(named.select(*keys).distinct(), median, keys, "size").select(
            *keys, F.coalesce("size", F.lit(0.0)).alias("size")
        )
    else:
        leaves = named.groupBy(*keys).agg(metric(named, metric_column, metric_function).alias("size"))
    levels = [leaves]
    for depth in range(len(keys) - 1, 0, -1):
        levels.append(levels[-1].groupBy(*keys[:depth]).agg(F.sum("size").alias("size")))
    roots = levels[-1].orderBy(F.desc("size"), F.asc(keys[0])).limit(max(1, int(top_n))).select(F.col(keys[0]).alias("__r"))
    out = None
    for depth, level in zip(range(len(keys), 0, -1), levels):
        rows = level.select(
            F.lit(depth).alias("level"),
            F.concat_ws(" | ", *keys[:depth]).alias("path"),
            F.col(keys[depth - 1]).alias("name"),
            "size",
            F.col(keys[0]).alias("__root"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out.join(F.broadcast(roots), F.col("__root") == F.col("__r"), "left_semi").drop("__root")


# Words of a working or a broken gauge.
ACTIVE_WORDS = ("active", "online", "working", "healthy", "ok", "good", "available")
DEFUNCT_WORDS = ("defunct", "inactive", "offline", "failed", "down", "bad", "dead")


def gauge_status(df: DataFrame, column: str | None) -> Column:
    if not column:
        return F.lit("")
    raw = F.lower(strip(text(df, column)))
    return (
        F.when(raw.isNull() | (raw == ""), "")
        .when(raw.isin("1", "1.0", "true"), "active")
        .when(raw.isin("0", "0.0", "false"), "defunct")
        .when(raw.isin(*ACTIVE_WORDS), "active")
        .when(raw.isin(*DEFUNCT_WORDS), "defunct")
        .when(raw.contains("active"), "active")
        .when(raw.contains("defunct") | raw.contains("fail"), "defunct")
        .otherwise(raw)
    )


def _find_axis(columns: list[str], exact: tuple[str, ...], parts: tuple[str, ...]) -> str | None:
    lowered = [(c, c.strip().lower()) for c in columns]
    for c, low in lowered:
        if low in exact:
            return c
    return next((c for c, low in lowered if any(p in low for p in parts)), None)


def map_points(
    df: DataFrame,
    lat: str | None = None,
    lon: str | None = None,
    status: str | None = None,
    order_by: list[str] | None = None,
    max_points: int = MAP_POINTS,
) -> DataFrame:
    """Valid coordinates with a normalised status, in row order."""
    lat = lat or _find_axis(df.columns, ("latitude", "lat"), ("latitude", "lat"))
    lon = lon or _find_axis(df.columns, ("longitude", "lon", "lng", "long"), ("longitude", "lon", "lng", "long"))
    require(df, lat, "latitude column")
    require(df, lon, "longitude column")
    if status is None:
        squeezed = {"".join(ch for ch in c.lower() if ch.isalnum()): c for c in df.columns}
        status = squeezed.get("gaugestatus")
    x, y = number(df, lat), number(df, lon)
    good = df.filter(x.between(-90, 90) & y.between(-180, 180))
    order = order_by or (["_row_index"] if "_row_index" in df.columns else [lat, lon])
    picked = good.orderBy(*[quoted(c) for c in order]).limit(max(1, int(max_points)))
    return picked.withColumns({"lat": x, "lng": y, "status": gauge_status(good, status)})


def _constant(df: DataFrame, column: str, fitted: Any, name: str) -> DataFrame:
    require_free(df, name, [column])
    return place_after(df, column, {name: F.lit(fitted).cast("double")})


def stats_variance(df: DataFrame, column: str, new_name: str | None = None) -> DataFrame:
    require(df, column)
    require_batch(df, "stats_variance")
    value = df.agg(F.var_samp(number(df, column)).alias("x")).first()["x"]
    return _constant(df, column, value, str(new_name or "").strip() or f"{column}_variance")


def stats_std(df: DataFrame, column: str, new_name: str | None = None) -> DataFrame:
    require(df, column)
    require_batch(df, "stats_std")
    value = df.agg(F.stddev_samp(number(df, column)).alias("x")).first()["x"]
    return _constant(df, column, value, str(new_name or "").strip() or f"{column}_std")


def stats_zscore(df: DataFrame, column: str, new_name: str | None = None) -> DataFrame:
    """(value - mean) / std; NULL throughout when there is no spread."""
    require(df, column)
    require_batch(df, "stats_zscore")
    v = number(df, column)
    row = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).first()
    name = str(new_name or "").strip() or f"{column}_zscore"
    require_free(df, name, [column])
    score = (v - F.lit(row["m"])) / F.lit(row["s"]) if row["s"] else F.lit(None).cast("double")
    return place_after(df, column, {name: score})
