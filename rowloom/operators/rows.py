"""Row operators: deduplication, sorting, filters and edits by position."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.guards import (
    NUMBER_PATTERN,
    ROW,
    ParameterError,
    data_columns,
    is_floating,
    is_time_point,
    missing,
    number,
    present,
    quoted,
    require,
    require_batch,
    squeeze,
    strip,
    text,
    text_to_bool,
    text_to_number,
    text_to_timestamp,
    timestamp,
    type_of,
)
from rowloom.functions.quantiles import exact_quantiles
from rowloom.operators.ordering import dense, reindex, require_index, with_row_index

# Texts that deduplication treats as NULL.
NULL_WORDS = ("", "null", "none", "na", "n/a", "nan")


def _plain_text(c: Column, opts: dict[str, bool]) -> Column:
    if opts["trim_whitespace"] and opts["collapse_whitespace"]:
        c = squeeze(c)
    elif opts["trim_whitespace"]:
        c = strip(c)
    elif opts["collapse_whitespace"]:
        c = squeeze(c, ends=False)
    return c if opts["case_sensitive"] else F.lower(c)


def _known(c: Column, opts: dict[str, bool]) -> Column:
    return F.when(~c.isin(*NULL_WORDS), c) if opts["normalize_null_tokens"] else c


def _canonical(c: Column, t: T.DataType, opts: dict[str, bool]) -> Column:
    """Canonical form of a value; texts at the top level are finished later."""
    if isinstance(t, T.StringType):
        return _plain_text(c, opts)
    if is_floating(t):
        return F.when(~F.isnan(c), c)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _nested(x, t.elementType, opts))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_nested(c[f.name], f.dataType, opts).alias(f.name) for f in t.fields]))
    if isinstance(t, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        return F.transform(
            entries, lambda e: F.struct(e["key"].alias("k"), _nested(e["value"], t.valueType, opts).alias("v"))
        )
    return c


def _nested(c: Column, t: T.DataType, opts: dict[str, bool]) -> Column:
    out = _canonical(c, t, opts)
    return _known(out, opts) if isinstance(t, T.StringType) else out


def with_dedup_key(
    df: DataFrame,
    into: str,
    subset: list[str],
    keep: list[Column],
    case_sensitive: bool = False,
    trim_whitespace: bool = True,
    collapse_whitespace: bool = True,
    normalize_null_tokens: bool = True,
) -> DataFrame:
    """``keep`` columns and the SHA-256 of the canonical form of ``subset``.

    The digest keeps the shuffle at 64 bytes a row however long the texts are.
    The text clean-up stands in a projection of its own, so that it runs once
    although its result is used twice.
    """
    opts = {
        "case_sensitive": case_sensitive,
        "trim_whitespace": trim_whitespace,
        "collapse_whitespace": collapse_whitespace,
        "normalize_null_tokens": normalize_null_tokens,
    }
    cleaned = df.select(
        *[k.alias(f"__p{i}") for i, k in enumerate(keep)],
        *[_canonical(quoted(c), type_of(df, c), opts).alias(f"c{i}") for i, c in enumerate(subset)],
    )
    fields = []
    for i, c in enumerate(subset):
        plain = F.col(f"c{i}")
        fields.append((_known(plain, opts) if isinstance(type_of(df, c), T.StringType) else plain).alias(f"c{i}"))
    digest = F.sha2(F.to_json(F.struct(*fields)), 256)
    return cleaned.select(*[F.col(f"__p{i}") for i in range(len(keep))], digest.alias(into))


def drop_duplicates(
    df: DataFrame,
    subset: list[str] | None = None,
    keep: str | bool = "first",
    order_by: list[str] | None = None,
    **canonical: bool,
) -> DataFrame:
    """Keep the first, the last, or only never-repeated rows per canonical key.

    ``order_by`` must identify a row (default ``_row_index``). Keepers come
    from a partial aggregate, so a key shared by a third of all rows is folded
    before the shuffle; they meet the table again on the unique order columns.
    """
    require_batch(df, "drop_duplicates")
    if subset:
        subset = [c for c in subset if c in df.columns]
        if not subset:
            raise ParameterError("no column of subset is in the table")
    order = order_by or [ROW]
    for c in order:
        require(df, c, "order column")
    token = str(keep).strip().lower() if keep is not None else "first"
    scope = subset or data_columns(df)
    keyed = with_dedup_key(df, "__key", scope, [F.struct(*[quoted(c) for c in order])], **canonical)
    groups = keyed.withColumnRenamed("__p0", "__at").groupBy("__key")
    if token == "last":
        kept = groups.agg(F.max("__at").alias("__at"))
    elif token in {"false", "none", "drop_all"}:
        kept = groups.agg(F.min("__at").alias("__at"), F.count("*").alias("n")).filter("n = 1")
    else:
        kept = groups.agg(F.min("__at").alias("__at"))
    side = kept.select(*[F.col("__at")[c].alias(f"__o{i}") for i, c in enumerate(order)])
    same = reduce(lambda a, b: a & b, [quoted(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(order)])
    return df.join(side, same, "left_semi")


def sort_rows(df: DataFrame, column: str, ascending: bool | str = True) -> DataFrame:
    """Sort by one column, missing values last either way, and renumber."""
    require(df, column)
    require_index(df, "sort_rows")
    up = str(ascending).strip().lower() not in {"false", "0", "no"}
    key = present(df, column)
    return with_row_index(df, [key.asc_nulls_last() if up else key.desc_nulls_last(), quoted(ROW).asc()])


def drop_missing_rows(df: DataFrame, subset: list[str] | None = None, how: str = "any") -> DataFrame:
    columns = [c for c in subset if c in df.columns] if isinstance(subset, list) else data_columns(df)
    if not columns:
        return df
    gaps = [missing(df, c) for c in columns]
    join = (lambda a, b: a & b) if str(how).lower() == "all" else (lambda a, b: a | b)
    return df.filter(~reduce(join, gaps))


# Accepted spellings of row conditions.
CONDITIONS = {
    "==": "eq",
    "=": "eq",
    "equals": "eq",
    "eq": "eq",
    "!=": "ne",
    "<>": "ne",
    "not_equals": "ne",
    "ne": "ne",
    ">": "gt",
    "gt": "gt",
    ">=": "gte",
    "gte": "gte",
    "<": "lt",
    "lt": "lt",
    "<=": "lte",
    "lte": "lte",
    "contains": "contains",
    "not_contains": "not_contains",
    "starts_with": "starts_with",
    "ends_with": "ends_with",
    "is_null": "is_null",
    "is_not_null": "is_not_null",
    "in": "in",
    "not_in": "not_in",
}


def as_number(value: Any) -> float | None:
    """Driver-side twin of the numeric guard for parameters."""
    import re

    if isinstance(value, bool):
        return float(value)
    if isinstance(value, (int, float)):
        return None if value != value else float(value)
    token = str(value).strip()
    return float(token) if re.match(NUMBER_PATTERN, token) else None


def row_condition(df: DataFrame, column: str, condition: str, value: Any = None, case_sensitive: bool = True) -> Column:
    """Predicate that is never NULL; each condition fixes what NULL rows do."""
    require(df, column)
    kind = CONDITIONS.get(str(condition).strip().lower())
    if kind is None:
        raise ParameterError(f"unknown condition {condition!r}")
    gap = missing(df, column)
    if kind == "is_null":
        return gap
    if kind == "is_not_null":
        return ~gap
    if value is None or value == "":
        raise ParameterError(f"condition {kind} needs a value")

    def fold(c: Column) -> Column:
        return c if case_sensitive else F.lower(c)

    def fold_value(v: Any) -> str:
        return str(v) if case_sensitive else str(v).lower()

    def settled(c: Column, when_null: bool) -> Column:
        return F.coalesce(c, F.lit(when_null))

    words = text(df, column)
    if kind in {"contains", "not_contains"}:
        hit = settled(F.contains(fold(words), F.lit(fold_value(value))), False)
        return ~hit if kind == "not_contains" else hit
    if kind == "starts_with":
        return settled(F.startswith(fold(words), F.lit(fold_value(value))), False)
    if kind == "ends_with":
        return settled(F.endswith(fold(words), F.lit(fold_value(value))), False)
    if kind in {"in", "not_in"}:
        listed = value if isinstance(value, (list, tuple)) else [p.strip() for p in str(value).split(",") if p.strip()]
        if not listed:
            raise ParameterError("in/not_in needs at least one value")
        hit = settled(fold(words).isin(*[fold_value(v) for v in listed]), False)
        return ~hit if kind == "not_in" else hit
    compare = {
        "gt": lambda a, b: a > b,
        "gte": lambda a, b: a >= b,
        "lt": lambda a, b: a < b,
        "lte": lambda a, b: a <= b,
        "eq": lambda a, b: a == b,
        "ne": lambda a, b: a == b,
    }[kind]
    limit = as_number(value)
    if limit is not None:
        hit = settled(compare(number(df, column), F.lit(limit)), False)
        return ~hit if kind == "ne" else hit
    if kind in {"eq", "ne"}:
        hit = settled(compare(fold(words), F.lit(fold_value(value))), False)
        if kind == "eq":
            return hit
        return ~hit & ~gap
    moment = text_to_timestamp(F.lit(str(value)))
    if df.sparkSession.range(1).select(moment.alias("t")).first()["t"] is None:
        raise ParameterError(f"{value!r} is neither a number nor a date")
    return settled(compare(timestamp(df, column), moment), False)


def _scan_filter(df: DataFrame, column: str, kind: str, value: Any, case_sensitive: bool) -> Column | None:
    """The rows to keep, written so that the Parquet scan can take the filter."""
    c, t = quoted(column), type_of(df, column)
    limit = as_number(value) if kind in {"eq", "ne", "gt", "gte", "lt", "lte"} else None
    if limit is not None and isinstance(t, T.IntegralType) and limit == int(limit):
        bound = F.lit(int(limit))
        if kind == "ne":
            return c == bound
        keep = {"eq": c != bound, "gt": c <= bound, "gte": c < bound, "lt": c >= bound, "lte": c > bound}[kind]
        return keep | c.isNull()
    if isinstance(t, T.StringType) and kind == "eq" and limit is None and case_sensitive:
        return (c != F.lit(str(value))) | c.isNull()
    return None


def delete_rows_condition(
    df: DataFrame, column: str, condition: str = "eq", value: Any = None, case_sensitive: bool = True
) -> DataFrame:
    hit = row_condition(df, column, condition, value, case_sensitive)
    kind = CONDITIONS[str(condition).strip().lower()]
    keep = _scan_filter(df, column, kind, value, case_sensitive)
    return df.filter(~hit if keep is None else keep)


def _positions(values: list[Any]) -> list[int]:
    kept = set()
    for v in values or []:
        token = str(v).strip()
        if token.lstrip("-").isdigit() and int(token) >= 0:
            kept.add(int(token))
    if not kept:
        raise ParameterError("no valid row position given")
    return sorted(kept)


def delete_rows(df: DataFrame, row_indices: list[int]) -> DataFrame:
    """Drop rows by position. The list comes from the caller's own parameters."""
    df, rows = dense(df, "delete_rows")
    wanted = _positions(row_indices)
    if wanted[0] >= rows:
        raise ParameterError("no valid row position given")
    return df.filter(~F.col(ROW).isin(wanted))


def duplicate_rows(df: DataFrame, row_indices: list[int]) -> DataFrame:
    """Repeat each listed row once, right behind itself, and renumber."""
    df, _ = dense(df, "duplicate_rows")
    wanted = _positions(row_indices)
    copies = F.when(F.col(ROW).isin(wanted), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return reindex(df.withColumn("__copy", F.explode(copies)), ["__copy"])


def _as_type(raw: Column, t: T.DataType) -> tuple[Column, str | None]:
    """A text parameter in a column's type, and what a bad one fails to be."""
    if isinstance(t, T.NumericType):
        return text_to_number(raw).try_cast(t), "numeric"
    if is_time_point(t):
        return text_to_timestamp(raw).cast(t), "datetime"
    if isinstance(t, T.BooleanType):
        return text_to_bool(strip(raw)), "boolean"
    return raw.try_cast(t), None


def add_row(df: DataFrame, row_data: dict[str, Any], insert_index: int | str | None = None) -> DataFrame:
    """Append a row, or insert it at a position and move later rows by one."""
    df, size = dense(df, "add_row")
    if not isinstance(row_data, dict):
        raise ParameterError("row_data must map columns to values")
    unknown = [k for k in row_data if k not in df.columns]
    if unknown:
        raise ParameterError(f"unknown columns: {', '.join(unknown)}")
    if insert_index in (None, ""):
        at = size
    else:
        token = str(insert_index).strip()
        if not token.lstrip("-").isdigit():
            raise ParameterError("insert_index must be an integer")
        at = max(0, min(int(token), size))
    given = {c: None if row_data.get(c) in (None, "") else str(row_data[c]) for c in data_columns(df)}
    typed = {c: _as_type(F.lit(v), type_of(df, c)) for c, v in given.items()}
    fresh = {c: value.cast(type_of(df, c)) for c, (value, _) in typed.items()}
    fresh[ROW] = F.lit(at).cast("long")
    one = df.sparkSession.range(1).select(*[fresh[c].alias(c) for c in df.columns])
    row = one.first()
    for c, (_, kind) in typed.items():
        if kind and given[c] is not None and row[c] is None:
            raise ParameterError(f"column {c!r} expects a {kind} value")
    moved = df.withColumn(ROW, F.when(F.col(ROW) >= at, F.col(ROW) + 1).otherwise(F.col(ROW)))
    return moved.unionByName(one)


def update_cells(df: DataFrame, updates: list[dict[str, Any]] | DataFrame) -> DataFrame:
    """Overwrite single cells given as (row_index, column, value) entries.

    A list of entries is small by nature; a table of entries joins by
    row position, one row per position after the pivot.
    """
    df, _ = dense(df, "update_cells")
    spark = df.sparkSession
    if isinstance(updates, DataFrame):
        patch = updates.select(
            F.col("row_index").cast("long").alias("row_index"), "column", F.col("value").cast("string").alias("value")
        )
        touched = [r[0] for r in patch.select("column").distinct().filter(F.col("column").isin(df.columns)).collect()]
    else:
        rows, touched = {}, []
        for u in updates:
            column, at = u.get("column"), str(u.get("row_index", "")).strip()
            if column in df.columns and at.isdigit():
                value = u.get("value")
                rows[int(at), column] = None if value is None else str(value)
                if column not in touched:
                    touched.append(column)
        if not rows:
            return df
        flat = [(i, c, v) for (i, c), v in rows.items()]
        patch = spark.createDataFrame(flat, "row_index long, column string, value string")
    wide = patch.groupBy("row_index").agg(
        *[F.max(F.when(F.col("column") == c, F.struct(F.lit(1).alias("set"), "value"))).alias(f"__u{i}")
          for i, c in enumerate(touched)]
    )
    if not isinstance(updates, DataFrame):
        wide = F.broadcast(wide)
    joined = df.join(wide, df[ROW] == wide["row_index"], "left")
    out = []
    for c in df.columns:
        if c not in touched:
            out.append(quoted(c))
            continue
        cell = F.col(f"__u{touched.index(c)}")
        fresh, _ = _as_type(cell["value"], type_of(df, c))
        out.append(F.when(cell.isNotNull(), fresh).otherwise(quoted(c)).alias(c))
    return joined.select(*out)


# Accepted spellings of the outlier rule.
OUTLIER_METHODS = {
    "iqr": "iqr",
    "box_plot": "iqr",
    "boxplot": "iqr",
    "box-plot": "iqr",
    "zscore": "zscore",
    "z_score": "zscore",
    "z-score": "zscore",
}


def outlier_bounds(
    df: DataFrame, column: str, method: str = "iqr", factor: float = 1.5, z_threshold: float = 3.0
) -> tuple[float, float]:
    require(df, column)
    require_batch(df, "outlier bounds")
    kind = OUTLIER_METHODS.get(str(method).strip().lower())
    if kind is None:
        raise ParameterError(f"unknown outlier method {method!r}")
    if kind == "zscore":
        v = number(df, column)
        row = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).first()
        if row["m"] is None:
            raise ParameterError("no numeric values")
        if not row["s"]:
            raise ParameterError("standard deviation is zero")
        if float(z_threshold) <= 0:
            raise ParameterError("z_threshold must be positive")
        return row["m"] - z_threshold * row["s"], row["m"] + z_threshold * row["s"]
    q1, q3 = exact_quantiles(df, [column], [0.25, 0.75])[column]
    if q1 is None:
        raise ParameterError("no numeric values")
    if float(factor) <= 0:
        raise ParameterError("factor must be positive")
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def remove_outliers_iqr(
    df: DataFrame,
    column: str,
    method: str = "iqr",
    mode: str = "drop",
    factor: float = 1.5,
    z_threshold: float = 3.0,
) -> DataFrame:
    """Drop or clip values outside the box-plot or z-score bounds; NULL stays."""
    low, high = outlier_bounds(df, column, method, factor, z_threshold)
    v = number(df, column)
    if str(mode).strip().lower() == "clip":
        return df.withColumn(column, F.when(v < low, low).when(v > high, high).otherwise(v))
    return df.filter(v.isNull() | v.between(low, high))


def head(df: DataFrame, rows: int) -> DataFrame:
    """The first rows in row order."""
    df, _ = dense(df, "head")
    return df.filter(F.col(ROW) < int(rows))


def top_k(df: DataFrame, by: str, k: int = 12, ties: list[str] | None = None) -> DataFrame:
    """The ``k`` greatest rows; Spark keeps only k candidates per partition."""
    require(df, by)
    return df.orderBy(quoted(by).desc_nulls_last(), *[quoted(t).asc() for t in ties or []]).limit(max(1, int(k)))
