"""Column operators: naming, casting, filling, text and encoding."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.formulas import formula
from rowloom.functions.guards import (
    ParameterError,
    data_columns,
    is_number,
    number,
    parse_bool,
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
from rowloom.functions.quantiles import exact_quantiles
from rowloom.functions.units import canonical_unit, converted, unit_category
from rowloom.operators.ordering import carried_fill, running_total
from rowloom.operators.skew import lookup

MISSING_LABEL = "__MISSING__"
MAX_DUMMIES = 1_000


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    require(df, column)
    new_name = str(new_name or "").strip()
    if not new_name:
        raise ParameterError("new_name is required")
    require_free(df, new_name, [column])
    return df.withColumnRenamed(column, new_name)


def delete_columns(df: DataFrame, columns: list[str] | str) -> DataFrame:
    listed = [columns] if isinstance(columns, str) else list(columns or [])
    valid = [c for c in listed if c in data_columns(df)]
    if not valid:
        raise ParameterError("no valid columns to delete")
    if len(set(valid)) >= len(data_columns(df)):
        raise ParameterError("cannot delete all columns")
    return df.drop(*valid)


def duplicate_column(df: DataFrame, column: str, new_name: str | None = None) -> DataFrame:
    require(df, column)
    target = str(new_name or "").strip()
    if target:
        require_free(df, target)
    else:
        target, n = f"{column}_copy", 1
        while target in df.columns:
            n += 1
            target = f"{column}_copy_{n}"
    return place_after(df, column, {target: quoted(column)})


def derive_column(df: DataFrame, new_name: str, expression: str) -> DataFrame:
    new_name = str(new_name or "").strip()
    if not new_name:
        raise ParameterError("new_name is required")
    return df.withColumn(new_name, formula(df, expression))


def cast_column(df: DataFrame, column: str, dtype: str) -> DataFrame:
    require(df, column)
    kinds = {"numeric": number, "string": text, "datetime": timestamp, "boolean": parse_bool}
    kind = str(dtype).lower()
    if kind not in kinds:
        raise ParameterError("dtype must be numeric, string, datetime or boolean")
    if kind == "numeric" and is_number(type_of(df, column)):
        return df.withColumn(column, present(df, column))
    return df.withColumn(column, kinds[kind](df, column))


def smallest_mode(df: DataFrame, column: str) -> Any:
    """Most frequent value, the smallest one on a tie."""
    counts = df.select(present(df, column).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("v")).limit(1).collect()
    return top[0]["v"] if top else None


def _fill_value(df: DataFrame, column: str, value: Any) -> Column | None:
    t = type_of(df, column)
    if isinstance(t, T.StringType):
        return F.lit(str(value))
    if isinstance(t, T.BooleanType) and isinstance(value, bool):
        return F.lit(value)
    if is_number(t):
        try:
            return F.lit(float(value)) if not isinstance(value, int) else F.lit(value)
        except (TypeError, ValueError):
            return None
    return F.lit(str(value)).try_cast(t.simpleString())


def fill_missing(df: DataFrame, column: str | None = None, strategy: str = "value", value: Any = None) -> DataFrame:
    """Fill NULLs of one column, or of every column when none is named."""
    how = str(strategy).lower()
    targets = [column] if column and column in df.columns else data_columns(df)
    if how in {"ffill", "bfill"}:
        return carried_fill(df, {c: present(df, c) for c in targets}, backward=how == "bfill")
    if how in {"mean", "median", "mode"}:
        require_batch(df, f"fill with {how}")
    if how in {"mean", "median"}:
        numeric = [c for c in targets if is_number(type_of(df, c)) or isinstance(type_of(df, c), T.StringType)]
        if how == "mean":
            row = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first() if numeric else []
            fitted = {c: row[i] for i, c in enumerate(numeric)}
        else:
            fitted = {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5]).items()}
        out = {}
        for c, v in fitted.items():
            if v is not None:
                base = present(df, c)
                t = type_of(df, c)
                out[c] = F.coalesce(base.cast("double"), F.lit(v)) if is_number(t) else F.coalesce(base, F.lit(str(v)))
        return df.withColumns(out) if out else df
    if how == "mode":
        out = {}
        for c in targets:
            v = smallest_mode(df, c)
            if v is not None:
                out[c] = F.coalesce(present(df, c), F.lit(v).cast(type_of(df, c)))
        return df.withColumns(out) if out else df
    out = {}
    for c in targets:
        fill = _fill_value(df, c, value) if value is not None else None
        if fill is not None:
            out[c] = F.coalesce(present(df, c), fill)
    return df.withColumns(out) if out else df


def replace_values(
    df: DataFrame,
    find: Any,
    replace: Any,
    column: str | None = None,
    regex: bool = False,
    case_sensitive: bool = True,
) -> DataFrame:
    """Swap whole cells equal to ``find``, or pattern matches inside texts."""
    if find is None or str(find) == "":
        raise ParameterError("find is required")
    targets = [column] if column and column in df.columns else data_columns(df)
    out = {}
    for c in targets:
        t = type_of(df, c)
        is_text = isinstance(t, T.StringType)
        if regex:
            if is_text:
                pattern = str(find) if case_sensitive else f"(?i){find}"
                fresh = str(replace).replace("$", r"\$")
                out[c] = F.regexp_replace(quoted(c), pattern, re.sub(r"\\(\d)", r"$\1", fresh))
            continue
        if is_text:
            if not isinstance(find, str):
                continue
            hit = quoted(c) == find if case_sensitive else F.lower(quoted(c)) == find.lower()
            out[c] = F.when(hit, F.lit(None if replace is None else str(replace))).otherwise(quoted(c))
        elif is_number(t) and isinstance(find, (int, float)) and not isinstance(find, bool):
            numeric = isinstance(replace, (int, float)) or replace is None
            keep = quoted(c) if numeric else quoted(c).cast("string")
            fresh = F.lit(replace) if numeric else F.lit(str(replace))
            out[c] = F.when(quoted(c) == find, fresh).otherwise(keep)
        elif isinstance(t, T.BooleanType) and isinstance(find, bool):
            out[c] = F.when(quoted(c) == find, F.lit(replace)).otherwise(quoted(c))
    return df.withColumns(out) if out else df


def split_column(
    df: DataFrame,
    column: str,
    delimiter: str = ",",
    maxsplit: int | str | None = None,
    new_columns: list[str] | None = None,
    drop_original: bool = False,
) -> DataFrame:
    """Split a text column into parts set behind it.

    The number of parts is data dependent: it costs one aggregate unless
    ``new_columns`` and ``maxsplit`` fix it, which a stream needs.
    """
    require(df, column)
    delimiter = str(delimiter)
    limit = -1 if maxsplit in (None, "", "none") else int(maxsplit)
    pattern = re.escape(delimiter) if len(delimiter) == 1 else delimiter
    base = F.coalesce(text(df, column), F.lit(""))
    parts = F.split(base, pattern, limit + 1 if limit > 0 else -1)
    names = [str(c).strip() for c in new_columns or [] if str(c).strip()]
    if df.isStreaming:
        if not names:
            raise ParameterError("splitting a stream needs new_columns")
        width = len(names)
    else:
        width = df.agg(F.max(F.size(parts)).alias("w")).first()["w"] or 0
        if width <= 1:
            raise ParameterError("the delimiter splits nothing")
        if names and len(names) != width:
            raise ParameterError(f"new_columns must name {width} parts")
    added: dict[str, Column] = {}
    for i, name in enumerate(names or [f"{column}_part_{i + 1}" for i in range(width)]):
        final, n = name, 0
        while final in df.columns or final in added:
            n += 1
            final = f"{name}_{n}"
        added[final] = F.get(parts, F.lit(i))
    out = place_after(df, column, added)
    return out.drop(column) if drop_original else out


def merge_columns(
    df: DataFrame,
    columns: list[str],
    new_name: str,
    separator: str = " ",
    skip_null: bool = True,
    drop_source: bool = False,
) -> DataFrame:
    names = [str(c).strip() for c in columns or [] if str(c).strip()]
    if len(names) < 2:
        raise ParameterError("at least two columns are needed")
    for c in names:
        require(df, c)
    new_name = str(new_name or "").strip()
    if not new_name:
        raise ParameterError("new_name is required")
    require_free(df, new_name, names)
    trimmed = [strip(text(df, c)) for c in names]
    if skip_null:
        values = [F.when(t != "", t) for t in trimmed]
    else:
        values = [F.coalesce(t, F.lit("")) for t in trimmed]
    out = df.withColumn(new_name, F.concat_ws(str(separator), *values))
    return out.drop(*[c for c in names if c != new_name]) if drop_source else out


def trim_whitespace(df: DataFrame, column: str | None = None) -> DataFrame:
    targets = [column] if column and column in df.columns else data_columns(df)
    texts = [c for c in targets if isinstance(type_of(df, c), T.StringType)]
    return df.withColumns({c: strip(quoted(c)) for c in texts}) if texts else df


def title_case(c: Column) -> Column:
    """First letter of every run of letters upper, the rest lower.

    Unlike ``initcap``, any non-letter starts a new run: ``O'Neil 3Rd``.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2)))))
    return F.array_join(cased, "")


def normalize_text_case(df: DataFrame, column: str, case: str = "lower") -> DataFrame:
    require(df, column)
    kinds = {"lower": F.lower, "upper": F.upper, "title": title_case}
    kind = str(case).lower()
    if kind not in kinds:
        raise ParameterError("case must be lower, upper or title")
    if not isinstance(type_of(df, column), T.StringType):
        return df
    return df.withColumn(column, kinds[kind](quoted(column)))


def encode_one_hot(df: DataFrame, column: str, values: list[Any] | None = None) -> DataFrame:
    """One boolean column per value and one for NULL, in place of the column.

    The value list is read from the table unless given (needed for streams);
    more than ``MAX_DUMMIES`` values is refused before anything is listed.
    """
    require(df, column)
    if values is None:
        require_batch(df, "one-hot encoding without a value list")
        held = df.select(present(df, column).alias("v")).filter("v is not null").distinct()
        found = [r["v"] for r in held.limit(MAX_DUMMIES + 1).collect()]
        if len(found) > MAX_DUMMIES:
            raise ParameterError(f"{column!r} has over {MAX_DUMMIES} values: use label encoding")
        values = sorted(found)
    base = present(df, column)
    dummies = [F.coalesce(base == F.lit(v), F.lit(False)).alias(f"{column}_{v}") for v in values]
    rest = [quoted(c) for c in df.columns if c != column]
    return df.select(*rest, *dummies, base.isNull().alias(f"{column}_nan"))


def encode_label(df: DataFrame, column: str) -> DataFrame:
    """Replace values by their rank in sorted text order, counted from 0."""
    require(df, column)
    require_batch(df, "label encoding")
    labelled = df.withColumn("__label", F.coalesce(text(df, column), F.lit(MISSING_LABEL)))
    counted = labelled.groupBy("__label").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    coded = running_total(counted, "one", ["__label"], "__code")
    joined = lookup(labelled, "__label", coded, ["__code"], "n")
    return joined.select(*[F.col("__code").cast("long").alias(c) if c == column else quoted(c) for c in df.columns])


def encode_categorical(df: DataFrame, column: str, method: str = "label") -> DataFrame:
    return encode_one_hot(df, column) if str(method).lower() == "one_hot" else encode_label(df, column)


def clip_values(df: DataFrame, column: str, min: Any = None, max: Any = None) -> DataFrame:
    require(df, column)
    low = None if min in (None, "") else float(min)
    high = None if max in (None, "") else float(max)
    if low is None and high is None:
        raise ParameterError("min or max is required")
    v = number(df, column)
    out = v
    if high is not None:
        out = F.when(out > high, high).otherwise(out)
    if low is not None:
        out = F.when(out < low, low).otherwise(out)
    return df.withColumn(column, out)


def unit_convert(
    df: DataFrame,
    column: str,
    from_unit: str,
    to_unit: str,
    category: str = "auto",
    overwrite: bool = False,
    new_name: str | None = None,
) -> DataFrame:
    require(df, column)
    source, target = canonical_unit(from_unit), canonical_unit(to_unit)
    kind = unit_category(source, target, str(category).strip().lower())
    name = str(new_name or "").strip() or (column if overwrite else f"{column}_{target}")
    require_free(df, name, [column])
    return place_after(df, column, {name: converted(number(df, column), source, target, kind)})
