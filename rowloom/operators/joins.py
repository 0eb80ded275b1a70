"""Joining, appending and comparing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import ROW, ParameterError, data_columns, present, quoted, require, require_batch
from rowloom.operators.ordering import reindex, with_row_index

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def join_on_keys(
    df: DataFrame,
    source: DataFrame,
    left_keys: list[str],
    right_keys: list[str] | None = None,
    join_how: str = "inner",
) -> DataFrame:
    """Equi-join in which NULL keys match each other.

    Keys of one name become one column; other clashing names of the source get
    ``_src``. The physical join is left to AQE: it broadcasts a side of checked
    size and splits skewed partitions.
    """
    how = _HOW.get(str(join_how).strip().lower())
    if how is None:
        raise ParameterError("join_how must be inner, left, right or outer")
    left = [str(k).strip() for k in left_keys or [] if str(k).strip()]
    right = [str(k).strip() for k in right_keys or [] if str(k).strip()] or list(left)
    if not left or len(left) != len(right):
        raise ParameterError("left_keys and right_keys must be of one length, at least 1")
    for a, b in zip(left, right):
        require(df, a, "left key")
        require(source, b, "right key")
    shared = [a for a, b in zip(left, right) if a == b]
    theirs = [c for c in data_columns(source)]
    side = source.select(*[present(source, c).alias(f"__s{i}") for i, c in enumerate(theirs)])
    at = {c: F.col(f"__s{i}") for i, c in enumerate(theirs)}
    same = reduce(lambda a, b: a & b, [present(df, a).eqNullSafe(at[b]) for a, b in zip(left, right)])
    joined = df.join(side, same, how)
    out: list[Column] = []
    for c in df.columns:
        if c in shared and how in {"right", "full"}:
            out.append(F.coalesce(quoted(c), at[c]).alias(c))
        else:
            out.append(quoted(c))
    for c in theirs:
        if c not in shared:
            out.append(at[c].alias(f"{c}_src" if c in df.columns else c))
    return joined.select(*out)


def join_in_order(
    df: DataFrame, source: DataFrame, left_keys: list[str], right_keys: list[str] | None = None, join_how: str = "inner"
) -> DataFrame:
    """:func:`join_on_keys` with a fresh row index when both sides have one.

    Rows follow the left table, and within it the source; a right join follows
    the source; an outer join follows the keys.
    """
    if ROW not in df.columns or ROW not in source.columns:
        return join_on_keys(df, source, left_keys, right_keys, join_how)
    keep = df.withColumn("__left", F.col(ROW)).drop(ROW)
    joined = join_on_keys(keep, source.withColumn("__right", F.col(ROW)), left_keys, right_keys, join_how)
    how = str(join_how).strip().lower()
    if how == "outer":
        order = [*left_keys, "__left", "__right"]
        return with_row_index(joined, order).drop("__left", "__right")
    first, then = ("__right", "__left") if how == "right" else ("__left", "__right")
    return reindex(joined.withColumnRenamed(first, ROW), [then])


def append(df: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """Union by name; absent columns are NULL and clashing types become text."""
    if not sources:
        raise ParameterError("sources are required")
    frames = [df, *sources]
    frames = [f.select(*[quoted(c) for c in data_columns(f)]) for f in frames]
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for field in f.schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType.simpleString())
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    clash = {n for n, k in kinds.items() if len(k) > 1 and not k <= numeric}
    fit = [f.withColumns({c: quoted(c).cast("string") for c in f.columns if c in clash}) if clash else f for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fit)


def append_indexed(df: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """:func:`append` of indexed tables, each numbered behind the one before."""
    start, parts = 0, []
    for f in [df, *sources]:
        size = (f.agg(F.max(ROW)).first()[0] if f.columns.count(ROW) else None)
        if size is None and ROW not in f.columns:
            raise ParameterError("every table needs a row index")
        parts.append((f, start))
        start += (size if size is not None else -1) + 1
    moved = [f.withColumn("__row", F.col(ROW) + F.lit(offset)) for f, offset in parts]
    return append(moved[0], moved[1:]).withColumnRenamed("__row", ROW)


def _row_struct(columns: list[str], prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}{i}").alias(c) for i, c in enumerate(columns)])


def _paired(before: DataFrame, after: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    old, new = data_columns(before), data_columns(after)
    a = before.select(F.col(ROW).alias("__a"), *[present(before, c).alias(f"__o{i}") for i, c in enumerate(old)])
    b = after.select(F.col(ROW).alias("__b"), *[present(after, c).alias(f"__n{i}") for i, c in enumerate(new)])
    return a.join(b, F.col("__a") == F.col("__b"), "full"), old, new


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed rows by position: ``row_index, change, before, after``."""
    require_batch(after, "diff")
    paired, old, new = _paired(before, after)
    o, n = _row_struct(old, "__o"), _row_struct(new, "__n")
    if old == new:
        equal = reduce(
            lambda x, y: x & y, [F.col(f"__o{i}").eqNullSafe(F.col(f"__n{i}")) for i in range(len(old))], F.lit(True)
        )
    else:
        equal = F.lit(False)
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~equal, "changed")
    return paired.select(
        F.coalesce("__a", "__b").alias("row_index"),
        change.alias("change"),
        F.when(F.col("__a").isNotNull(), o).alias("before"),
        F.when(F.col("__b").isNotNull(), n).alias("after"),
    ).filter("change is not null")


def schema_diff(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    old, new = data_columns(before), data_columns(after)
    return {
        "columns_before": old,
        "columns_after": new,
        "added": [c for c in new if c not in old],
        "removed": [c for c in old if c not in new],
    }


def apply_patch(df: DataFrame, changes: DataFrame, direction: str = "forward") -> DataFrame:
    """Move a table to the far side of a diff, or back."""
    if direction not in {"forward", "backward"}:
        raise ParameterError("direction must be forward or backward")
    want = "after" if direction == "forward" else "before"
    fields = changes.schema[want].dataType.names
    side = changes.select(F.col("row_index").alias("__r"), F.col(want).alias("__w"), F.lit(True).alias("__hit"))
    joined = df.join(side, F.col(ROW) == F.col("__r"), "full")
    kept = joined.filter(F.col("__hit").isNull() | F.col("__w").isNotNull())
    out = []
    for c in fields:
        old = quoted(c) if c in df.columns else F.lit(None)
        out.append(F.when(F.col("__hit").isNotNull(), F.col("__w")[c]).otherwise(old).alias(c))
    return kept.select(F.coalesce(F.col("__r"), F.col(ROW)).alias(ROW), *out)
