"""Row order made explicit.

Spark tables have no order, so order lives in a ``_row_index`` column. Work
that follows the order is cut into index buckets of bounded size: a bucket
gets copies of its neighbours' edge rows (halo) for row frames, and a carried
value from earlier buckets for running results. No step sorts the whole table
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.functions.guards import ROW, ParameterError, quoted, require_batch
from rowloom.session import materialize

BUCKET_ROWS = 1 << 12
MAX_BUCKETS = 100_000
_POS, _PART, _BUCKET, _OFFSET = "__pos", "__part", "__bucket", "__offset"


def _ordering(order_by: list[str | Column]) -> list[Column]:
    return [quoted(k).asc_nulls_last() if isinstance(k, str) else k for k in order_by]


def with_row_index(df: DataFrame, order_by: list[str | Column], keep: list[str] | None = None) -> DataFrame:
    """Number the rows 0..n-1 along ``order_by``; ``keep`` names the columns that stay, all if not given.

    One range shuffle; hot leading keys split on the later keys. The sorted
    partitions are written once because range borders are sampled and would
    differ if evaluated again. The offsets table has one row per partition.
    """
    require_batch(df, "row numbering")
    keys = _ordering(order_by)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = [c for c in (df.columns if keep is None else keep) if c != ROW]
    stored = materialize(placed.select(*[quoted(c) for c in names], F.monotonically_increasing_id().alias(_POS)))
    part = F.shiftright(_POS, 33)
    sizes = stored.groupBy(part.alias(_PART)).agg(F.count("*").alias("n"))
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(_PART, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_OFFSET))
    inside = F.col(_POS).bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored.withColumn(_PART, part).join(F.broadcast(offsets), _PART)
    return numbered.select((F.col(_OFFSET) + inside).alias(ROW), *[quoted(c) for c in names])


def require_index(df: DataFrame, what: str) -> None:
    require_batch(df, what)
    if ROW not in df.columns:
        raise ParameterError(f"{what} follows row order: call with_row_index first")


def _span(last: int | None) -> int:
    return max(BUCKET_ROWS, ((last or 0) // MAX_BUCKETS) + 1)


def bucket_rows(df: DataFrame, at_least: int = 1, size: int | None = None) -> int:
    """Index span of a bucket: small enough for a task, few enough to list."""
    if size is None:
        size = _span(df.agg(F.max(ROW)).first()[0])
    return max(size, at_least)


def dense(df: DataFrame, what: str) -> tuple[DataFrame, int]:
    """The table with its rows numbered 0..n-1, and n.

    One aggregate over the index column tells whether rows were filtered out
    since it was made; only then they are numbered anew. Indices are unique.
    """
    require_index(df, what)
    rows, low, last = df.agg(F.count("*"), F.min(ROW), F.max(ROW)).first()
    if rows and (low != 0 or last != rows - 1):
        df = reindex(df, size=_span(last))
    return df, rows


def _bucket(size: int) -> Column:
    return F.floor(F.col(ROW) / F.lit(size)).cast("long")


def reindex(df: DataFrame, then_by: list[str] | None = None, size: int | None = None) -> DataFrame:
    """Close gaps and split ties in ``_row_index`` without a global sort.

    The bucket of a row depends on its old index alone, so both passes agree.
    """
    require_index(df, "reindex")
    span = bucket_rows(df, size=size)
    bucketed = df.withColumn(_BUCKET, _bucket(span))
    sizes = bucketed.groupBy(_BUCKET).agg(F.count("*").alias("n"))
    before = W.orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(_BUCKET, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_OFFSET))
    inside = W.partitionBy(_BUCKET).orderBy(ROW, *(then_by or []))
    out = bucketed.join(F.broadcast(offsets), _BUCKET).withColumn(_POS, F.row_number().over(inside) - 1)
    keep = [quoted(c) for c in df.columns if c != ROW and c not in (then_by or [])]
    return out.select((F.col(_OFFSET) + F.col(_POS)).alias(ROW), *keep)


def over_row_frames(
    df: DataFrame,
    before: int,
    after: int,
    build,
    size: int | None = None,
) -> DataFrame:
    """Run ``build(df, window)`` with every frame of up to ``before`` rows
    behind and ``after`` rows ahead complete inside its bucket."""
    df, rows = dense(df, "row frames")
    span = max(size or _span(rows), before, after, 1)
    at = F.pmod(F.col(ROW), F.lit(span))
    home = _bucket(span)
    copies = F.array(
        home,
        F.when(at >= span - before, home + 1) if before else F.lit(None).cast("long"),
        F.when(at < after, home - 1) if after else F.lit(None).cast("long"),
    )
    spread = df.withColumn(_BUCKET, F.explode(F.array_compact(copies)))
    window = W.partitionBy(_BUCKET).orderBy(ROW)
    out = build(spread, window)
    return out.filter(F.col(_BUCKET) == home).drop(_BUCKET)


def carried_fill(df: DataFrame, values: dict[str, Column], backward: bool, size: int | None = None) -> DataFrame:
    """Replace NULL by the nearest earlier (or later) non-NULL value.

    Inside a bucket a running window does it; the value that enters a bucket
    comes from a table with one row per bucket.
    """
    require_index(df, "fill")
    span = bucket_rows(df, size=size)
    names = list(values)
    work = df.withColumns({c: values[c] for c in names}).withColumn(_BUCKET, _bucket(span))
    pick = F.min_by if backward else F.max_by
    edge = work.groupBy(_BUCKET).agg(
        *[pick(quoted(c), F.when(quoted(c).isNotNull(), F.col(ROW))).alias(f"__e{i}") for i, c in enumerate(names)]
    )
    if backward:
        outside = W.orderBy(_BUCKET).rowsBetween(1, W.unboundedFollowing)
        inside = W.partitionBy(_BUCKET).orderBy(ROW).rowsBetween(0, W.unboundedFollowing)
        take = F.first
    else:
        outside = W.orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
        inside = W.partitionBy(_BUCKET).orderBy(ROW).rowsBetween(W.unboundedPreceding, 0)
        take = F.last
    carry = edge.select(
        _BUCKET, *[take(f"__e{i}", ignorenulls=True).over(outside).alias(f"__c{i}") for i in range(len(names))]
    )
    joined = work.join(F.broadcast(carry), _BUCKET)
    filled = {c: F.coalesce(take(quoted(c), ignorenulls=True).over(inside), F.col(f"__c{i}")) for i, c in enumerate(names)}
    return joined.withColumns(filled).select(*[quoted(c) for c in df.columns])


def running_total(df: DataFrame, amount: str, order_by: list[str], into: str) -> DataFrame:
    """Sum of ``amount`` over all rows before this one along ``order_by``.

    Same layout as :func:`with_row_index`: sorted partitions are written once,
    then each adds the total of the partitions in front of it.
    """
    keys = _ordering(order_by)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialize(placed.withColumn(_POS, F.monotonically_increasing_id()))
    stored = stored.withColumn(_PART, F.shiftright(_POS, 33))
    sums = stored.groupBy(_PART).agg(F.sum(amount).alias("s"))
    before = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(_PART, F.coalesce(F.sum("s").over(before), F.lit(0)).alias(_OFFSET))
    inside = W.partitionBy(_PART).orderBy(_POS).rowsBetween(W.unboundedPreceding, -1)
    joined = stored.join(F.broadcast(offsets), _PART)
    total = F.col(_OFFSET) + F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return joined.withColumn(into, total).drop(_POS, _PART, _OFFSET)
