"""Exact split points of a sorted column: tree cuts and natural breaks.

Both work on the distinct values of the column with their counts, sorted over
range partitions, and on sums that run along them: a running sum is one window
inside each partition plus the totals of the partitions before it, so no task
sees the whole column. Nothing is binned beforehand, whatever the number of
distinct values, classes or rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import materialize

INF = float("inf")
#: Gains at most this share of the root's impurity are none.
NO_GAIN = 1e-12
#: Values (ends and starts of classes) that one task settles by itself, and ends that are tried at once in larger ranges.
LOCAL_VALUES = 1 << 17
PIVOTS = 32
#: Cells of a cost matrix in a task.
CELLS = 1 << 20


def sorted_parts(df: DataFrame) -> DataFrame:
    """``df`` dealt to range partitions of ``v``, whose numbers (``part``) rise with it; rows of one value share one."""
    return materialize(df.repartitionByRange("v").withColumn("part", F.spark_partition_id()))


def running(df: DataFrame, groups: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums over all rows of the group up to each row, along ``v`` (unique inside a group)."""
    held = df.withColumns({f"__{n}": c for n, c in sums.items()})
    inside = Window.partitionBy(*groups, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*groups, "part").agg(*(F.sum(f"__{n}").alias(f"__t_{n}") for n in sums))
    zero = {n: F.lit(0).cast(totals.schema[f"__t_{n}"].dataType) for n in sums}
    offsets = totals.select(*groups, "part", *(F.coalesce(F.sum(f"__t_{n}").over(before), zero[n]).alias(f"__o_{n}") for n in sums))
    placed = held.withColumns({n: F.sum(f"__{n}").over(inside) for n in sums}).join(offsets, [*groups, "part"])
    out = placed.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums})
    return out.drop(*(f"__{n}" for n in sums), *(f"__o_{n}" for n in sums))


def _entropy_terms(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(F.greatest(x, F.lit(1.0)))).otherwise(F.lit(0.0))


def _class_gains(rows: DataFrame, entropy: bool) -> DataFrame:
    """(leaf, v, gain) of a cut after each value, from rows (leaf, part, v, y, n).

    A class that has c rows up to a value adds g(c) to a side's purity, with
    g(c) = c squared (Gini) or c log c (entropy); both sides change only by
    the classes that occur at the value.
    """
    grow = _entropy_terms if entropy else lambda x: x * x
    size = F.col("n").cast("double")
    placed = running(rows, ["leaf", "y"], {"c": size})
    totals = rows.groupBy("leaf", "y").agg(F.sum(size).alias("t"))
    placed = placed.join(totals, ["leaf", "y"])
    c, t = F.col("c"), F.col("t")
    each = placed.groupBy("leaf", "part", "v").agg(
        F.sum(size).alias("n"), F.sum(grow(c) - grow(c - size)).alias("left"), F.sum(grow(t - c) - grow(t - c + size)).alias("right")
    )
    sums = running(each, ["leaf"], {"nl": F.col("n"), "ql": F.col("left"), "qr": F.col("right")})
    whole = totals.groupBy("leaf").agg(F.sum("t").alias("all"), F.sum(grow(F.col("t"))).alias("q"))
    sums = sums.join(F.broadcast(whole), "leaf")  # a row per leaf
    impurity = (lambda n, q: _entropy_terms(n) - q) if entropy else (lambda n, q: n - q / F.greatest(n, F.lit(1.0)))
    rest = F.col("all") - F.col("nl")
    gain = impurity(F.col("all"), F.col("q")) - impurity(F.col("nl"), F.col("ql")) - impurity(rest, F.col("q") + F.col("qr"))
    return sums.select("leaf", "v", gain.alias("gain"), rest.alias("rest"), impurity(F.col("all"), F.col("q")).alias("impurity"))


def _moment_gains(rows: DataFrame) -> DataFrame:
    """(leaf, v, gain) of a cut after each value, from rows (leaf, part, v, n, s, q): squared deviation saved."""
    sums = running(rows, ["leaf"], {"nl": F.col("n").cast("double"), "sl": F.col("s"), "ql": F.col("q")})
    whole = rows.groupBy("leaf").agg(F.sum(F.col("n").cast("double")).alias("all"), F.sum("s").alias("st"), F.sum("q").alias("qt"))
    sums = sums.join(F.broadcast(whole), "leaf")  # a row per leaf
    rest = F.col("all") - F.col("nl")
    means = lambda s, n: s * s / F.greatest(n, F.lit(1.0))
    whole_mean = means(F.col("st"), F.col("all"))
    gain = means(F.col("sl"), F.col("nl")) + means(F.col("st") - F.col("sl"), rest) - whole_mean
    return sums.select("leaf", "v", gain.alias("gain"), rest.alias("rest"), (F.col("qt") - whole_mean).alias("impurity"))


def tree_thresholds(rows: DataFrame, classify: bool, criterion: str, leaves: int) -> list[float]:
    """Thresholds of the tree on (v, y) that is grown best leaf first.

    Each round looks at the two leaves that the last cut made, in one pass
    over their rows; equal gains go to the smaller value, then to the lower
    leaf. A threshold lies halfway between the values next to its cut.
    """
    held = rows.where("v IS NOT NULL AND y IS NOT NULL AND abs(v) < double('Infinity')")
    held = held if classify else held.where("abs(y) < double('Infinity')")
    if classify:
        counted = held.groupBy("v", "y").agg(F.count("*").alias("n"))
    else:
        centre = held.agg(F.avg("y")).first()[0] or 0.0
        y = F.col("y") - F.lit(centre)
        counted = held.groupBy("v").agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    parts = sorted_parts(counted)
    least = None

    def best(spans: list[tuple[float, float]]) -> list[tuple]:
        nonlocal least
        leaf = F.lit(None).cast("int")
        for i, (lo, hi) in enumerate(spans):
            leaf = F.when((F.col("v") > lo) & (F.col("v") <= hi), F.lit(i)).otherwise(leaf)
        labelled = parts.withColumn("leaf", leaf).where("leaf IS NOT NULL")
        gains = _class_gains(labelled, criterion == "entropy") if classify else _moment_gains(labelled)
        found = gains.where("rest > 0").groupBy("leaf").agg(F.max(F.struct("gain", (-F.col("v")).alias("v"))).alias("b"), F.max("impurity").alias("impurity")).collect()
        if least is None:
            least = max((r["impurity"] for r in found), default=0.0) * NO_GAIN
        return [(r["b"]["gain"], *spans[r["leaf"]], -r["b"]["v"]) for r in sorted(found, key=lambda r: r["leaf"])]

    open_, out = best([(-INF, INF)]), []
    while len(out) + 1 < leaves and open_:
        top = max(open_, key=lambda x: (x[0], -x[1]))
        gain, lo, hi, cut = top
        if gain <= max(least, 0.0):
            break
        open_.remove(top)
        after = parts.where((F.col("v") > cut) & (F.col("v") <= hi)).agg(F.min("v")).first()[0]
        out.append((cut + after) / 2.0)
        if len(out) + 1 < leaves:
            open_ += best([(lo, cut), (cut, hi)])
    return sorted(out)


def _costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared deviation of the values after prefix ``a`` up to prefix ``b``; columns are counts, sums, squares."""
    n, s, q = (b[..., i] - a[..., i] for i in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, np.maximum(q - s * s / np.where(n > 0, n, 1.0), 0.0), INF)


def _settled(starts: np.ndarray, at: np.ndarray, cost: np.ndarray, ends: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end the least cost of (classes before a start) + (one class from there), and that start.

    The best start never falls as the end grows, so the middle end parts the
    starts for the ends on either side.
    """
    best, came = np.full(len(to), INF), np.full(len(to), -1, np.int64)
    stack = [(0, len(to), 0, len(at))]
    while stack:
        lo, hi, a, b = stack.pop()
        if lo >= hi:
            continue
        small = (hi - lo) * (b - a) <= CELLS >> 4
        rows = np.arange(lo, hi) if small else np.array([(lo + hi) // 2])
        table = cost[None, a:b] + _costs(starts[None, a:b], ends[rows][:, None])
        table = np.where(at[None, a:b] < to[rows][:, None], table, INF)
        pick = np.argmin(table, axis=1)
        best[rows], came[rows] = table[np.arange(len(rows)), pick], at[a + pick]
        if not small:
            mid, chosen = int(rows[0]), int(a + pick[0])
            stack += [(lo, mid, a, chosen + 1), (mid + 1, hi, chosen, b)]
    return best, came


_SUMS = ["cn", "cs", "cq"]


def _layer(prefixes: DataFrame, size: int, group: int, last: bool, local: int, pivots: int) -> DataFrame:
    """(at, cost, came): least cost of the first ``at`` values in ``group`` classes, from rows (at, cn, cs, cq, cost) of one class less.

    Ranges of ends whose possible starts are too many for one task are parted
    by some of their ends, tried against all starts in one pass; the other
    ends lie between them with their starts between the ones found.
    """
    todo = [(size if last else group, size, group - 1, size - 1)]  # ends from, to; starts from, to
    ready: list[tuple[int, int, int, int]] = []
    found = []
    while todo:
        small = [t for t in todo if t[1] - t[0] + t[3] - t[2] + 2 <= local]
        ready += small
        todo = [t for t in todo if t not in small]
        if not todo:
            break
        tried = [(j, lo, hi) for a, b, lo, hi in todo for j in sorted({a + (b - a) * i // max(1, pivots - 1) for i in range(pivots)})]
        tried = [(j, lo, min(hi, j - 1)) for j, lo, hi in tried]
        marks = {r["at"]: r for r in prefixes.where(F.col("at").isin([t[0] for t in tried])).select("at", *_SUMS).collect()}
        wanted = np.array([(j, lo, hi, *(marks[j][c] for c in _SUMS)) for j, lo, hi in tried], float)

        def scan(batches: Iterator[pa.RecordBatch], wanted: np.ndarray = wanted) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch["at"].to_numpy()
                if not len(at):
                    continue
                sums = np.stack([batch[c].to_numpy() for c in _SUMS], 1)
                cost = batch["cost"].to_numpy()
                rows = []
                for j, lo, hi, *end in wanted[(wanted[:, 1] <= at.max()) & (wanted[:, 2] >= at.min())]:
                    total = np.where((at >= lo) & (at <= hi), cost + _costs(sums, np.array(end)), INF)
                    pick = np.lexsort((at, total))[0]
                    if total[pick] < INF:
                        rows.append((int(j), float(total[pick]), int(at[pick])))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], ["at", "cost", "came"])

        scanned = prefixes.select("at", *_SUMS, "cost").mapInArrow(scan, "at bigint, cost double, came bigint")
        best = scanned.groupBy("at").agg(F.min(F.struct("cost", "came")).alias("b")).select("at", "b.cost", "b.came")
        best = {r["at"]: r for r in best.collect()}  # a row per end tried
        found += [(j, r["cost"], r["came"]) for j, r in best.items()]
        parted = []
        for a, b, lo, hi in todo:
            inner = [j for j, _, _ in tried if a <= j <= b]
            for x, y in zip(inner, inner[1:]):
                if y - x > 1:
                    parted.append((x + 1, y - 1, best[x]["came"], best[y]["came"]))
        todo = parted
    out = prefixes.sparkSession.createDataFrame(found, "at long, cost double, came long")
    if not ready:
        return materialize(out)
    spans = np.array(ready, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["at"].to_numpy()
            if not len(at):
                continue
            low, high = at.min(), at.max()
            for no in np.flatnonzero(((spans[:, 0] <= high) & (spans[:, 1] >= low)) | ((spans[:, 2] <= high) & (spans[:, 3] >= low))).tolist():
                a, b, lo, hi = spans[no].tolist()
                end, start = (at >= a) & (at <= b), (at >= lo) & (at <= hi)
                keep = np.flatnonzero(end | start)
                if len(keep):
                    part = batch.take(pa.array(keep))
                    columns = [pa.array(np.full(len(keep), no)), *part.columns, pa.array(end[keep]), pa.array(start[keep])]
                    yield pa.RecordBatch.from_arrays(columns, ["no", *part.schema.names, "end", "start"])

    def solve(table: pa.Table) -> pa.Table:
        at = table["at"].to_numpy()
        order = np.argsort(at)
        at, cost = at[order], table["cost"].to_numpy()[order]
        sums = np.stack([table[c].to_numpy() for c in _SUMS], 1)[order]
        end, start = (table[c].to_numpy(zero_copy_only=False)[order] for c in ("end", "start"))
        best, came = _settled(sums[start], at[start], cost[start], sums[end], at[end])
        return pa.table({"at": at[end], "cost": best, "came": came})

    dealt = prefixes.select("at", *_SUMS, "cost").mapInArrow(deal, "no bigint, at bigint, cn double, cs double, cq double, cost double, end boolean, start boolean")
    return materialize(out.unionByName(dealt.groupBy("no").applyInArrow(solve, "at bigint, cost double, came bigint")))


def natural_breaks(values: DataFrame, classes: int, local: int = LOCAL_VALUES, pivots: int = PIVOTS) -> list[float]:
    """Upper ends of the ``classes`` classes of (v) with the least squared deviation from their means."""
    held = values.where("abs(v) < double('Infinity')")
    centre = held.agg(F.avg("v")).first()[0] or 0.0
    parts = sorted_parts(held.groupBy("v").agg(F.count("*").alias("n")))
    x, n = F.col("v") - F.lit(centre), F.col("n").cast("double")
    sums = running(parts, [], {"at": F.lit(1).cast("long"), "cn": n, "cs": x * n, "cq": x * x * n})
    prefixes = materialize(sums.select("at", "v", *_SUMS))
    size = prefixes.count()
    k = min(classes, size)
    if not k:
        return []
    zero = prefixes.sparkSession.range(1).select(F.lit(0).cast("long").alias("at"), *(F.lit(0.0).alias(c) for c in _SUMS))
    bare = prefixes.select("at", *_SUMS)
    one = bare.withColumn("cost", F.greatest(F.col("cq") - F.col("cs") * F.col("cs") / F.col("cn"), F.lit(0.0)))
    held = one.unionByName(zero.withColumn("cost", F.lit(0.0)))
    came = []
    for group in range(2, k + 1):
        layer = _layer(held, size, group, group == k, local, pivots)
        came.append(layer)
        held = bare.join(layer.select("at", "cost"), "at")
    at, stops = size, [size]
    for layer in reversed(came):
        at = layer.where(F.col("at") == at).first()["came"]
        stops.append(at)
    ends = {r["at"]: r["v"] for r in prefixes.where(F.col("at").isin(stops)).collect()}
    return sorted(ends.values())
