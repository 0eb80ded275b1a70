"""Exact quantiles with linear interpolation, for columns of any size.

A column that surely fits one task is answered by Spark's exact
``percentile``. Beyond that no task may hold all distinct values:

* a few ranks are bracketed by the mergeable ``percentile_approx`` sketch, the
  bracket is counted exactly and narrowed until the rank is pinned; every round
  is one scan without a shuffle;
* many ranks are read off a range-partitioned running count of the distinct
  values, which costs one shuffle of them.

The answer is the same on every way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import number, quoted
from rowloom.functions.search import bounds_below

DIRECT_ROWS = 2_000_000
LISTED_VALUES = 100_000
SKETCH_ACCURACY = 10_000
BRACKETED_RANKS = 16
COLUMNS_PER_SCAN = 16


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    direct_rows: int = DIRECT_ROWS,
    listed: int = LISTED_VALUES,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles of each numeric column, missing values left out."""
    if not columns:
        return {}
    names = [f"v{i}" for i in range(len(columns))]
    values = df.select(*[number(df, c).alias(n) for c, n in zip(columns, names)])
    endless = [F.count(F.when(F.abs(n) == F.lit(float("inf")), 1)).alias(f"i{n}") for n in names]
    counts = values.agg(*[F.count(n).alias(n) for n in names], *endless).first()
    # Spark's percentile subtracts infinite neighbours to NaN, so columns that hold any are read by rank.
    small = [n for n in names if counts[n] <= direct_rows and not counts[f"i{n}"]]
    found: dict[str, list[float | None]] = {}
    if small:
        row = values.agg(*[F.percentile(F.col(n), probabilities).alias(n) for n in small]).first()
        found.update({n: list(row[n]) if row[n] is not None else [None] * len(probabilities) for n in small})
    big = [n for n in names if n not in found]
    spans = {n: [_span(p, counts[n]) for p in probabilities] for n in big}
    ranks = {n: sorted({r for low, high, _ in spans[n] for r in (low, high)}) for n in big}
    at: dict[tuple[str, int], float] = {}
    few = [n for n in big if len(ranks[n]) <= BRACKETED_RANKS]
    for start in range(0, len(few), COLUMNS_PER_SCAN):
        part = few[start : start + COLUMNS_PER_SCAN]
        wanted = {(n, r): counts[n] for n in part for r in ranks[n]}
        at.update(_bracketed(values.select(*part), wanted, listed, accuracy))
    for n in big:
        if n not in few:
            held = values.select(F.col(n).alias("v")).filter("v is not null")
            at.update({(n, r): v for r, v in _ranked(held, ranks[n]).items()})
        found[n] = [_between(at[n, low], at[n, high], share) for low, high, share in spans[n]]
    return {c: found[n] for c, n in zip(columns, names)}


def _between(a: float, b: float, share: float) -> float:
    """Between two neighbouring values; equal ones, infinite too, are the answer themselves."""
    return a if a == b or not share else a + (b - a) * share


def _span(p: float, n: int) -> tuple[int, int, float]:
    """The two ranks a quantile lies between, and how far."""
    at = p * (n - 1)
    low = min(int(math.floor(at)), n - 1)
    return low, min(low + 1, n - 1), at - low


def _ranked(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    from rowloom.operators.ordering import running_total

    counted = values.groupBy("v").agg(F.count("*").alias("n"))
    placed = running_total(counted, "n", ["v"], "before")
    marks = [float(r) for r in ranks]
    placed = bounds_below(placed, "before", marks, "lo")
    placed = bounds_below(placed.withColumn("end", F.col("before") + F.col("n")), "end", marks, "hi")
    hits = placed.filter(F.col("hi") > F.col("lo")).select("v", "lo", "hi").collect()
    return {ranks[i]: float(h["v"]) for h in hits for i in range(int(h["lo"]), int(h["hi"]))}


def _bracketed(
    values: DataFrame, wanted: dict[tuple[str, int], int], listed: int, accuracy: int
) -> dict[tuple[str, int], float]:
    """Pin (column, rank) pairs, given the number of values of each column.

    A bracket is an open interval with the exact number of values up to and
    inside it. Each round tests its two ends and leaves them out, so it shrinks
    even where single values hold much of the column. All columns share the
    scans of a round.
    """
    inf = float("inf")
    names = sorted({c for c, _ in wanted})
    counts = [F.count(F.when(F.col(c) == v, 1)).alias(f"{side}{i}") for i, c in enumerate(names) for side, v in (("low", -inf), ("top", inf))]
    ends = values.agg(*counts).first()
    brackets, answers = {}, {}
    for k, n in wanted.items():
        low, top = (ends[f"{side}{names.index(k[0])}"] for side in ("low", "top"))
        if k[1] < low or k[1] >= n - top:
            answers[k] = -inf if k[1] < low else inf
        brackets[k] = (-inf, inf, low, n - low - top)
    slack = dict.fromkeys(wanted, 2.0 / accuracy)

    def within(key: tuple[str, int]) -> Column:
        lo, hi, _, _ = brackets[key]
        return (F.col(key[0]) > lo) & (F.col(key[0]) < hi)

    while len(answers) < len(wanted):
        todo = [k for k in wanted if k not in answers]
        short = [k for k in todo if brackets[k][3] <= listed]
        if short:
            answers.update(_listed(values, {k: brackets[k] for k in short}))
            continue
        sketches = []
        for i, k in enumerate(todo):
            _, _, below, inside = brackets[k]
            at = (k[1] - below) / inside
            span = [max(0.0, at - slack[k]), min(1.0, at + 1.0 / inside + slack[k])]
            sketches.append(F.percentile_approx(F.when(within(k), F.col(k[0])), span, accuracy).alias(f"b{i}"))
        sketch = values.agg(*sketches).first()
        checks = []
        for i, k in enumerate(todo):
            (lo, hi), v = sketch[f"b{i}"], F.col(k[0])
            tests = {"u": v < lo, "l": v == lo, "m": (v > lo) & (v < hi), "h": v == hi}
            checks += [F.count(F.when(t, 1)).alias(f"{name}{i}") for name, t in tests.items()]
        tally = values.agg(*checks).first()
        for i, k in enumerate(todo):
            (lo, hi), rank = sketch[f"b{i}"], k[1]
            low_end = tally[f"u{i}"] + tally[f"l{i}"]
            high_end = low_end + tally[f"m{i}"]
            if tally[f"u{i}"] <= rank < low_end:
                answers[k] = lo
            elif low_end <= rank < high_end:
                brackets[k] = (lo, hi, low_end, tally[f"m{i}"])
            elif lo < hi and high_end <= rank < high_end + tally[f"h{i}"]:
                answers[k] = hi
            else:
                if slack[k] >= 1.0:
                    raise RuntimeError(f"rank {k[1]} of {k[0]} is not among its values")
                slack[k] = min(1.0, slack[k] * 8)
    return answers


def _listed(values: DataFrame, brackets: dict[tuple[str, int], tuple]) -> dict[tuple[str, int], float]:
    """Read ranks off the counted values of short brackets, in one job."""
    spans = sorted({(k[0], *b) for k, b in brackets.items()})
    marks = [
        F.when((F.col(n) > lo) & (F.col(n) < hi), F.struct(F.lit(i).alias("b"), F.col(n).alias("v")))
        for i, (n, lo, hi, _, _) in enumerate(spans)
    ]
    tagged = values.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.b", "m.v")
    held: dict[int, list] = {}
    for row in tagged.groupBy("b", "v").agg(F.count("*").alias("n")).collect():
        held.setdefault(row["b"], []).append((row["v"], row["n"]))
    out = {}
    for k, bracket in brackets.items():
        seen = bracket[2]
        for v, n in sorted(held[spans.index((k[0], *bracket))]):
            seen += n
            if k[1] < seen:
                out[k] = v
                break
    return out


def grouped_quantile(
    df: DataFrame,
    keys: list[str],
    value: Column,
    probability: float,
    into: str,
) -> DataFrame:
    """One exact quantile per group where a group may be too big for a task.

    Values are counted per (group, value) first, which spreads a hot group
    over all partitions; a range-partitioned running count then locates the
    wanted ranks, so no task ever holds a whole group.
    """
    from rowloom.operators.ordering import running_total

    names = [quoted(k) for k in keys]
    counted = (
        df.select(*names, value.alias("__v")).filter("__v is not null").groupBy(*names, "__v").agg(F.count("*").alias("__n"))
    )
    ranked = running_total(counted, "__n", [*keys, "__v"], "__before")
    groups = ranked.groupBy(*names).agg(F.min("__before").alias("__start"), F.sum("__n").alias("__total"))
    side = groups.select(*[quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__start", "__total")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"__k{i}"))
    at = F.lit(float(probability)) * (F.col("__total") - 1)
    low = F.floor(at).cast("long")
    begin = F.col("__before") - F.col("__start")

    def holds(rank: Column) -> Column:
        return (begin <= rank) & (rank < begin + F.col("__n"))

    high = F.least(low + 1, F.col("__total") - 1)
    hits = ranked.join(side, same).filter(holds(low) | holds(high))
    a = F.max(F.when(holds(low), F.col("__v")))
    b = F.max(F.when(holds(high), F.col("__v")))
    share = F.max(at - low)
    return hits.groupBy(*names).agg(F.when((a == b) | (share == 0), a).otherwise(a + (b - a) * share).alias(into))
