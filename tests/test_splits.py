"""Tree cuts and natural breaks against searches over all splits."""

import itertools
import math
import random

import numpy as np
import pytest

from rowloom.operators import splits
from rowloom.operators.binning import bin_edges


def deviation(values):
    m = sum(values) / len(values)
    return sum((v - m) ** 2 for v in values)


def best_breaks(values, k):
    distinct = sorted(set(values))
    out = []
    for cuts in itertools.combinations(range(1, len(distinct)), k - 1):
        ends = [distinct[c - 1] for c in cuts] + [distinct[-1]]
        groups, low = [], -math.inf
        for e in ends:
            groups.append([v for v in values if low < v <= e])
            low = e
        out.append(sum(map(deviation, groups)))
    return min(out)


def cost(values, ends):
    total, low = 0.0, -math.inf
    for e in ends:
        total += deviation([v for v in values if low < v <= e])
        low = e
    return total


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize("local, pivots", [(1 << 17, 32), (6, 2), (10, 4)])
def test_breaks_are_the_best_ones(spark, local, pivots):
    pick = random.Random(local)
    values = [float(pick.choice([pick.randrange(12), 100 + pick.randrange(5), 40])) for _ in range(90)]
    got = splits.natural_breaks(column(spark, [*values, None, float("inf"), float("nan")]), 4, local, pivots)
    assert len(got) == 4 and got[-1] == max(values)
    assert cost(values, got) == pytest.approx(best_breaks(values, 4))


def test_breaks_alike_in_one_task_and_in_many(spark):
    pick = np.random.default_rng(6)
    values = np.round(np.concatenate([pick.normal(0, 1, 900), pick.normal(9, 3, 700), pick.exponential(30, 400)]), 3).tolist()
    rows = column(spark, values).repartition(5)
    whole = splits.natural_breaks(rows, 5)
    assert splits.natural_breaks(rows, 5, 100, 8) == whole
    assert cost(values, whole) <= cost(values, [np.quantile(values, q) for q in (0.2, 0.4, 0.6, 0.8, 1.0)])


def test_breaks_of_few_values(spark):
    assert splits.natural_breaks(column(spark, []), 3) == []
    assert splits.natural_breaks(column(spark, [None, 4.0, 4.0]), 3) == [4.0]
    assert splits.natural_breaks(column(spark, [1.0, 2.0, 2.0]), 5) == [1.0, 2.0]


def impurity(ys, kind):
    n = len(ys)
    if kind == "moment":
        return deviation(ys)
    share = [ys.count(y) / n for y in set(ys)]
    return n * (1 - sum(p * p for p in share)) if kind == "gini" else -n * sum(p * math.log2(p) for p in share)


def best_first(rows, kind, leaves):
    open_, out = [sorted(rows)], []

    def best(part):
        cuts = []
        for v in sorted({r[0] for r in part})[:-1]:
            left, right = ([r[1] for r in part if (r[0] <= v) == side] for side in (True, False))
            cuts.append((round(impurity([r[1] for r in part], kind) - impurity(left, kind) - impurity(right, kind), 9), -v))
        return max(cuts, default=(0.0, 0.0))

    while len(out) + 1 < leaves:
        top = max(open_, key=lambda p: (best(p)[0], -p[0][0]))
        gain, v = best(top)
        if gain <= 0:
            break
        open_.remove(top)
        left, right = [r for r in top if r[0] <= -v], [r for r in top if r[0] > -v]
        out.append((left[-1][0] + right[0][0]) / 2)
        open_ += [left, right]
    return sorted(out)


@pytest.mark.parametrize("kind", ["gini", "entropy", "moment"])
def test_cuts_as_by_trying_all(spark, kind):
    pick = random.Random(kind)
    rows = []
    for _ in range(160):
        v = float(pick.choice([pick.randrange(40), 17, pick.random()]))
        rows.append((v, v * v / 100 + pick.random() if kind == "moment" else f"c{int(v) // 9 + pick.randrange(2)}"))
    kind_of = "double" if kind == "moment" else "string"
    lost = [(None, rows[0][1]), (3.0, None), (float("nan"), rows[0][1]), (float("inf"), rows[0][1])]
    df = spark.createDataFrame(rows + lost, f"v double, y {kind_of}").repartition(4)
    got = splits.tree_thresholds(df, kind != "moment", "gini" if kind == "moment" else kind, 5)
    assert got == pytest.approx(best_first(rows, kind, 5))


def test_many_classes_and_pure_leaves(spark):
    df = spark.range(5000).selectExpr("cast(id as double) v", "concat('k', id div 2) y")
    assert len(splits.tree_thresholds(df, True, "gini", 3)) == 2
    assert splits.tree_thresholds(df.selectExpr("v", "'same' y"), True, "gini", 3) == []
    assert splits.tree_thresholds(df.selectExpr("1.0D v", "y"), True, "gini", 3) == []
    assert splits.tree_thresholds(df.where("v < 0"), True, "entropy", 3) == []
    assert bin_edges(df, "v", "decision_tree", 2, target_column="y")[0] == -math.inf
