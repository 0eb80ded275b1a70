"""Kendall's tau-b over lags against counting all pairs."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.functions.inversions import count_inversions, inversions
from rowloom.operators import ordered, ordering
from rowloom.operators.ordering import with_row_index


def falling(values):
    return sum(a > b for a, b in itertools.combinations(values, 2))


def by_pairs(values, lag):
    rows = [(x, y) for x, y in zip(values[lag:], values) if x is not None and y is not None and x == x and y == y]
    score, tie_a, tie_b = 0, 0, 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        score += (a > c) * (b > d) + (a < c) * (b < d) - (a > c) * (b < d) - (a < c) * (b > d)
        tie_a, tie_b = tie_a + (a == c), tie_b + (b == d)
    all_pairs = len(rows) * (len(rows) - 1) / 2
    return len(rows), score / math.sqrt((all_pairs - tie_a) * (all_pairs - tie_b))


def test_inversions_of_arrays():
    pick = np.random.default_rng(3)
    for n, k in itertools.product((0, 1, 2, 3, 8, 33, 120), (1, 3, 500)):
        values = pick.integers(0, k, n)
        assert inversions(values) == falling(values.tolist())


@pytest.mark.parametrize("block_rows", [1, 7, 64, 1000])
def test_inversions_in_blocks(spark, block_rows):
    pick = random.Random(block_rows)
    rows, want = [], {}
    for grp, n in (("a", 100), ("b", 1), ("c", 30), ("d", 64)):
        r = pick.sample(range(n), n)
        rows += [(grp, p, x) for p, x in enumerate(r)]
        want[grp] = falling(r)
    got = count_inversions(spark.createDataFrame(rows, "grp string, p long, r long"), block_rows)
    assert {x["grp"]: int(x["inverted"]) for x in got.collect()} == want


@pytest.mark.parametrize("distinct", [3, 40, 10**6])
def test_tau_of_many_values(spark, distinct):
    pick = random.Random(distinct)
    values = [float(pick.randrange(distinct)) for _ in range(150)]
    values[10], values[20], values[30], values[31] = None, float("nan"), float("inf"), float("inf")
    values[40], values[41] = 0.0, -0.0
    df = with_row_index(spark.createDataFrame(list(enumerate(values)), "i int, v double"), ["i"])
    table = {r["lag"]: r for r in ordered.kendall_lag_table(df, "v", 1, 3, block_rows=16).collect()}
    for lag in (1, 2, 3):
        n, tau = by_pairs(values, lag)
        assert table[lag]["pairs"] == n and table[lag]["tau"] == pytest.approx(tau, abs=1e-12)


def test_hot_value_and_few_rows(spark):
    df = with_row_index(spark.range(60).select("id", F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id")).alias("v")), ["id"])
    values = [5.0 if i % 3 else float(i) for i in range(60)]
    r = ordered.kendall_lag_table(df, "v", 1, 1, block_rows=8).first()
    assert (r["pairs"], round(r["tau"], 12)) == (59, round(by_pairs(values, 1)[1], 12))
    same = with_row_index(spark.range(9).select("id", F.lit(1.0).alias("v")), ["id"])
    assert math.isnan(ordered.kendall_lag_table(same, "v", 1, 1).first()["tau"])
    assert ordered.kendall_lag_table(same.limit(1), "v", 1, 2).collect() == []


def test_exact_p_by_all_orders():
    for n in (3, 4, 6):
        counts = [falling(o) for o in itertools.permutations(range(n))]
        top = n * (n - 1) // 2
        for few in range(top // 2 + 1):
            share = sum(c <= few or c >= top - few for c in counts) / len(counts)
            assert ordered._exact_kendall_p(n, few) == pytest.approx(min(1.0, share))
    assert ordered._exact_kendall_p(200, 1) == pytest.approx(0.0, abs=1e-300)


def test_pairs_are_written_narrow(spark, monkeypatch):
    """Every pair is written once a numbering, with no more than later steps read; the tables go in the end."""
    written, kept = [], ordering.materialize

    def noted(df):
        out = kept(df)
        written.append((df.columns, out._written_to))
        return out

    df = with_row_index(spark.range(40).select("id", (F.col("id") * 7 % 11).alias("v")), ["id"], ["v"])
    assert df.columns == ["_row_index", "v"] and [r["v"] for r in df.orderBy("_row_index").collect()] == [i * 7 % 11 for i in range(40)]
    monkeypatch.setattr(ordering, "materialize", noted)
    table = ordered.kendall_lag_table(df, "v", 1, 2, block_rows=8).collect()
    assert [c for c, _ in written] == [["lag", "a", "b", "__pos"], ["lag", "b", "p", "__pos"]]
    assert not any(os.path.exists(path.removeprefix("file://")) for _, path in written)
    for r in table:
        assert r["tau"] == pytest.approx(by_pairs([i * 7 % 11 for i in range(40)], r["lag"])[1], abs=1e-12)
