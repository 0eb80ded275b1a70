"""Correlations in one scan and quantiles of infinite values against plain ones."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.functions import correlation
from rowloom.functions.quantiles import exact_quantiles
from rowloom.operators import profile


def test_pairs_over_rows_where_both_are_present(spark, monkeypatch):
    monkeypatch.setattr(correlation, "BLOCK_COLUMNS", 2)
    pick = np.random.default_rng(2)
    base = pick.normal(1e6, 1, 200)
    rows = []
    for i in range(200):
        row = [base[i], base[i] * 2 + pick.normal(), -base[i], 7.0, pick.normal()]
        rows.append([None if pick.random() < 0.2 else float(x) for x in row])
    rows[3][4] = float("inf")
    names = list("uvwxy")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    got = {(r["a"], r["b"]): (r["n"], r["r"]) for r in correlation.pair_correlations(df, {c: F.col(c) for c in names}).collect()}
    assert set(got) == set(itertools.combinations(names, 2))
    for (a, b), (n, r) in got.items():
        both = [(p[names.index(a)], p[names.index(b)]) for p in rows]
        both = np.array([p for p in both if None not in p and abs(sum(p)) < math.inf])
        assert n == len(both)
        assert r is None if "x" in (a, b) else r == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-6)
    one = correlation.pair_correlations(df, {c: F.col(c) for c in names}, ["w"]).collect()
    assert sorted((r["a"], r["b"]) for r in one) == [(c, "w") for c in "uvxy"]


def test_profile_of_constant_and_empty_columns(spark):
    df = spark.range(30).selectExpr("7 AS fixed", "cast(id AS double) AS v", "cast(NULL AS double) AS none", "id * id AS w")
    found = profile.profile(df)
    assert [p["feature_a"] + p["feature_b"] for p in found["top_correlations"]] == ["vw"]
    steps = {(s["op"], s["column"]): s["how"] for s in found["suggested_steps"]}
    assert steps["delete_columns", "fixed"] == "constant" and steps["scale_numeric", "v"] == "z_score"
    assert found["target_profile"]["suggested_target"] == "v" and found["validation"] == {"method": "random", "time_columns": [], "folds": 2}


@pytest.mark.parametrize("direct_rows", [2_000_000, 20])
def test_quantiles_of_infinite_and_hot_values(spark, direct_rows):
    pick = random.Random(direct_rows)
    inf = math.inf
    for values in ([float(i) for i in range(300)] + [inf] * 700, [-inf] * 40 + [1.0] * 21 + [inf] * 40, [3.0] * 90 + [float(pick.randrange(9)) for _ in range(40)], [-inf, inf]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        held, share = sorted(values), [0.0, 0.1, 0.299, 0.3, 0.5, 0.77, 1.0]
        want = []
        for p in share:
            at = p * (len(held) - 1)
            low, high = held[math.floor(at)], held[min(math.floor(at) + 1, len(held) - 1)]
            want.append(low if low == high or at == math.floor(at) else low + (high - low) * (at - math.floor(at)))
        assert exact_quantiles(df, ["v"], share, direct_rows=direct_rows)["v"] == pytest.approx(want, nan_ok=True)
