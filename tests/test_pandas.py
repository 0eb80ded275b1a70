"""Same answers as pandas where its rules are the standard."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.operators import binning, columns, ordered, rows
from rowloom.operators.ordering import with_row_index


@pytest.fixture(scope="module")
def events(table):
    e = table("events").select("event_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return with_row_index(e, ["ts"])


@pytest.fixture(scope="module")
def pdf(events):
    return events.toPandas().sort_values("_row_index").reset_index(drop=True)


def column(df, name):
    return df.select("_row_index", name).toPandas().sort_values("_row_index")[name].reset_index(drop=True)


def same(a, b):
    np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("k", [1, 3, -2])
def test_shift(events, pdf, k):
    out = ordered.shift_column(events, "v", "down" if k > 0 else "up", abs(k), new_name="s")
    same(column(out, "s"), pdf["v"].shift(k))


@pytest.mark.parametrize("stat", ["mean", "std", "var", "min", "max", "median", "skew", "kurt"])
@pytest.mark.parametrize("size", [5, 16384])
def test_rolling(events, pdf, stat, size, monkeypatch):
    monkeypatch.setattr("rowloom.operators.ordering.BUCKET_ROWS", size)
    out = ordered.rolling_window_stats_nested(events, "v", [5], stat)
    got, want = column(out, f"v_roll_{stat}_5"), getattr(pdf["v"].rolling(5, min_periods=1), stat)()
    np.testing.assert_allclose(got.astype(float), want, rtol=1e-6, atol=1e-6, equal_nan=True)


def test_rolling_constant(spark):
    df = spark.createDataFrame([(i, 2.0) for i in range(6)], "_row_index long, v double")
    out = ordered.rolling_window_stats_nested(df, "v", [5], ["kurt", "skew"])
    assert column(out, "v_roll_kurt_5").tolist()[-1] == -3.0
    assert column(out, "v_roll_skew_5").tolist()[-1] == 0.0


def test_rank(events, pdf):
    same(column(ordered.stats_percentile_rank(events, "v"), "v_pct_rank"), pdf["v"].rank(pct=True))


@pytest.mark.parametrize("bins", [2, 5, 9])
def test_cut_labels(events, pdf, bins):
    got = column(binning.auto_binning(events, "v", "equal_width", bins), "v_binned")
    edges = np.linspace(pdf["v"].min(), pdf["v"].max(), bins + 1)
    want = pd.cut(pdf["v"], edges, include_lowest=True).astype("string")
    assert got.astype("string").fillna("-").tolist() == want.fillna("-").tolist()


@pytest.mark.parametrize("bins", [4, 10])
def test_qcut_labels(events, pdf, bins):
    got = column(binning.auto_binning(events, "v", "quantile", bins), "v_binned")
    _, edges = pd.qcut(pdf["v"], bins, retbins=True, duplicates="drop")
    want = pd.cut(pdf["v"], edges, include_lowest=True).astype("string")
    assert got.astype("string").fillna("-").tolist() == want.fillna("-").tolist()


@pytest.mark.parametrize("edges", [[1.0, 2.0, 4.0], [0.00123, 0.00124, 0.5], [-np.inf, 4.1234567, np.inf], [1e6, 1e6 + 0.0001, 2e6]])
def test_interval_texts(edges):
    want = pd.cut(pd.Series([(a + b) / 2 if np.isfinite(a + b) else max(a, b - 1, -9e9) for a, b in zip(edges, edges[1:])]), edges, include_lowest=True)
    assert binning.interval_labels(edges) == [str(c) for c in want.cat.categories]


def test_dummies(events, pdf):
    e = events.withColumn("k", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 4))
    want = pd.get_dummies(e.toPandas().sort_values("_row_index")["k"].map(lambda x: None if pd.isna(x) else str(int(x))), prefix="k", dummy_na=True)
    out = columns.encode_one_hot(e.withColumn("k", F.col("k").cast("string")), "k")
    assert [c for c in out.columns if c.startswith("k_")] == list(want.columns)
    for c in want.columns:
        assert column(out, c).tolist() == want[c].tolist()


def test_fill(events, pdf):
    same(column(columns.fill_missing(events, "v", "ffill"), "v"), pdf["v"].ffill())
    same(column(columns.fill_missing(events, "v", "bfill"), "v"), pdf["v"].bfill())


def test_outliers(events, pdf):
    kept = rows.remove_outliers_iqr(events, "v").count()
    q1, q3 = pdf["v"].quantile([0.25, 0.75])
    inside = pdf["v"].isna() | pdf["v"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    assert kept == inside.sum()


def test_duplicated(table):
    from rowloom.operators.profile import overview

    e = table("events").select("event_type", F.round("value", 0).alias("v"))
    assert overview(e).first()["duplicate_rows"] == e.toPandas().duplicated().sum()
