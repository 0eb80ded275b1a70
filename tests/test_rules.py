"""Edge rules on small hand-made tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError, number, text_is_json, timestamp
from rowloom.operators import aggregate, binning, columns, datemath, joins, ordered, rows, scaling
from rowloom.operators.ordering import with_row_index

NAN = float("nan")


def values(df, column, by="_row_index"):
    return [r[column] for r in df.orderBy(by).collect()]


def frame(spark, data, ddl):
    return spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(data)], "_row_index long, " + ddl)


def test_number_guard(spark):
    texts = [" 5 ", "1e3", "1,000", "0x1F", "1_000", "True", "inf", "NaN", "", None, "5d", ".5", "-3."]
    df = frame(spark, texts, "v string")
    got = values(df.withColumn("n", number(df, "v")), "n")
    assert got == [5.0, 1000.0, None, None, None, None, math.inf, None, None, None, None, 0.5, -3.0]


def test_dedup_texts(spark):
    df = frame(spark, ["Ann ", "ann", "ANN", "a  b", "a b", "N/A", "", None, "a b"], "name string")
    assert values(rows.drop_duplicates(df, ["name"]), "_row_index") == [0, 3, 5]
    assert values(rows.drop_duplicates(df, ["name"], "last"), "_row_index") == [2, 7, 8]
    assert values(rows.drop_duplicates(df, ["name"], "none"), "_row_index") == []
    # with case kept, "N/A" is no null word, while "" and NULL still match
    assert values(rows.drop_duplicates(df, ["name"], case_sensitive=True), "_row_index") == [0, 1, 2, 3, 5, 6]


def test_dedup_nested(spark):
    data = [(["x"], {"a": "1", "b": "2"}), (["X "], {"b": "2", "a": "1"}), (["y"], {"a": "1"})]
    df = frame(spark, data, "tags array<string>, m map<string,string>")
    assert values(rows.drop_duplicates(df), "_row_index") == [0, 2]


@pytest.mark.parametrize(
    ("column", "condition", "value", "left"),
    [
        ("x", "ne", 1, [0]),
        ("x", "gt", 1, [0, 2, 3]),
        ("x", "is_null", None, [0, 1, 4]),
        ("s", "ne", "a", [0, 2, 3]),
        ("s", "not_contains", "a", [0, 4]),
        ("s", "contains", "a", [1, 2, 3]),
        ("s", "not_in", "a,b", [0, 1]),
        ("s", "eq", "a", [1, 2, 3, 4]),
        ("t", "gt", "2024-01-01", [0, 2, 3, 4]),
    ],
)
def test_condition_null_rules(spark, column, condition, value, left):
    data = [("a", 1.0, "12"), ("b", 2.0, "2024-05-01"), (None, None, None), (None, NAN, "2023-01-01"), ("ca", 3.0, "abc")]
    df = frame(spark, data, "s string, x double, t string")
    assert values(rows.delete_rows_condition(df, column, condition, value), "_row_index") == left


def test_condition_needs_value(spark):
    df = frame(spark, ["a"], "s string")
    with pytest.raises(ParameterError):
        rows.delete_rows_condition(df, "s", "eq", "")
    with pytest.raises(ParameterError):
        rows.delete_rows_condition(df, "s", "gt", "word")


def test_add_row_checks_types(spark):
    df = frame(spark, [(1.0, "a")], "x double, s string")
    with pytest.raises(ParameterError):
        rows.add_row(df, {"x": "word"})
    with pytest.raises(ParameterError):
        rows.add_row(df, {"nothing": 1})
    assert values(rows.add_row(df, {"x": "2"}), "x") == [1.0, 2.0]
    assert values(rows.add_row(df, {"x": 3}, 0), "x") == [3.0, 1.0]


def test_clip_keeps_null(spark):
    df = frame(spark, [None, -1.0, 5.0], "x double")
    assert values(columns.clip_values(df, "x", min=0), "x") == [None, 0.0, 5.0]
    assert values(columns.clip_values(df, "x", max=3), "x") == [None, -1.0, 3.0]


def test_constant_column(spark):
    df = frame(spark, [2.0, 2.0, None], "v double")
    assert values(scaling.scale(df, "min_max_scaling", "v"), "v_minmax") == [0.0, 0.0, None]
    assert values(scaling.scale(df, "z_score_scaling", "v"), "v_zscaled") == [0.0, 0.0, None]
    assert values(aggregate.stats_zscore(df, "v"), "v_zscore") == [None, None, None]
    assert values(binning.auto_binning(df, "v"), "v_binned") == ["(1.499, 2.5]", "(1.499, 2.5]", None]
    with pytest.raises(ParameterError):
        rows.remove_outliers_iqr(df, "v", "zscore")


def test_all_null_column(spark):
    df = frame(spark, [None, None], "v double")
    assert values(scaling.scale(df, "robust_scaling", "v"), "v_robust") == [None, None]
    assert values(scaling.scale(df, "quantile_transform", "v"), "v_quantile") == [None, None]
    assert values(binning.auto_binning(df, "v", "quantile"), "v_binned") == [None, None]
    assert values(ordered.stats_percentile_rank(df, "v"), "v_pct_rank") == [None, None]


def test_rank_of_ties(spark):
    df = frame(spark, [1.0, 2.0, 2.0, None], "v double")
    assert values(ordered.stats_percentile_rank(df, "v"), "v_pct_rank") == pytest.approx([1 / 3, 5 / 6, 5 / 6, None])


def test_half_even_rounding(spark):
    df = frame(spark, [0.5, 1.5, 2.5, -2.5], "v double")
    assert values(datemath.math_unary(df, "v", "round"), "v") == [0.0, 2.0, 2.0, -2.0]


def test_date_difference_rounds_down(spark):
    day = dt.datetime(2024, 1, 2)
    df = frame(spark, [(day, day + dt.timedelta(hours=10)), (day, day - dt.timedelta(days=1, hours=1))], "a timestamp_ntz, b timestamp_ntz")
    out = datemath.date_diff_days(df, "a", reference_column="b")
    assert values(out, "a_diff_days") == [-1, 1]
    assert out.columns == ["_row_index", "a", "a_diff_days", "b"]


def test_iso_week_and_sunday(spark):
    df = frame(spark, [dt.datetime(2021, 1, 3), dt.datetime(2024, 12, 30)], "a timestamp_ntz")
    assert values(datemath.extract_date_part(df, "a", "week"), "a_week") == [53, 1]
    assert values(datemath.extract_date_part(df, "a", "dayofweek"), "a_dayofweek") == [6, 0]


def test_title_case(spark):
    df = frame(spark, ["o'neil foo-bar 3rd", "éa ß", None], "s string")
    assert values(columns.normalize_text_case(df, "s", "title"), "s")[0] == "O'Neil Foo-Bar 3Rd"


def test_split_rules(spark):
    df = frame(spark, ["a.b.c", None, "x"], "s string")
    out = columns.split_column(df, "s", ".")
    assert out.columns == ["_row_index", "s", "s_part_1", "s_part_2", "s_part_3"]
    assert values(out, "s_part_1") == ["a", "", "x"]
    assert values(out, "s_part_3") == ["c", None, None]
    with pytest.raises(ParameterError):
        columns.split_column(df, "s", ";")
    with pytest.raises(ParameterError):
        columns.split_column(df, "s", ".", new_columns=["one"])
    assert values(columns.split_column(df, "s", ".", 1), "s_part_2") == ["b.c", None, None]


def test_merge_columns_blank(spark):
    df = frame(spark, [("a ", None), (" ", "b"), (None, None)], "x string, y string")
    assert values(columns.merge_columns(df, ["x", "y"], "z", "-"), "z") == ["a", "b", ""]
    assert values(columns.merge_columns(df, ["x", "y"], "z", "-", skip_null=False), "z") == ["a-", "-b", "-"]


def test_one_hot_names(spark):
    df = frame(spark, ["b", None, "a"], "k string")
    out = columns.encode_categorical(df, "k", "one_hot")
    assert out.columns == ["_row_index", "k_a", "k_b", "k_nan"]
    assert values(out, "k_nan") == [False, True, False]


def test_units(spark):
    df = frame(spark, ["10", "x", None], "v string")
    assert values(columns.unit_convert(df, "v", "kelvin", "f"), "v_f") == pytest.approx([-441.67, None, None])
    assert values(columns.unit_convert(df, "v", "stone", "lbs", overwrite=True), "v") == pytest.approx([140.0, None, None])
    with pytest.raises(ParameterError):
        columns.unit_convert(df, "v", "kg", "m")


def test_category_rules():
    got = binning.category_rules(None, "0-3:toddler\n<0:negative\n>=65:senior\n-inf - -5:x\nbad line")
    assert [(r["min"], r["max"], r["label"]) for r in got] == [
        (0.0, 3.0, "toddler"), (None, 0.0, "negative"), (65.0, None, "senior"), (-math.inf, -5.0, "x"),
    ]
    assert [r["include_max"] for r in got][:2] == [True, False]


def test_formula_rules(spark):
    df = frame(spark, [(7.0, 0.0, "a"), (-7.0, 2.0, None)], "`my col` double, d double, s string")
    assert values(columns.derive_column(df, "r", "`my col` // 2 + `my col` % 4"), "r") == [6.0, -3.0]
    assert values(columns.derive_column(df, "r", "`my col` / d"), "r") == [None, -3.5]
    assert values(columns.derive_column(df, "r", "s != 'a' or not (d > 1)"), "r") == [True, True]
    assert values(columns.derive_column(df, "r", "0 <= d < 1"), "r") == [True, False]
    for bad in ("__import__('os')", "d.__class__", "open('x')", "[x for x in d]", "nothing + 1", "d +"):
        with pytest.raises(ParameterError):
            columns.derive_column(df, "r", bad)


def test_join_null_keys_match(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k long, v string")
    inner = {tuple(r) for r in joins.join_on_keys(a, b, ["k"]).collect()}
    assert inner == {(1, "a", "x"), (None, "n", "y")}
    outer = joins.join_on_keys(a, b, ["k"], join_how="outer")
    assert outer.columns == ["k", "v", "v_src"]
    assert {tuple(r) for r in outer.collect()} == inner | {(2, "b", None), (3, None, "z")}


def test_append_clashing_types(spark):
    a = spark.createDataFrame([(1, 2)], "k long, v int")
    b = spark.createDataFrame([("x", 2.5)], "k string, v double")
    out = joins.append(a, [b])
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["string", "double"]


def test_map_points(spark):
    data = [(1.0, "2", "1"), (95.0, "2", "1"), (1.0, "x", "1"), (-1.0, "180", "Inactive gauge"), (0.0, "0", "offline")]
    df = frame(spark, data, "lat double, lng string, gauge_status string")
    out = aggregate.map_points(df).orderBy("_row_index").collect()
    assert [(r["_row_index"], r["status"]) for r in out] == [(0, "active"), (3, "active"), (4, "defunct")]


def test_rollup_labels(spark):
    df = spark.createDataFrame([(" a ", 1.0), (None, 2.0), ("", 3.0), ("a", None)], "k string, v double")
    got = dict(aggregate.rollup_by_dimensions(df, ["k"], "v", "sum").collect())
    assert got == {"a": 1.0, "Unknown": 5.0}
    assert dict(aggregate.rollup_by_dimensions(df, ["k"], None, "count").collect()) == {"a": 2.0, "Unknown": 2.0}


def test_sum_of_nulls_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", NAN)], "k string, v double")
    out = aggregate.group_aggregate(df, "k", [{"column": "v", "func": "sum"}, {"column": "v", "func": "mean"}])
    assert out.collect()[0].asDict() == {"k": "a", "v_sum": 0.0, "v_mean": None}


def test_date_texts(spark):
    texts = ["2024-01-31", "01/31/2024", "2024/1/31", "1/31/2024 5:06", "2024-01-31T05:06:07", "2024-01-31 05:06", "31/01/2024", "x", None]
    df = frame(spark, texts, "s string")
    got = values(df.withColumn("t", timestamp(df, "s")), "t")
    day = dt.datetime(2024, 1, 31)
    assert got == [day, day, day, day.replace(hour=5, minute=6), day.replace(hour=5, minute=6, second=7), day.replace(hour=5, minute=6), None, None, None]


def test_json_texts(spark):
    df = frame(spark, [' {"a": 1}', "[1", "5", "", None, "[]"], "s string")
    assert values(df.withColumn("j", text_is_json(F.col("s"))), "j") == [True, False, False, False, False, True]


def test_shift_beyond_table(spark):
    df = frame(spark, [1.0, 2.0], "v double")
    assert values(ordered.shift_column(df, "v", shifts=5), "v_shift_down_5") == [None, None]


def test_cyclical_auto(spark):
    df = frame(spark, ["2024-01-01 06:00:00", "2024-01-01 12:00:00"], "s string")
    out = datemath.cyclical_encoding(df, "s", period=24)
    assert values(out, "s_cyclical_sin") == pytest.approx([1.0, 0.0], abs=1e-9)
    with pytest.raises(ParameterError):
        datemath.cyclical_encoding(df, "s", "raw")


def test_index_follows_order(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "v long")
    assert values(with_row_index(df, ["v"]), "v") == [1, 3, None]
