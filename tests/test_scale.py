"""The ways taken on big tables give the same answers, and plans keep shape."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.functions.quantiles import exact_quantiles, grouped_quantile
from rowloom.operators import columns, ordered, rows, skew
from rowloom.operators.ordering import carried_fill, reindex, running_total, with_row_index
from rowloom.session import materialize
from rowloom.textsearch import vectors
from rowloom.textsearch.vectors import nearest


@pytest.fixture(scope="module")
def skewed(table):
    hot = F.when(F.col("l_linenumber") <= 3, F.lit(7.0)).otherwise(F.col("l_extendedprice"))
    two = F.when(F.col("l_orderkey") % 2 == 0, 1.0).otherwise(2.0)
    return table("lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice", hot.alias("hot"), two.alias("two")).cache()


@pytest.mark.parametrize("points", [[0.25, 0.5, 0.75], [0.0, 1.0], np.linspace(0, 1, 41).tolist()])
def test_quantiles_of_big_columns(skewed, points):
    names = ["l_quantity", "l_extendedprice", "hot", "two"]
    small = exact_quantiles(skewed, names, points)
    big = exact_quantiles(skewed, names, points, direct_rows=0, listed=40, accuracy=50)
    for c in names:
        np.testing.assert_allclose(big[c], small[c], rtol=1e-12)


def test_quantiles_of_big_groups(skewed):
    got = dict(grouped_quantile(skewed, ["l_returnflag"], F.col("hot"), 0.3, "q").collect())
    want = dict(skewed.groupBy("l_returnflag").agg(F.percentile("hot", F.lit(0.3)).alias("q")).collect())
    assert got == pytest.approx(want)


def test_lookup_with_hot_keys(skewed, monkeypatch):
    counted = skewed.groupBy("hot").agg(F.count("*").alias("n")).withColumn("tag", F.col("hot") * 2)
    df = skewed.select(
        "l_orderkey",
        F.when(F.col("l_orderkey") % 5 != 0, F.col("hot")).alias("hot"),
        F.create_map(F.lit("q"), "l_quantity").alias("m"),
    )
    want = sorted((r["l_orderkey"], r["hot"], r["hot"] and r["hot"] * 2) for r in df.collect() if r["hot"] is not None)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    got = skew.lookup(df, "hot", counted, ["tag"], "n")
    assert got.count() == df.count()
    assert sorted(tuple(r) for r in got.filter("hot is not null").drop("m").collect()) == want


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_partitions_do_not_matter(table, parts):
    e = table("events").select("event_id", "ts", "value").repartition(parts)
    i = with_row_index(e, ["ts"])
    out = ordered.shift_column(i, "value", shifts=3)
    first = {r["event_id"]: r["value_shift_down_3"] for r in out.collect()}
    rows_ = table("events").orderBy("ts").select("event_id", "value").collect()
    assert first == {r["event_id"]: rows_[k - 3]["value"] if k >= 3 else None for k, r in enumerate(rows_)}


@pytest.mark.parametrize("size", [4, 50, 10_000])
def test_buckets_do_not_matter(table, size):
    e = with_row_index(table("events").select("event_id", "ts", F.when(F.col("event_id") % 9 == 0, F.col("value")).alias("v")), ["ts"])
    plain = [r["v"] for r in e.orderBy("_row_index").collect()]
    for back in (False, True):
        got = [r["v"] for r in carried_fill(e, {"v": F.col("v")}, back, size).orderBy("_row_index").collect()]
        want, held = [], None
        for x in reversed(plain) if back else plain:
            held = x if x is not None else held
            want.append(held)
        assert got == (want[::-1] if back else want)
    kept = e.filter("event_id % 3 = 1")
    dense = reindex(kept, size=size).orderBy("_row_index").collect()
    assert [r["_row_index"] for r in dense] == list(range(len(dense)))
    assert [r["event_id"] for r in dense] == [r["event_id"] for r in kept.orderBy("_row_index").collect()]


def test_running_total(skewed):
    counted = skewed.groupBy("l_quantity").agg(F.count("*").alias("n"))
    got = running_total(counted, "n", ["l_quantity"], "before").orderBy("l_quantity").collect()
    seen = 0
    for r in got:
        assert r["before"] == seen
        seen += r["n"]


def test_nearest_ways_agree(table):
    v = table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q, b = v.filter("id % 3 = 0"), v.filter("id % 3 <> 0")

    def run(**size):
        return sorted((r[0], r[1], round(r[2], 9)) for r in nearest(q, b, 4, "euclidean", **size).collect())

    streamed = run()
    assert run(held_cells=200 * 64) == streamed  # queries too many, base too many: blocks
    assert run(held_cells=64, block_cells=64 * 30) == streamed
    base_held = sorted((r[0], r[1], round(r[2], 9)) for r in nearest(v, b.filter("id < 60"), 4, "euclidean", held_cells=64 * 100).collect())
    full = sorted((r[0], r[1], round(r[2], 9)) for r in nearest(v, b.filter("id < 60"), 4, "euclidean").collect())
    assert base_held == full


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_reaches_the_scan(table):
    df = rows.delete_rows_condition(table("lineitem"), "l_linenumber", ">", 3).select("l_orderkey")
    text = plan(df)
    assert "LessThanOrEqual(l_linenumber,3)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text


def test_no_python_and_no_single_task_window(table):
    e = with_row_index(table("events"), ["ts"])
    out = ordered.rolling_window_stats_nested(e, "value", [5], "mean,std,kurt,median,slope")
    text = plan(out)
    assert "EvalPython" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Window [" in text and "__bucket" in text.split("Window [")[1]


def test_page_is_a_filter(table):
    from rowloom.sources.tables import read_page

    stored = materialize(with_row_index(table("orders").select("o_orderkey"), ["o_orderkey"]))
    text = plan(read_page(stored, 10, 5))
    assert "Sort" not in text and "GreaterThanOrEqual(_row_index,5)" in text


def test_label_encoding_of_many_values(table, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    c = table("customer").select("c_custkey", "c_name")
    got = columns.encode_label(c, "c_name").orderBy("c_custkey").collect()
    names = sorted(r["c_name"] for r in c.collect())
    want = [names.index(r["c_name"]) for r in c.orderBy("c_custkey").collect()]
    assert [r["c_name"] for r in got] == want


def test_hits_of_many_rows_need_no_whole_distance_matrix():
    """Tiles bound the memory: 4 000 queries by 30 000 rows would be 960 MB of distances."""
    rng = np.random.default_rng(1)
    queries, base = rng.integers(0, 4, (4000, 3)).astype(float), rng.integers(0, 4, (30000, 3)).astype(float)
    ids = rng.permutation(30000)
    base[7] = np.nan
    tracemalloc.start()
    hits = vectors.Hits(np.arange(4000), queries, 4, "euclidean")
    for at in (0, 1, 9000):  # rows arrive in batches, one of them shorter than k
        hits.meet(ids[at : {0: 1, 1: 9000}.get(at, 30000)], base[at : {0: 1, 1: 9000}.get(at, 30000)])
    out = pd.concat(hits.frames())
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    for q in range(0, 4000, 400):
        gap = np.nan_to_num(np.sqrt(((base - queries[q]) ** 2).sum(axis=1)), nan=np.inf)
        order = np.lexsort((ids, gap))[:4]
        mine = out[out["query_id"] == q]
        assert mine["base_id"].tolist() == ids[order].tolist() and np.allclose(mine["distance"], gap[order])


def test_hits_of_fewer_rows_than_asked():
    hits = vectors.Hits(np.array([5]), np.array([[1.0, 0.0]]), 4, "cosine")
    hits.meet(np.array([9, 3]), np.array([[0.0, 0.0], [0.0, 0.0]]))
    assert pd.concat(hits.frames())["base_id"].tolist() == [3, 9]  # no angle: last, but still rows
