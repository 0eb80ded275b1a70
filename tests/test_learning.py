"""Models, metrics, chunks and streams."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError
from rowloom.learning import metrics, neighbours, train
from rowloom.learning.features import split
from rowloom.operators import ordered, scaling
from rowloom.operators.binning import bin_edges
from rowloom.plans.recipe import Recipe
from rowloom.streaming.apply import prepare_stream, write_stream
from rowloom.textsearch.chunks import chunk_text, split_text


@pytest.fixture(scope="module")
def made(table):
    li = table("lineitem").select("l_quantity", "l_tax", "l_returnflag", "l_linenumber")
    bump = F.when(F.col("l_returnflag") == "A", 10.0).otherwise(0.0)
    y = 3 * F.col("l_quantity") - 50 * F.col("l_tax") + bump
    return li.withColumn("y", y).withColumn("big", F.when(F.col("l_quantity") > 25, "yes").otherwise("no")).withColumn(
        "l_quantity", F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))
    ).filter("l_quantity is not null or l_linenumber = 7")


def test_regression_finds_the_rule(made, tmp_path):
    rows = made.filter("l_linenumber <> 7")
    done = train.train(rows, "y", "linear_regression", ["l_quantity", "l_tax", "l_returnflag"], cross_validation=True, folds=2)
    assert done.metrics["r2"] > 0.999999 and done.metrics["cv_mean_r2"] > 0.999
    assert done.metrics["train_rows"] + done.metrics["test_rows"] == rows.count()
    done.model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    scored = train.score_rows(again, rows.drop("y"), done.features)
    assert scored.filter("prediction is null").count() == 0


@pytest.mark.parametrize("algorithm", ["ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting"])
def test_regressors_beat_the_mean(made, algorithm):
    done = train.train(made, "y", algorithm, ["l_quantity", "l_tax"], {"n_estimators": 10, "alpha": 0.1})
    assert done.metrics["r2"] > 0.5


@pytest.mark.parametrize("algorithm", ["logistic_regression", "decision_tree_classifier", "random_forest_classifier", "gradient_boosting_classifier", "svc"])
def test_classifiers_beat_the_majority(made, algorithm):
    done = train.train(made.filter("l_linenumber <> 7"), "big", algorithm, ["l_quantity", "l_returnflag"], {"n_estimators": 10})
    assert done.metrics["accuracy"] > 0.9
    assert set(done.predictions.select("predicted_class").distinct().toPandas()["predicted_class"]) == {"yes", "no"}


def test_refusals(made):
    with pytest.raises(ParameterError):
        train.train(made, "y", "nothing")
    with pytest.raises(ParameterError):
        train.train(made.limit(5), "y", "ridge")
    with pytest.raises(ParameterError):
        train.train(made, "big", "svc", ["l_tax"], {"kernel": "rbf"})


def test_clusters(spark):
    rng = np.random.default_rng(0)
    points = [(float(x + c * 10), float(y)) for c in range(3) for x, y in rng.normal(size=(50, 2))]
    df = spark.createDataFrame(points, "x double, y double")
    for name in ("kmeans", "agglomerative"):
        done = train.train(df, None, name, params={"n_clusters": 3})
        assert done.metrics["n_clusters"] == 3 and done.metrics["silhouette_score"] > 0.7
        assert 0 < done.metrics["davies_bouldin_score"] < 1


def test_split_of_repeated_rows_is_exact(spark):
    rows = spark.range(1000).selectExpr("case when id % 6 < 4 then 'a' else 'b' end as k", "cast(id % 3 as string) as v", "if(id % 6 = 0, null, 1) as w")
    a, b = split(rows, 0.2)
    assert (a.count(), b.count()) == (800, 200)
    assert a.unionByName(b).exceptAll(rows).isEmpty() and rows.exceptAll(a.unionByName(b)).isEmpty()
    sizes = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    a, b = split(rows, 0.25, stratify="k")
    got = {r["k"]: r["count"] for r in b.groupBy("k").count().collect()}
    assert got == {k: int(n * 0.25 + 0.5) for k, n in sizes.items()} and a.count() + b.count() == 1000
    held = split(rows, 0.2, 3)[1].groupBy("k", "v", "w").count()
    assert held.exceptAll(split(rows.repartition(7), 0.2, 3)[1].groupBy("k", "v", "w").count()).isEmpty()


def test_split_is_exact_and_repeatable(table):
    o = table("orders").select("o_orderkey", "o_orderstatus")
    a, b = split(o, 0.25, 7)
    assert b.count() == -(-o.count() // 4) and a.count() + b.count() == o.count()
    again = split(o.repartition(5), 0.25, 7)[1]
    assert b.exceptAll(again).count() == 0
    assert split(o, 0.25, 8)[1].exceptAll(b).count() > 0


def test_knn_matches_brute_force(table):
    v = table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    base, asked = v.filter("id >= 100"), v.filter("id < 100")
    got = {r["id"]: r["prediction"] for r in neighbours.knn_predict(base, asked, "label", "id", "vec", "regression", 3, "distance").collect()}
    b, a = base.toPandas(), asked.toPandas()
    bm, am = np.stack(b["vec"]).astype(float), np.stack(a["vec"]).astype(float)
    for i, x in zip(a["id"], am):
        gap = np.sqrt(((bm - x) ** 2).sum(axis=1))
        near = np.argsort(gap)[:3]
        w = 1 / gap[near]
        assert got[i] == pytest.approx((w * b["label"].to_numpy()[near]).sum() / w.sum(), rel=1e-6)


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (0, 0)], "label int, prediction int")
    row = metrics.classification_metrics(df).first()
    assert row["accuracy"] == 0.5 and row["precision_macro"] == pytest.approx(0.5 / 3)


def test_mape_skips_zero(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 4.0)], "label double, prediction double")
    assert metrics.regression_metrics(df).first()["mape"] == pytest.approx(25.0)


def test_qq(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "residual double")
    rows = metrics.qq_points(df).orderBy("theoretical").collect()
    assert rows[2]["theoretical"] == pytest.approx(0.0) and rows[2]["sample"] == pytest.approx(0.0)


def test_vif(made):
    df = made.select("l_tax", "y", (F.col("y") * 2).alias("z")).na.drop()
    rows = {r["feature"]: r for r in train.vif_table(df, ["l_tax", "y", "z"]).collect()}
    assert rows["y"]["vif"] is None and rows["y"]["tolerance"] == 0.0 and rows["l_tax"]["vif"] >= 1.0


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 80).astype(float)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "_row_index long, v double")
    table = {r["lag"]: r for r in ordered.kendall_lag_table(df, "v", 1, 3).collect()}
    for k in (1, 2, 3):
        a, b = x[k:], x[:-k]
        sa, sb = np.sign(a[:, None] - a[None, :]), np.sign(b[:, None] - b[None, :])
        tau = (sa * sb).sum() / np.sqrt((sa**2).sum() * (sb**2).sum())
        assert table[k]["tau"] == pytest.approx(tau) and table[k]["pairs"] == len(a)


def test_bins_find_the_step(spark):
    df = spark.createDataFrame([(float(i), "a" if i < 40 else "b", float(i >= 70)) for i in range(100)], "x double, c string, y double")
    for method in ("decision_tree", "mdlp"):
        assert bin_edges(df, "x", method, 2, "c")[1] == 39.5
    assert bin_edges(df, "x", "chimerge", 2, "c")[1] == pytest.approx(39.6, abs=2)
    assert bin_edges(df, "x", "decision_tree", 2, "y")[1] == 69.5


def test_jenks_and_kmeans_find_gaps(spark):
    points = [float(v) for c in (0, 100, 300) for v in range(c, c + 10)]
    df = spark.createDataFrame([(p,) for p in points], "x double")
    assert bin_edges(df, "x", "jenks", 3) == [0.0, 9.0, 109.0, 309.0]
    assert bin_edges(df, "x", "kmeans", 3)[1:3] == pytest.approx([54.5, 204.5])


def test_chunks():
    text = "para one is here.\n\npara two is a little longer than one.\n\n" + "word " * 30
    parts = split_text(text, 40, 10)
    assert all(len(p) <= 40 for p in parts) and parts[0] == "para one is here."
    assert split_text("short", 40, 10) == ["short"]
    assert split_text("x" * 100, 40, 10) == ["x" * 40, "x" * 40, "x" * 40]
    assert split_text("a b c d e f", 5, 2) == ["a b c", "c d", "d e", "e f"]


def test_chunks_cover_whole_texts(table):
    d = table("documents").select("doc_id", "text")
    out = chunk_text(d, "text", 200, 40)
    assert out.agg(F.max(F.length("chunk"))).first()[0] <= 200
    words = d.select("doc_id", F.explode(F.split(F.trim("text"), r"\s+")).alias("w")).filter("w <> '' and length(w) < 150").distinct()
    kept = out.select("doc_id", F.explode(F.split("chunk", r"\s+")).alias("w")).distinct()
    assert words.exceptAll(kept).count() == 0


def test_stream_runs_row_steps(spark, table, tmp_path):
    e = table("events")
    e.write.parquet(str(tmp_path / "in"))
    fitted = scaling.fit_scaler(e, "z_score_scaling", "value")
    stored = scaling.Scaler.from_dict(fitted.to_dict())
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    plan = Recipe.of(
        ("delete_rows_condition", {"column": "event_type", "condition": "eq", "value": "error"}),
        ("extract_date_part", {"column": "ts", "part": "hour"}),
        ("bin_numeric_categories", {"column": "value", "rules_text": "<1:low\n>=1:high"}),
    )
    out = prepare_stream(stream, plan, [stored])
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = stored.apply(plan.apply(e))
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()
    with pytest.raises(ParameterError):
        Recipe.of(("fill_missing", {"strategy": "ffill"})).apply(stream)
    with pytest.raises(ParameterError):
        Recipe.of(("stats_std", {"column": "value"})).apply(stream)


def brute_dbscan(ids, points, eps, least):
    near = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    root = {i: i for i in range(len(ids)) if core[i]}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in root:
        for j in np.flatnonzero(near[i] & core):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
    order = {r: k for k, r in enumerate(sorted({find(i) for i in root}))}
    out = []
    for i in range(len(ids)):
        if core[i]:
            out.append(order[find(i)])
        else:
            reach = [order[find(int(j))] for j in np.flatnonzero(near[i] & core)]
            out.append(min(reach) if reach else -1)
    return dict(zip(ids, out))


@pytest.mark.parametrize(("dims", "eps", "least"), [(2, 0.35, 5), (2, 1.2, 8), (1, 0.05, 4), (3, 0.8, 5)])
def test_dbscan_matches_brute_force(spark, dims, eps, least):
    from rowloom.learning.dbscan import dbscan

    rng = np.random.default_rng(dims)
    points = np.concatenate([rng.normal(c, 0.6, (120, dims)) for c in (0, 3, 6)] + [rng.uniform(-3, 9, (60, dims)), np.zeros((40, dims))])
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    names = [f"p{i}" for i in range(dims)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["cluster"] for r in dbscan(df, names, "id", eps, least).collect()}
    assert got == brute_dbscan(list(range(len(points))), points, eps, least)
