"""Learning, text chunks, vectors and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.learning import metrics, neighbours, train
from rowloom.learning.dbscan import dbscan
from rowloom.learning.features import split
from rowloom.operators.ordering import with_row_index
from rowloom.plans.recipe import History, Recipe
from rowloom.queries.book import query, r6
from rowloom.textsearch import chunks, vectors

FAST = {"n_estimators": 10, "max_depth": 4, "max_iter": 20}


def _metric_rows(done):
    spark = done.predictions.sparkSession
    rows = [(k, float(v)) for k, v in sorted(done.metrics.items()) if v is not None]
    return spark.createDataFrame(rows, "metric string, value double")


def _regress(name, algorithm):
    @query(name)
    def f(t):
        li = t("lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")
        return _metric_rows(train.train(li, "l_extendedprice", algorithm, params=FAST))


for _n, _a in (
    ("l1_linear_regression", "linear_regression"),
    ("l2_ridge", "ridge"),
    ("l3_lasso", "lasso"),
    ("l4_elastic_net", "elastic_net"),
    ("l5_random_forest", "random_forest"),
    ("l6_gradient_boosting", "gradient_boosting"),
):
    _regress(_n, _a)


def _labelled(t):
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "n_chars", "lang", "source", F.length("text").alias("length"), "quality")


def _classify(name, algorithm):
    @query(name)
    def f(t):
        return _metric_rows(train.train(_labelled(t), "quality", algorithm, ["n_chars", "lang", "source", "length"], FAST))


for _n, _a in (
    ("l5_random_forest_classifier", "random_forest_classifier"),
    ("l6_gradient_boosting_classifier", "gradient_boosting_classifier"),
    ("l8_logistic_regression", "logistic_regression"),
    ("l9_decision_tree_classifier", "decision_tree_classifier"),
    ("l10_svc", "svc"),
):
    _classify(_n, _a)


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query(
    "l7_knn_classifier",
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
            n AS (SELECT q.id, b.label, row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.e, b.e), 9), b.id) AS k
                  FROM v q JOIN v b ON q.id % 5 = 0 AND b.id % 5 <> 0),
            c AS (SELECT id, label, count(*) AS votes FROM n WHERE k <= 5 GROUP BY ALL)
       SELECT id, label AS prediction FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) = 1""",
)
def l7(t):
    v = _vectors(t)
    return neighbours.knn_predict(v.filter("id % 5 <> 0"), v.filter("id % 5 = 0"), "label", "id", "vec")


@query(
    "l7_knn_regressor",
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings),
            n AS (SELECT q.id, b.label, row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.e, b.e), 9), b.id) AS k
                  FROM v q JOIN v b ON q.id % 5 = 0 AND b.id % 5 <> 0)
       SELECT id, round(avg(label), 6) AS prediction FROM n WHERE k <= 7 GROUP BY id""",
)
def l7_regressor(t):
    v = _vectors(t)
    out = neighbours.knn_predict(v.filter("id % 5 <> 0"), v.filter("id % 5 = 0"), "label", "id", "vec", "regression", 7)
    return out.select("id", r6("prediction").alias("prediction"))


def _clusters(name, algorithm, k):
    @query(name)
    def f(t):
        c = t("customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
        return _metric_rows(train.train(c, None, algorithm, params={"n_clusters": k}))


_clusters("l11_kmeans", "kmeans", 4)
_clusters("l13_agglomerative", "agglomerative", 4)


@query("l12_dbscan")
def l12(t):
    """Density clusters of part size and price; checked against brute force in the tests."""
    p = t("part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") / 20).alias("price"))
    return dbscan(p, ["size", "price"], "p_partkey", 1.5, 4).select(F.col("id").alias("p_partkey"), "cluster", "core")


@query("l14_cross_validation")
def l14(t):
    li = t("lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return _metric_rows(train.train(li, "l_extendedprice", "linear_regression", cross_validation=True, folds=3))


PREDICTIONS = "(SELECT l_extendedprice AS label, l_quantity * 1500 AS prediction FROM lineitem)"


@query(
    "l15_regression_metrics",
    f"""SELECT round(1 - sum((label - prediction) ** 2) / (var_pop(label) * count(*)), 6) + 0 AS r2,
               round(1 - (sum((label - prediction) ** 2) / (var_pop(label) * count(*))) * (count(*) - 1) / (count(*) - 4), 6) + 0 AS adjusted_r2,
               round(avg(abs(label - prediction)), 4) AS mae, round(avg((label - prediction) ** 2) / 1000, 4) AS mse,
               round(sqrt(avg((label - prediction) ** 2)), 4) AS rmse,
               round(avg(abs((label - prediction) / nullif(label, 0))) * 100, 4) AS mape FROM {PREDICTIONS}""",
)
def l15(t):
    p = t("lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    out = metrics.regression_metrics(p, features=3)
    return out.select(
        r6("r2").alias("r2"), r6("adjusted_r2").alias("adjusted_r2"), F.round("mae", 4).alias("mae"),
        F.round(F.col("mse") / 1000, 4).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("mape", 4).alias("mape"),
    )


def _said(t):
    return t("orders").select(
        F.col("o_orderpriority").substr(1, 1).cast("int").alias("label"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("prediction"),
    )


SAID = "(SELECT CAST(o_orderpriority[1] AS INT) AS label, CAST(o_orderkey % 3 + 1 AS INT) AS prediction FROM orders)"


@query(
    "l16_classification_metrics",
    f"""WITH p AS {SAID}, c AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT prediction FROM p),
             s AS (SELECT c, count(*) FILTER (label = c) AS a, count(*) FILTER (prediction = c) AS s,
                          count(*) FILTER (label = c AND prediction = c) AS h FROM c, p GROUP BY c)
        SELECT round(sum(h) / sum(a), 6) AS accuracy, round(avg(CASE WHEN s > 0 THEN h / s ELSE 0 END), 6) AS precision_macro,
               round(avg(CASE WHEN a > 0 THEN h / a ELSE 0 END), 6) AS recall_macro,
               round(avg(CASE WHEN a + s > 0 THEN 2.0 * h / (a + s) ELSE 0 END), 6) AS f1_macro FROM s""",
)
def l16(t):
    out = metrics.classification_metrics(_said(t))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("l16_confusion_matrix", f"SELECT label, prediction, count(*) AS n FROM {SAID} GROUP BY ALL")
def l16_confusion(t):
    return metrics.confusion(_said(t))


@query("l17_clustering_metrics")
def l17(t):
    c = t("customer").select("c_acctbal", "c_nationkey")
    return _metric_rows(train.train(c, None, "kmeans", params={"n_clusters": 3}))


@query(
    "l18_residual_points",
    """SELECT l_extendedprice AS actual, l_quantity * 1500 AS predicted, round(l_extendedprice - l_quantity * 1500, 6) AS residual FROM lineitem
       ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate LIMIT 200""",
)
def l18(t):
    p = t("lineitem").withColumns({"label": F.col("l_extendedprice"), "prediction": F.col("l_quantity") * 1500})
    out = metrics.residual_points(p, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    return out.select("actual", "predicted", r6("residual").alias("residual"))


@query(
    "l19_feature_importance",
    """SELECT 'l_quantity' AS feature, round(abs(corr(l_quantity, l_extendedprice)), 6) AS importance FROM lineitem UNION ALL
       SELECT 'l_discount', round(abs(corr(l_discount, l_extendedprice)), 6) FROM lineitem UNION ALL
       SELECT 'l_tax', round(abs(corr(l_tax, l_extendedprice)), 6) FROM lineitem""",
)
def l19(t):
    rows = train.correlation_importance(t("lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    out = t("lineitem").sparkSession.createDataFrame([(r["feature"], r["importance"]) for r in rows], "feature string, importance double")
    return out.select("feature", r6("importance").alias("importance"))


@query(
    "l20_vif_table",
    """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
       SELECT f AS feature, round(1 / (1 - r * r), 6) AS vif, round(1 - r * r, 6) AS tolerance
       FROM r, (VALUES ('l_quantity'), ('l_extendedprice')) v(f)""",
)
def l20(t):
    out = train.vif_table(t("lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select("feature", r6("vif").alias("vif"), r6("tolerance").alias("tolerance"))


@query("l21_batch_scoring")
def l21(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    features = ["l_quantity", "l_discount", "l_tax"]
    done = train.train(li, "l_extendedprice", "linear_regression", features)
    return train.score_rows(done.model, li, features).select("l_orderkey", "l_linenumber", F.round("prediction", 3).alias("prediction"))


@query(
    "l22_compare_models",
    f"""WITH a AS (SELECT avg(abs(l_extendedprice - l_quantity * 1500)) AS mae, corr(l_quantity * 1500, l_extendedprice) AS r FROM lineitem),
             b AS (SELECT avg(abs(l_extendedprice - l_quantity * 1400)) AS mae, corr(l_quantity * 1500, l_extendedprice) AS r FROM lineitem)
        SELECT 'mae' AS metric, CASE WHEN a.mae < b.mae THEN 'left' ELSE 'right' END AS winner FROM a, b
        UNION ALL SELECT 'fit', 'tie' UNION ALL SELECT 'only_left', 'n/a'""",
)
def l22(t):
    li = t("lineitem")

    def table(k, extra):
        e = F.col("l_extendedprice") - F.col("l_quantity") * k
        wide = li.agg(F.avg(F.abs(e)).alias("mae"), F.corr("l_quantity", "l_extendedprice").alias("fit"), *extra)
        return metrics.long_form(wide)

    out = metrics.compare_metrics(table(1500, [F.count("*").alias("only_left")]), table(1400, []), ["mae"])
    return out.select("metric", "winner")


@query("l23_sweep")
def l23(t):
    li = t("lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return train.sweep(li, "l_extendedprice", algorithms=["linear_regression", "ridge"], folds=2)


@query("l24_suggest_task")
def l24(t):
    from rowloom.operators.profile import profile

    c = t("customer")
    task = train.suggest_task(c, profile(c))
    rows = [("target", task["target"]), ("problem", task["problem"]), ("algorithm", task["algorithm"])]
    rows += [("feature", f) for f in task["features"]]
    return c.sparkSession.createDataFrame(rows, "kind string, name string")


@query(
    "l_train_test_split",
    """SELECT o_orderpriority, count(*) - CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS train, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS test
       FROM orders GROUP BY 1""",
)
def l_split(t):
    o = t("orders").select("o_orderkey", "o_orderpriority")
    a, b = split(o, 0.2, 42, "o_orderpriority")
    both = a.withColumn("k", F.lit("train")).unionByName(b.withColumn("k", F.lit("test")))
    return both.groupBy("o_orderpriority").agg(
        F.count(F.when(F.col("k") == "train", 1)).alias("train"), F.count(F.when(F.col("k") == "test", 1)).alias("test")
    )


@query(
    "l_train_test_split_repeated",
    """SELECT l_returnflag, count(*) - CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS train, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS test
       FROM lineitem GROUP BY 1""",
)
def l_split_repeated(t):
    a, b = split(t("lineitem").select("l_returnflag", "l_linestatus"), 0.2, 42, "l_returnflag")
    both = a.withColumn("k", F.lit("train")).unionByName(b.withColumn("k", F.lit("test")))
    return both.groupBy("l_returnflag").agg(
        F.count(F.when(F.col("k") == "train", 1)).alias("train"), F.count(F.when(F.col("k") == "test", 1)).alias("test")
    )


# ---- text and vectors --------------------------------------------------------


@query("m1_chunk_text")
def m1(t):
    return chunks.chunk_text(t("documents").select("doc_id", "text"))


@query(
    "m2_attach_metadata",
    """SELECT doc_id, lang, 'batch-1' AS source, source AS was FROM documents""",
)
def m2(t):
    d = t("documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("was"), "source").alias("metadata"))
    d = chunks.attach_metadata(d, {"source": "batch-1"})
    return d.select("doc_id", *[F.col("metadata")[k].alias(k) for k in ("lang", "source", "was")])


def _store(t):
    return t("embeddings").select(
        F.col("vec_id").alias("id"),
        "embedding",
        F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("filename"), F.concat(F.lit("f"), F.col("label"))).alias("metadata"),
    )


@query(
    "m3_vector_search",
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7)
       SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q
       WHERE list_cosine_similarity(embedding::DOUBLE[], e) >= -1 AND label <> 99 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def m3(t):
    s = _store(t)
    q = s.filter("id = 7").first()["embedding"]
    out = vectors.vector_search(s, q, 5, threshold=0.0)
    return out.select("id", r6("score").alias("score"))


@query(
    "m3_vector_search_filtered",
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7),
            s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], e) AS c FROM embeddings, q WHERE label = 3 ORDER BY c DESC, id LIMIT 8)
       SELECT id, round(CASE WHEN c >= 0 THEN c ELSE 1 / (2 - c) END, 6) AS score FROM s WHERE CASE WHEN c >= 0 THEN c ELSE 1 / (2 - c) END >= 0.1""",
)
def m3_filtered(t):
    s = _store(t)
    q = s.filter("id = 7").first()["embedding"]
    out = vectors.vector_search(s, q, 8, threshold=0.1, filters={"label": 3})
    return out.select("id", r6("score").alias("score"))


@query(
    "m3_vector_search_many",
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)
       SELECT q.id AS query_id, b.id AS base_id FROM v q JOIN v b ON q.label = 1 AND b.label <> 1
       QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_distance(q.e, b.e), 9), b.id) <= 3""",
)
def m3_many(t):
    v = _vectors(t)
    return vectors.nearest(v.filter("label = 1"), v.filter("label <> 1"), 3).select("query_id", "base_id")


@query(
    "m4_delete_vectors",
    """SELECT vec_id AS id FROM embeddings WHERE vec_id % 10 <> 3 AND label <> 2 AND label NOT IN (4, 5)""",
)
def m4(t):
    s = _store(t)
    s = vectors.delete_by_ids(s, t("embeddings").filter("vec_id % 10 = 3").select("vec_id"))
    s = vectors.delete_by_metadata(s, {"label": 2})
    return vectors.delete_by_filenames(s, ["f4", "f5"]).select("id")


# ---- recipes -----------------------------------------------------------------

REVENUE = Recipe.of(
    ("delete_rows_condition", {"column": "l_quantity", "condition": "lt", "value": 5}),
    ("derive_column", {"new_name": "revenue", "expression": "l_extendedprice * (1 - l_discount)"}),
    (
        "group_aggregate",
        {
            "group_by": ["l_returnflag", "l_linestatus"],
            "aggregations": [
                {"column": "revenue", "func": "sum", "alias": "revenue"},
                {"column": "l_quantity", "func": "mean", "alias": "avg_qty"},
                {"column": "l_orderkey", "func": "nunique", "alias": "orders"},
                {"column": "l_quantity", "func": "count", "alias": "lines"},
            ],
        },
    ),
    ("sort_rows", {"column": "revenue", "ascending": False}),
    name="Revenue by flag",
)


@query(
    "n1_recipe_apply",
    """WITH g AS (SELECT l_returnflag, l_linestatus, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_quantity) AS avg_qty,
                         count(DISTINCT l_orderkey) AS orders, count(*) AS lines FROM lineitem WHERE l_quantity >= 5 GROUP BY ALL)
       SELECT row_number() OVER (ORDER BY revenue DESC) - 1 AS _row_index, l_returnflag, l_linestatus, round(revenue, 4) AS revenue,
              round(avg_qty, 6) AS avg_qty, orders, lines FROM g""",
)
def n1(t):
    out = REVENUE.apply(t("lineitem"))
    return out.select("_row_index", "l_returnflag", "l_linestatus", F.round("revenue", 4).alias("revenue"), r6("avg_qty").alias("avg_qty"), "orders", "lines")


@query(
    "n2_recipe_dry_run",
    """SELECT event_id, value * 2 AS twice FROM (SELECT *, row_number() OVER (ORDER BY ts) AS k FROM events)
       WHERE k <= 50 AND value > 1""",
)
def n2(t):
    e = with_row_index(t("events").select("event_id", "ts", "value"), ["ts"])
    plan = Recipe.of(
        ("delete_rows_condition", {"column": "value", "condition": "<=", "value": 1}),
        ("math_scalar", {"column": "value", "operator": "multiply", "value": 2, "new_name": "twice"}),
    )
    shown = plan.dry_run(e, 50)["preview"]
    return e.sparkSession.createDataFrame([(r["event_id"], r["twice"]) for r in shown], "event_id long, twice double")


@query(
    "n3_n5_loose_plan",
    """SELECT event_id, upper(event_type) AS event_type, lag(value) OVER (ORDER BY ts) AS before FROM events WHERE user_id <> 7""",
)
def n3(t):
    plan = {
        "name": "loose",
        "steps": [
            {"op": "delete_rows_condition", "arguments": {"column": "#User ID", "condition": "==", "value": "7"}},
            {"operation": "normalize_text_case", "params": {"case": "upper"}, "description": "the event type in upper case"},
            {"operation": "column_shift", "params": {"column": "VALUE", "new_name": "before"}},
        ],
    }
    e = with_row_index(t("events"), ["ts"])
    return Recipe.from_dict(plan).enrich(e).apply(e).select("event_id", "event_type", "before")


@query(
    "n6_history",
    """SELECT event_id, value FROM events WHERE value > 1 AND event_type <> 'error'""",
)
def n6(t):
    h = History(t("events").select("event_id", "value", "event_type"), depth=2)
    h.do("delete_rows_condition", column="value", condition="<=", value=1)
    h.do("delete_rows_condition", column="event_type", condition="eq", value="error")
    h.checkpoint("clean")
    h.do("rename_column", column="value", new_name="v")
    h.undo()
    h.redo()
    return h.restore("clean").select("event_id", "value")


@query(
    "n6_history_folded",
    """WITH kept AS (SELECT event_id, ts, value FROM events WHERE value > 1 AND event_type <> 'error'),
            moved AS (SELECT event_id, value, lag(value) OVER (ORDER BY ts) AS value_shift_down_1,
                             row_number() OVER (ORDER BY ts) AS k FROM kept)
       SELECT event_id, value, value_shift_down_1 FROM moved WHERE k NOT IN (1, 101)""",
)
def n6_folded(t):
    """The first two steps are folded into the base before the later ones follow the row order."""
    h = History(with_row_index(t("events").select("event_id", "ts", "value", "event_type"), ["ts"]), depth=2)
    h.do("delete_rows_condition", column="value", condition="<=", value=1)
    h.do("delete_rows_condition", column="event_type", condition="eq", value="error")
    h.do("shift_column", column="value", direction="down", shifts=1)
    h.do("delete_rows", row_indices=[0, 100])
    return h.current().select("event_id", "value", "value_shift_down_1")
