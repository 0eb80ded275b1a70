"""Algorithms by name, training, cross-validation, scoring and sweeps."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions.correlation import pair_correlations
from rowloom.functions.guards import ParameterError, data_columns, is_number, number, quoted, require, type_of
from rowloom.learning.cells import fit_by_cells
from rowloom.learning.features import MAX_CATEGORIES, clean_target, feature_pipeline, split
from rowloom.learning.metrics import classification_metrics, davies_bouldin, regression_metrics

TREE_DEPTH_LIMIT = 30


def _depth(params: dict[str, Any], default: int) -> int:
    raw = params.get("max_depth", default)
    return min(TREE_DEPTH_LIMIT, default if raw in (None, "") else int(raw))


def _forest(kind, p: dict[str, Any]):
    return kind(
        numTrees=int(p.get("n_estimators", 200)),
        maxDepth=_depth(p, 10),
        minInstancesPerNode=max(1, int(p.get("min_samples_split", 2)) // 2),
        seed=42,
    )


def _boosting(kind, p: dict[str, Any]):
    return kind(
        maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)), maxDepth=_depth(p, 3), seed=42
    )


def _linear(p: dict[str, Any], strength: float, mix: float):
    return LinearRegression(
        regParam=strength,
        elasticNetParam=mix,
        standardization=False,
        fitIntercept=bool(p.get("fit_intercept", True)),
        maxIter=int(p.get("max_iter", 1000)),
    )


# name -> (problem, builder(parameters, training rows, classes))
ALGORITHMS = {
    "linear_regression": ("regression", lambda p, n, k: _linear(p, 0.0, 0.0)),
    "ridge": ("regression", lambda p, n, k: _linear(p, float(p.get("alpha", 1.0)) / max(1, n), 0.0)),
    "lasso": ("regression", lambda p, n, k: _linear(p, float(p.get("alpha", 1.0)), 1.0)),
    "elastic_net": (
        "regression",
        lambda p, n, k: _linear(p, float(p.get("alpha", 1.0)), float(p.get("l1_ratio", 0.5))),
    ),
    "random_forest": ("regression", lambda p, n, k: _forest(RandomForestRegressor, p)),
    "gradient_boosting": ("regression", lambda p, n, k: _boosting(GBTRegressor, p)),
    "logistic_regression": (
        "classification",
        lambda p, n, k: LogisticRegression(
            regParam=1.0 / (float(p.get("C", 1.0)) * max(1, n)), maxIter=int(p.get("max_iter", 1000)), standardization=False
        ),
    ),
    "decision_tree_classifier": (
        "classification",
        lambda p, n, k: DecisionTreeClassifier(maxDepth=_depth(p, 10), impurity=str(p.get("criterion", "gini")), seed=42),
    ),
    "random_forest_classifier": ("classification", lambda p, n, k: _forest(RandomForestClassifier, p)),
    "gradient_boosting_classifier": (
        "classification",
        lambda p, n, k: _boosting(GBTClassifier, p) if k <= 2 else OneVsRest(classifier=_boosting(GBTClassifier, p)),
    ),
    "svc": (
        "classification",
        lambda p, n, k: _svc(p, n) if k <= 2 else OneVsRest(classifier=_svc(p, n)),
    ),
    "kmeans": (
        "clustering",
        lambda p, n, k: KMeans(k=int(p.get("n_clusters", 3)), maxIter=int(p.get("max_iter", 300)), seed=42),
    ),
    "agglomerative": ("clustering", lambda p, n, k: BisectingKMeans(k=int(p.get("n_clusters", 3)), seed=42)),
}


def _svc(p: dict[str, Any], n: int) -> LinearSVC:
    if str(p.get("kernel", "linear")) != "linear":
        raise ParameterError("only the linear kernel is available")
    return LinearSVC(regParam=1.0 / (float(p.get("C", 1.0)) * max(1, n)), maxIter=int(p.get("max_iter", 100)))


@dataclass
class Trained:
    algorithm: str
    problem: str
    features: list[str]
    target: str | None
    model: PipelineModel
    predictions: DataFrame
    metrics: dict[str, Any] = field(default_factory=dict)
    importance: list[dict[str, Any]] = field(default_factory=list)


def train(
    df: DataFrame,
    target: str | None,
    algorithm: str,
    features: list[str] | None = None,
    params: dict[str, Any] | None = None,
    test_size: float = 0.2,
    random_state: int = 42,
    cross_validation: bool = False,
    folds: int = 5,
) -> Trained:
    """Fit one algorithm and score it on the held-out rows."""
    if algorithm not in ALGORITHMS:
        raise ParameterError(f"unknown algorithm {algorithm!r}")
    problem, build = ALGORITHMS[algorithm]
    names = features or [c for c in data_columns(df) if c != target]
    for c in names:
        require(df, c, "feature")
    if not names:
        raise ParameterError("no features")
    if problem == "clustering":
        return _cluster(df.select(*[quoted(c) for c in names]), algorithm, build(params or {}, 0, 0), names)
    narrow = df.select(*[quoted(c) for c in dict.fromkeys([*names, target])])
    held = clean_target(narrow, target, problem)
    train_rows, test_rows = split(held, test_size, random_state, "__class" if problem == "classification" else None)
    n = train_rows.count()
    stages = list(feature_pipeline(train_rows, names).getStages())
    classes = 0
    if problem == "classification":
        found = held.agg(F.approx_count_distinct("__class").alias("n")).first()["n"]
        if found > MAX_CATEGORIES:
            raise ParameterError(f"the target has over {MAX_CATEGORIES} classes")
        indexer = StringIndexer(inputCol="__class", outputCol="label", handleInvalid="error", stringOrderType="alphabetAsc")
        fitted = indexer.fit(held.select("__class"))
        classes = len(fitted.labels)
        if classes < 2:
            raise ParameterError("the target has a single class")
        stages = [fitted, *stages]
    estimator = build(params or {}, n, classes)
    prepared = Pipeline(stages=stages).fit(train_rows)
    ready = prepared.transform(spread(train_rows)).select("features", "label")
    by_cells = fit_by_cells(estimator, prepared, train_rows, n) if isinstance(estimator, GBTRegressor) else None
    last = by_cells or [estimator.fit(ready)]
    fit = last[-1]
    model = PipelineModel(stages=[s for s in prepared.stages if s is not (fitted if classes else None)] + last)
    labelled = prepared.stages[0].transform(test_rows) if classes else test_rows
    predictions = model.transform(labelled)
    if classes:
        named = IndexToString(inputCol="prediction", outputCol="predicted_class", labels=fitted.labels)
        model = PipelineModel(stages=[*model.stages, named])
        predictions = named.transform(predictions)
        metrics = classification_metrics(predictions).first().asDict()
    else:
        metrics = regression_metrics(predictions, features=len(names)).first().asDict()
    metrics.update(train_rows=n, test_rows=test_rows.count())
    if cross_validation:
        metrics.update(cross_validate(estimator, ready, problem, max(2, min(int(folds or 2), n)), random_state))
    return Trained(
        algorithm, problem, names, target, model, predictions, metrics,
        importance(fit, prepared.transform(train_rows.limit(1)).schema["features"].metadata)
        or correlation_importance(prepared.transform(train_rows), names),
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of few partitions out to all cores before many passes.

    A large table has partitions enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cross_validate(estimator, ready: DataFrame, problem: str, folds: int, seed: int = 42) -> dict[str, Any]:
    """Mean and spread of r2 or accuracy over the folds."""
    score = "r2" if problem == "regression" else "accuracy"
    evaluator = (
        RegressionEvaluator(metricName="r2") if problem == "regression" else MulticlassClassificationEvaluator(metricName="accuracy")
    )
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=ParamGridBuilder().build(), evaluator=evaluator, numFolds=folds, seed=seed,
        parallelism=2,
    )
    fitted = cv.fit(ready)
    return {"cv_folds": folds, f"cv_mean_{score}": float(fitted.avgMetrics[0]), f"cv_std_{score}": float(fitted.stdMetrics[0])}


def _cluster(df: DataFrame, algorithm: str, estimator, names: list[str]) -> Trained:
    prepared = feature_pipeline(df, names).fit(df)
    ready = prepared.transform(spread(df))
    fit = estimator.fit(ready.select("features"))
    predictions = fit.transform(ready)
    found = predictions.select("prediction").distinct().count()
    metrics: dict[str, Any] = {"n_clusters": found, "train_rows": df.count()}
    if found >= 2:
        metrics["silhouette_score"] = ClusteringEvaluator().evaluate(predictions)
        metrics["davies_bouldin_score"] = davies_bouldin(predictions)
    if hasattr(fit, "summary"):
        metrics["inertia"] = fit.summary.trainingCost
    model = PipelineModel(stages=[*prepared.stages, fit])
    return Trained(algorithm, "clustering", names, None, model, predictions, metrics)


def importance(fit, metadata: dict[str, Any]) -> list[dict[str, Any]]:
    """Importances, or absolute coefficients, of a fitted model by name."""
    if hasattr(fit, "featureImportances"):
        values = fit.featureImportances.toArray()
    elif hasattr(fit, "coefficientMatrix"):
        values = np.abs(fit.coefficientMatrix.toArray()).max(axis=0)
    elif hasattr(fit, "coefficients"):
        values = np.abs(fit.coefficients.toArray())
    else:
        return []
    names = {a["idx"]: a["name"] for group in metadata.get("ml_attr", {}).get("attrs", {}).values() for a in group}
    rows = [{"feature": names.get(i, f"feature_{i}"), "importance": float(v)} for i, v in enumerate(values) if v > 0]
    return sorted(rows, key=lambda r: -r["importance"])


def correlation_importance(df: DataFrame, features: list[str], label: str = "label") -> list[dict[str, Any]]:
    """Absolute Pearson with the label, for models that rank nothing."""
    numeric = [c for c in features if is_number(type_of(df, c))]
    if not numeric:
        return []
    others = [c for c in numeric if c != label]
    found = pair_correlations(df, {c: number(df, c) for c in [*others, label]}, [label]).where("r <> 0").collect()
    rows = [{"feature": p["a"], "importance": abs(p["r"])} for p in found]
    return sorted(rows, key=lambda r: (-r["importance"], others.index(r["feature"])))


def vif_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    numeric = [c for c in features if is_number(type_of(df, c))]
    ddl = "feature string, vif double, tolerance double"
    clean = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(numeric)]).na.drop()
    if len(numeric) < 2 or clean.limit(5).count() < 5:
        return df.sparkSession.createDataFrame([], ddl)
    packed = VectorAssembler(inputCols=clean.columns, outputCol="features").transform(clean).select("features")
    matrix = Correlation.corr(packed, "features").first()[0].toArray()
    rows = []
    for i, c in enumerate(numeric):
        others = [j for j in range(len(numeric)) if j != i]
        weights = np.linalg.lstsq(matrix[np.ix_(others, others)], matrix[others, i], rcond=None)[0]
        r2 = float(matrix[i, others] @ weights)
        if r2 >= 0.999999:
            rows.append((c, None, 0.0))
        else:
            tolerance = max(1e-9, 1.0 - r2)
            rows.append((c, 1.0 / tolerance, tolerance))
    return df.sparkSession.createDataFrame(rows, ddl)


def score_rows(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Predictions for a table or a stream that has the feature columns."""
    for c in features:
        require(df, c, "feature")
    return model.transform(df)


SWEEPS = {
    "regression": ("linear_regression", "ridge", "random_forest", "gradient_boosting"),
    "classification": ("logistic_regression", "decision_tree_classifier", "random_forest_classifier"),
}
BUDGET_PARAMS = {"n_estimators": 20, "max_depth": 5}


def detect_problem(df: DataFrame, target: str) -> str:
    """Texts and numbers of up to 20 values are classes, others a quantity."""
    if not is_number(type_of(df, target)):
        return "classification"
    few = df.select(number(df, target).alias("v")).filter("v is not null").distinct().limit(21).count() <= 20
    return "classification" if few else "regression"


def default_algorithm(problem: str) -> str:
    return next(name for name, (kind, _) in ALGORITHMS.items() if kind == problem)


def suggest_task(df: DataFrame, found: dict[str, Any]) -> dict[str, Any]:
    """Target, features and algorithm from a profile of the table."""
    names = data_columns(df)
    target = found.get("target_profile", {}).get("suggested_target") or names[-1]
    leaks = {s["feature"] for s in found.get("leakage_candidates", [])}
    problem = detect_problem(df, target)
    return {
        "target": target,
        "problem": problem,
        "features": [c for c in names if c != target and c not in leaks],
        "algorithm": default_algorithm(problem),
    }


def sweep(
    df: DataFrame, target: str, features: list[str] | None = None, algorithms: list[str] | None = None, folds: int = 3
) -> DataFrame:
    """Leaderboard of several algorithms and a constant baseline."""
    problem = detect_problem(df, target)
    score = "r2" if problem == "regression" else "accuracy"
    rows = []
    for name in algorithms or SWEEPS[problem]:
        done = train(df, target, name, features, BUDGET_PARAMS, cross_validation=True, folds=folds)
        rows.append((name, done.metrics[f"cv_mean_{score}"], done.metrics[score]))
    held = clean_target(df, target, problem)
    if problem == "regression":
        rows.append(("baseline_mean", 0.0, 0.0))
    else:
        top = held.groupBy("__class").count().agg((F.max("count") / F.sum("count")).alias("share")).first()["share"]
        rows.append(("baseline_majority", top, top))
    rows.sort(key=lambda r: (-(r[1] if r[1] is not None else float("-inf")), r[0]))
    ranked = [(i + 1, name, score, cv, held_out) for i, (name, cv, held_out) in enumerate(rows)]
    return df.sparkSession.createDataFrame(ranked, "place int, model string, score string, cv_mean double, test double")
