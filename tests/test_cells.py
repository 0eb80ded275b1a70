"""Boosting over cells against MLlib's own boosting over the rows."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from rowloom.learning import train
from rowloom.learning.cells import fit_by_cells, split_points
from rowloom.learning.features import feature_pipeline


@pytest.fixture(scope="module")
def rows(spark):
    return _made(spark, 30_000).cache()


def _made(spark, n):
    """A column of 500 uneven values, one of 7 with nulls, and texts with nulls, with a noisy label."""
    at = spark.range(0, n, 1, 4)
    a = F.pow(F.pmod(F.xxhash64("id"), F.lit(500)) / 50.0, 2)
    b = F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).cast("double"))
    c = F.when(F.col("id") % 13 != 0, F.concat(F.lit("k"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4))))
    made = at.select("id", a.alias("a"), b.alias("b"), c.alias("c"))
    noise = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 100.0
    return made.withColumn("label", F.col("a") + F.coalesce("b", F.lit(9.0)) * F.when(F.col("c") == "k1", 4).otherwise(1) + noise)


def _predictions(model, rows):
    return [r["prediction"] for r in model.transform(rows).orderBy("id").select("prediction").collect()]


@pytest.mark.parametrize("features,n", [(["a", "b"], 9_000), (["a"], 9_000), (["b", "c"], 30_000)])
def test_cells_give_the_trees_of_the_rows(rows, features, n):
    # MLlib draws no sample from 9 000 rows; from 30 000 it meets all values of the short columns.
    some = rows.filter(F.col("id") < n)
    prepared = Pipeline(stages=list(feature_pipeline(some, features).getStages())).fit(some)
    trees = GBTRegressor(maxIter=8, maxDepth=3, seed=42)
    plain = trees.fit(prepared.transform(some))
    looked_up, packed, fit = fit_by_cells(trees, prepared, some, n, few=0)
    ready = packed.transform(looked_up.transform(prepared.transform(some)))
    assert _predictions(fit, ready) == pytest.approx(_predictions(plain, prepared.transform(some)), rel=1e-9)
    assert fit.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), rel=1e-6, abs=1e-9)


def test_training_meets_cells_in_place_of_rows(spark, monkeypatch, tmp_path):
    met, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df, *a: met.append(df.count()) or fit(self, df, *a))
    table = _made(spark, 1_300_000).withColumnRenamed("label", "y").drop("id")
    done = train.train(table, "y", "gradient_boosting", ["a", "b", "c"], {"n_estimators": 10, "max_depth": 4})
    assert done.metrics["train_rows"] == 1_040_000 and done.metrics["r2"] > 0.9
    assert met[0] < 32 * 8 * 6
    assert {i["feature"] for i in done.importance[:2]} == {"__num0", "__num1"}
    done.model.write().overwrite().save(str(tmp_path / "m"))
    scored = train.score_rows(train.PipelineModel.load(str(tmp_path / "m")), table.limit(1000).drop("y"), done.features)
    assert scored.filter("prediction is null").isEmpty()


def test_few_rows_and_many_cells_stay_rows(rows):
    few = rows.filter(F.col("id") < 2_000)
    prepared = Pipeline(stages=list(feature_pipeline(few, ["a", "b", "c"]).getStages())).fit(few)
    trees = GBTRegressor(maxIter=2, seed=42)
    assert fit_by_cells(trees, prepared, few, 2_000) is None
    assert fit_by_cells(trees, prepared, few, 2_000, few=0) is None  # 32 * 7 * 5 cells are over a quarter
    same = few.withColumn("a", F.lit(1.0))
    prepared = Pipeline(stages=list(feature_pipeline(same, ["a"]).getStages())).fit(same)
    assert fit_by_cells(trees, prepared, same, 2_000, few=0) is None


def test_endless_numbers_are_refused_as_before(rows):
    odd = rows.withColumn("b", F.when(F.col("id") == 5, float("inf")).otherwise(F.col("b")))
    prepared = Pipeline(stages=list(feature_pipeline(odd, ["a", "b"]).getStages())).fit(odd)
    with pytest.raises(Exception, match="NaN or Infinity"):
        fit_by_cells(GBTRegressor(maxIter=2, seed=42), prepared, odd, 30_000, few=0)


def test_split_points_are_mllibs():
    assert split_points(train.np.array([1.0, 3.0, 3.0, 6.0]), 3) == [2.0, 4.5]
    assert split_points(train.np.array([5.0]), 3) == []
    assert split_points(train.np.arange(8.0), 3) == [1.5, 3.5, 5.5]
