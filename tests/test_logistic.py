import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.operators import certificates, logistic, models
from dayspan.operators.features import FeatureSpec, fit_features, places

SPEC = FeatureSpec(label="label", categorical=["c"], numeric=["a", "b"], passthrough=["d"])


def _table(spark, n=4000):
    df = spark.range(n).select("id", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10.0).alias("a"),
                               F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)).cast("double").alias("b"), F.lit(3.0).alias("d"),
                               F.concat(F.lit("k"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(6))).alias("c"))
    noise = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(60))
    df = df.withColumn("label", (F.col("a") + noise + F.when(F.col("c") == "k1", 25).otherwise(0) > 85).cast("double"))
    df = df.withColumn("weight", F.col("label") * 2 + 0.5).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(3)).cast("int"))
    features = fit_features(SPEC, df)
    return features, models.vectors(features, df, ["id", "label", "weight", "fold"])


@pytest.mark.parametrize("weight,params", [("weight", {"regParam": 0.01, "tol": 1e-10, "maxIter": 1000}), (None, {"regParam": 0.05}), (None, {}),
                                           ("weight", {"regParam": 0.1, "elasticNetParam": 0.0}), (None, {"regParam": 0.02, "elasticNetParam": 1.0})])
def test_fit_is_the_optimum_that_spark_finds_without_rows_in_memory(spark, weight, params, monkeypatch):
    features, table = _table(spark)
    own = {"regParam": 0.3, "elasticNetParam": 0.8, **params}
    want = LogisticRegression(labelCol="label", **({"weightCol": weight} if weight else {}), **{**own, "tol": 1e-12, "maxIter": 2000}).fit(table)
    monkeypatch.setattr(LogisticRegression, "_fit", lambda *a: pytest.fail("Spark's fit, which keeps all rows in memory"))
    got = logistic.fit_many(table, [(models.estimator("logistic", "label", weight, **params), None)])[0]
    assert np.allclose(got.coefficients.toArray(), want.coefficients.toArray(), atol=2e-4) and abs(got.intercept - want.intercept) < 2e-3
    c = certificates.logistic_certificate(table, got, certificates.feature_names(features, SPEC), "label", weight)
    assert max(r.violation for r in c.collect()) < 1e-6


def test_search_fits_all_folds_in_the_same_passes(spark, monkeypatch):
    """Each model is the one fitted on the other folds alone; passes do not grow with folds and settings."""
    _, table = _table(spark)
    passes = []
    monkeypatch.setattr(DataFrame, "cache", lambda d: pytest.fail("rows of a fold are cached"))
    real = logistic._summed
    monkeypatch.setattr(logistic, "_summed", lambda *a: passes.append(1) or real(*a))
    cv = models.cross_validate("logistic", table, "label", 3, {"regParam": [0.3, 0.01, 0.001], "elasticNetParam": [0.2, 0.8]}, "weight", "fold", keep_models=True)
    assert len(passes) <= 24 and len(cv.avgMetrics) == 6 and len(cv.subModels) == 3
    alone = models.estimator("logistic", "label", "weight", regParam=0.001, elasticNetParam=0.2).fit(table.where("fold != 1"))
    near = [m for m in cv.subModels[1] if m.getOrDefault("regParam") == 0.001 and m.getOrDefault("elasticNetParam") == 0.2]
    assert len(near) == 1 and np.allclose(near[0].coefficients.toArray(), alone.coefficients.toArray(), atol=1e-5)
    assert max(cv.avgMetrics) > 0.8 and cv.bestModel.transform(table).count() == 4000


def test_other_settings_are_left_to_spark(spark):
    _, table = _table(spark, 500)
    assert logistic.fit_many(table, [(models.estimator("logistic", "label", regParam=0.0), None)]) is None
    three = table.withColumn("label", (F.col("id") % 3).cast("double"))
    assert logistic.fit_many(three, [(models.estimator("logistic", "label"), None)]) is None
    cv = models.cross_validate("logistic", table, "label", 3, {"regParam": [0.0, 0.1]}, fold_col="fold")
    assert len(cv.avgMetrics) == 2 and cv.bestModel.numClasses == 2


def _frame(spark, n=4000):
    df = spark.range(n).select("id", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10.0).alias("a"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)).cast("double").alias("b"),
                               F.lit(3.0).alias("d"), F.concat(F.lit("k"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(6))).alias("c"))
    return df.withColumn("label", (F.col("a") + F.pmod(F.xxhash64("id", F.lit(4)), F.lit(60)) > 85).cast("double")).withColumn("weight", F.col("label") * 2 + 0.5)


def test_tuning_stores_no_vectors_and_judges_all_models_in_one_pass(spark, monkeypatch):
    """The setting and model are those found on vectors; the areas are near Spark's, which are taken one job a model."""
    df = _frame(spark)
    grid = {"regParam": [0.3, 0.01], "elasticNetParam": [0.2, 0.8]}
    features = fit_features(SPEC, df)
    table = models.vectors(features, df.withColumn("fold", models.fold_of(["id"], 3)), ["label", "weight", "fold"])
    cv = models.cross_validate("logistic", table, "label", 3, grid, "weight", "fold", keep_models=True)
    judge = BinaryClassificationEvaluator(labelCol="label")
    areas = [np.mean([judge.evaluate(cv.subModels[f][i].transform(table.where(F.col("fold") == f))) for f in range(3)]) for i in range(4)]
    assert np.abs(np.array(areas) - cv.avgMetrics).max() < 1e-3 and max(areas) > 0.8
    monkeypatch.setattr(models, "vectors", lambda *a: pytest.fail("vectors are stored"))
    monkeypatch.setattr(BinaryClassificationEvaluator, "evaluate", lambda *a: pytest.fail("a job for each model"))
    got = models.tune("logistic", df, SPEC, "weight", grid, 3, fold_key=["id"]).stages[-1]
    assert np.allclose(got.coefficients.toArray(), cv.bestModel.coefficients.toArray(), atol=1e-6) and abs(got.intercept - cv.bestModel.intercept) < 1e-6


def test_logistic_is_scored_without_vectors_as_its_transform_does(spark, monkeypatch):
    df = _frame(spark)
    features = fit_features(SPEC, df)
    fit = models.estimator("logistic", "label", regParam=0.01).fit(models.vectors(features, df, ["label"]))
    model = models.PipelineModel(stages=[features, fit])
    held = df.limit(700).withColumn("c", F.when(F.col("id") % 7 > 0, F.col("c")).when(F.col("id") % 2 == 0, "unseen")).withColumn("a", F.when(F.col("id") > 5, F.col("a")))
    cols = [F.col("id"), vector_to_array("rawPrediction").alias("r"), vector_to_array("probability").alias("p"), "prediction"]
    want = {r.id: r for r in model.transform(held).select(*cols).collect()}
    monkeypatch.setattr(LogisticRegressionModel, "transform", lambda *a: pytest.fail("a vector for each row"))
    got = models.score(model, held).select(*cols).collect()
    assert len(got) == 700 and all(r.prediction == want[r.id].prediction and np.allclose(r.r, want[r.id].r, atol=1e-12, equal_nan=True)
                                    and np.allclose(r.p, want[r.id].p, atol=1e-12, equal_nan=True) for r in got)


def test_packed_columns_are_the_rows_of_the_vectors(spark):
    df = _frame(spark, 500).withColumn("c", F.when(F.col("id") % 9 > 0, F.col("c"))).withColumn("fold", (F.col("id") % 3).cast("int"))
    features = fit_features(SPEC, df.where("id > 20"))
    rows = logistic.columns_of(df.coalesce(1), places(features, df), "label", "weight", F.col("fold"))
    want = models.vectors(features, df.coalesce(1), ["label", "weight", "fold"]).toArrow().combine_chunks()
    x, y, w, fold = next(iter(rows.parts()(rows.rows.toArrow().to_batches()[0])))
    again = logistic.dense(features.transform(df.coalesce(1)).select("features").toArrow().combine_chunks().column("features").chunk(0), rows.width)
    assert np.array_equal(x, again) and len(y) == 500
    assert all(np.array_equal(a, want.column(k).to_numpy()) for a, k in ((y, "label"), (w, "weight"), (fold, "fold")))
