import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Binarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dayspan.operators import certificates, forest, models
from dayspan.operators.features import FeatureSpec, fit_features, places
from dayspan.session import scratch_path

SPEC = FeatureSpec(label="label", categorical=["c"], numeric=["a", "b"], one_hot=False)


def _rows(spark, n=6000):
    """A label that follows a threshold of ``a`` in some categories and another in the rest; weights."""
    df = spark.range(n).select("id", (F.xxhash64("id", F.lit(1)) % 1000 / 10.0).alias("a"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)).cast("double").alias("b"),
                               F.concat(F.lit("k"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(6))).alias("c"))
    label = (F.col("a") > F.when(F.col("c").isin("k1", "k4"), 30.0).otherwise(-20.0)).cast("double")
    return df.withColumn("label", label).withColumn("weight", F.col("label") * 3 + 1)


def _shares(model, table):
    return np.array([r.p for r in model.transform(table).orderBy("id").select(vector_to_array("probability")[1].alias("p")).collect()])


@pytest.mark.parametrize("weight", [None, "weight"])
def test_forest_is_grown_from_blocks_and_agrees_with_sparks(spark, weight, monkeypatch):
    """No training row is kept by Spark's fit; the shares are near those of Spark's own forest, which differs only by its draws."""
    df = _rows(spark)
    features = fit_features(SPEC, df)
    table = models.vectors(features, df, ["id", "label", "weight"])
    est = models.estimator("forest", "label", weight, numTrees=60)
    want = est.fit(table)
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("Spark's fit, which keeps a number per row and tree"))
    monkeypatch.setattr(forest, "BLOCK", 700)
    pipeline = models.fit_on("forest", table, features, SPEC, weight, numTrees=60)
    got = pipeline.stages[-1]
    assert isinstance(got, RandomForestClassificationModel) and got.getNumTrees == 60 and max(t.depth for t in got.trees) <= 5
    a, b = _shares(got, table), _shares(want, table)
    assert np.abs(a - b).mean() < 0.03 and np.corrcoef(a, b)[0, 1] > 0.99
    again = models.fit_on("forest", table, features, SPEC, weight, numTrees=60).stages[-1]
    assert np.array_equal(_shares(again, table), a)
    # the root of each tree holds its bootstrap sample: as many rows as there are, give or take the draw
    path = scratch_path(spark, "forest-test")
    nodes = certificates.forest_nodes(spark, got, path)
    roots = [r.counts for r in nodes.where("node = 0").collect()]
    mass = df.agg(F.sum(weight or F.lit(1.0))).first()[0]
    assert len(roots) == 60 and abs(np.mean([sum(c) for c in roots]) / mass - 1) < 0.02
    pipeline.write().overwrite().save(path)
    assert np.array_equal(_shares(models.load_model(path).stages[-1], table), a)


def test_best_split_equals_trying_all(spark):
    """Continuous splits are prefixes of the bins; category splits the best of all subsets; empty sides are no split."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 9, (5, 2, 6, 2)).astype(float)
    h[0, :, :] = 0
    h[0, :, 2] = (4, 4)  # one bin: nothing to split
    h[:, 0, 4:] = 0  # the first feature has 4 bins
    drawn, sizes, listed = np.array([[0, 1]] * 5), np.array([4, 6]), np.array([False, True])
    gain, feature, goes, left, right, _, _ = forest.best_splits(h, h, drawn, sizes, listed, 1, 0.0)

    def tried(node, j, mask):
        a, b = h[node, j][mask].sum(0), h[node, j][~mask].sum(0)
        if not a.sum() or not b.sum():
            return -1.0
        gini = lambda s: 1 - ((s / s.sum()) ** 2).sum()
        return gini(a + b) - (a.sum() * gini(a) + b.sum() * gini(b)) / (a + b).sum()

    for node in range(5):
        masks = [(0, np.arange(6) <= k) for k in range(3)] + [(1, np.array([m >> k & 1 for k in range(6)], bool)) for m in range(1, 63)]
        assert abs(gain[node] - max(tried(node, *m) for m in masks)) < 1e-12
        if gain[node] > 0:
            assert abs(tried(node, feature[node], goes[node]) - gain[node]) < 1e-12
            assert np.allclose(left[node], h[node, feature[node]][goes[node]].sum(0)) and np.allclose(left[node] + right[node], h[node, 0].sum(0) if feature[node] == 0 else h[node, 1].sum(0))


def test_labels_of_several_classes_are_left_to_spark(spark):
    df = _rows(spark, 600).withColumn("label", (F.col("id") % 3).cast("double"))
    assert models.train("forest", df, SPEC, numTrees=3).stages[-1].numClasses == 3


def test_missing_values_are_an_error_as_with_spark(spark):
    df = _rows(spark, 600).withColumn("b", F.when(F.col("id") % 11 > 0, F.col("b")))
    with pytest.raises(Exception, match="NaN"):
        models.train("forest", df, SPEC, numTrees=3)


def test_thresholds_lie_between_values():
    assert forest._thresholds([1.0, 1.0, 2.0, 4.0], 90).tolist() == [1.5, 3.0]
    assert forest._thresholds([float("nan"), 3.0], 90).tolist() == [] and forest._thresholds([], 90).tolist() == []
    assert len(forest._thresholds(list(range(1001)), 90)) == 89


@pytest.mark.parametrize("weight", [None, "weight", "own"])
def test_features_counted_together_give_the_forest_of_features_counted_alone(spark, weight, monkeypatch):
    """Two features share a table of counts where these are few; weights are counted only where rows of a class differ in theirs."""
    df = _rows(spark, 3000).withColumn("own", F.col("weight") + F.col("id") % 3)
    est = models.estimator("forest", "label", weight, numTrees=8, maxDepth=4)
    features = fit_features(SPEC, df)
    levels, counted = [], forest._level
    monkeypatch.setattr(forest, "_level", lambda blocks, plans, bins, weighted, *a: levels.append((plans, weighted)) or counted(blocks, plans, bins, weighted, *a))

    def nodes():
        model = forest.fit_forest_on(df, places(features, df), est)
        return sorted(map(str, certificates.forest_nodes(spark, model, scratch_path(spark, "forest-test")).collect()))

    together = nodes()
    assert {w for _, w in levels} == {weight == "own"}
    assert any(g[0] >= 0 for plans, _ in levels for _, groups, _, _ in plans.values() for own in groups for g in own)
    monkeypatch.setattr(forest, "PAIR", 0)
    levels.clear()
    assert nodes() == together and all(g[0] < 0 for plans, _ in levels for _, groups, _, _ in plans.values() for own in groups for g in own)


def test_places_are_the_values_of_the_vector(spark):
    """Null and unseen categories, a constant number, missing numbers; other stages are left to Spark's transform."""
    df = _rows(spark, 300).withColumn("d", F.lit(2.0))
    spec = FeatureSpec(label="label", categorical=["c"], numeric=["a", "d"], passthrough=["b"], one_hot=False)
    features = fit_features(spec, df)
    odd = df.withColumn("c", F.when(F.col("id") % 7 == 0, "unseen").when(F.col("id") % 7 > 1, F.col("c"))).withColumn("a", F.when(F.col("id") % 5 > 0, F.col("a")))
    known = places(features, odd)
    assert [p.categories for p in known] == [7, 0, 0, 0]
    both = features.transform(odd).select(vector_to_array("features").alias("want"), F.array(*[p.column.cast("double") for p in known]).alias("got")).collect()
    assert len(both) == 300 and all(np.array_equal(r.want, r.got, equal_nan=True) for r in both)
    hot = places(fit_features(FeatureSpec(label="label", categorical=["c"], numeric=["a"]), df), df)
    assert [(p.categories, p.hot) for p in hot] == [(6, True), (0, False)]
    assert places(PipelineModel(stages=[Binarizer(inputCol="a", outputCol="features", threshold=0.0)]), df) is None


def test_forest_is_scored_from_its_node_table_as_its_transform_does(spark, monkeypatch):
    """The same columns and values, bit for bit, without an evaluation of 200 trees a row in the model's own code."""
    df = _rows(spark)
    model = models.train("forest", df, SPEC, weight="weight", numTrees=20)
    held = df.limit(500).withColumn("c", F.when(F.col("id") % 7 > 0, F.col("c")))
    cols = ["id", vector_to_array("rawPrediction"), vector_to_array("probability"), "prediction"]
    want, columns = sorted(model.transform(held).select(*cols).collect()), model.transform(held).columns
    monkeypatch.setattr(RandomForestClassificationModel, "transform", lambda *a: pytest.fail("the model's own code"))
    got = models.score(model, held)
    assert sorted(got.columns) == sorted(columns) and sorted(got.select(*cols).collect()) == want
    assert len({r.prediction for r in got.collect()}) == 2


def test_draws_are_poisson():
    times = np.concatenate([forest.drawn_times(3, t, 1, 9999) for t in range(40)])
    share = np.bincount(times, minlength=6)[:6] / len(times)
    assert np.abs(share - np.exp(-1) / np.array([1, 1, 2, 6, 24, 120])).max() < 0.003 and times.max() < forest.UNSURE
    assert np.array_equal(forest.drawn_times(3, 5, 1, 9999), times[5 * 9999: 6 * 9999])
