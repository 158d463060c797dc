"""Optimality of logistic fits against numpy, forests as tables against DuckDB."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dayspan.operators import certificates as ce
from dayspan.operators import models
from dayspan.operators.features import FeatureSpec, fit_features
from dayspan.session import scratch_path

SPEC = FeatureSpec(label="y", categorical=["kind"], numeric=["a", "b"], passthrough=["c"])


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    n = 1500
    a, b, c = rng.normal(5, 2, n), rng.exponential(1, n), (rng.random(n) < 0.2).astype(float)
    kind = rng.choice(["p", "q", "r", "s"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(a - 5 + (kind == "q") - c)))).astype(float)
    w = np.where(y == 1, 0.7, 1.9) * rng.choice([0.0, 1.0, 2.0], n)
    rows = [(float(y[i]), float(w[i]), str(kind[i]), float(a[i]), float(b[i]), float(c[i])) for i in range(n)]
    df = spark.createDataFrame([*rows], "y double, w double, kind string, a double, b double, c double").repartition(7)
    features = fit_features(SPEC, df)
    return features, models.vectors(features, df, ["y", "w"]), df


def by_feature(c):
    return {r.feature: r for r in c.collect()}


@pytest.mark.parametrize("weight", ["w", None])
def test_gradient_equals_numpy(planted, weight):
    features, table, _ = planted
    names = ce.feature_names(features, SPEC)
    assert names[:4] == [f"kind={v}" for v in features.stages[0].labelsArray[0]] and names[4:] == ["a", "b", "c"]
    model = models.estimator("logistic", "y", weight, regParam=0.02, elasticNetParam=0.5, maxIter=3).fit(table)
    got = by_feature(ce.logistic_certificate(table, model, names, "y", weight))
    rows = table.select("y", "w", vector_to_array("features").alias("x")).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    w = np.array([r.w for r in rows]) if weight else np.ones(len(y))
    mean = (w[:, None] * x).sum(0) / w.sum()
    std = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w * w).sum() / w.sum()))
    beta = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + model.intercept)))
    loss = ((w * (p - y))[:, None] * x).sum(0) / w.sum() / std
    null = ((w * ((w * y).sum() / w.sum() - y))[:, None] * x).sum(0) / w.sum() / std
    for j, name in enumerate(names):
        g = loss[j] + 0.01 * beta[j] * std[j]
        off = abs(g + 0.01 * np.sign(beta[j])) if beta[j] else max(0, abs(g) - 0.01)
        r = got[name]
        assert [r.deviation, r.gradient, r.null_gradient, r.violation, r.l1] == pytest.approx([std[j], g, null[j], off, 0.01], abs=1e-10), name
    assert got[ce.INTERCEPT].gradient == pytest.approx((w * (p - y)).sum() / w.sum(), abs=1e-10)


def test_only_a_finished_fit_is_optimal(planted):
    features, table, _ = planted
    names = ce.feature_names(features, SPEC)
    far = {}
    for steps in (1, 500):
        model = models.estimator("logistic", "y", "w", regParam=0.01, maxIter=steps, tol=1e-12).fit(table)
        far[steps] = ce.logistic_certificate(table, model, names, "y", "w").agg(F.max("violation")).first()[0]
    assert far[500] < 1e-6 < 1e-3 < far[1]


def test_constant_feature_and_one_class(spark):
    """No deviation, no gradient; one class only: the sums of the empty side are 0."""
    df = spark.createDataFrame([(1.0, 2.0, float(i)) for i in range(20)], "y double, a double, b double")
    spec = FeatureSpec(label="y", numeric=["a", "b"])
    features = fit_features(spec, df)
    table = models.vectors(features, df, ["y"])
    other = spark.createDataFrame([(float(i % 2), 2.0, float(i)) for i in range(20)], "y double, a double, b double")
    model = models.estimator("logistic", "y").fit(models.vectors(features, other, ["y"]))
    got = by_feature(ce.logistic_certificate(table, model, ["a", "b"], "y"))
    assert got["a"].gradient == 0 and got["a"].null_gradient == 0
    assert got["b"].null_gradient == pytest.approx(0, abs=1e-12) and got["b"].gradient < 0


@pytest.mark.parametrize("one_hot", [False, True])
def test_forest_table_scores_like_the_model_in_spark_and_duckdb(spark, planted, one_hot):
    import duckdb
    _, _, df = planted
    spec = FeatureSpec(label="y", categorical=["kind"], numeric=["a", "b"], passthrough=["c"], one_hot=one_hot)
    df = df.withColumn("id", F.monotonically_increasing_id())
    model = models.train("forest", df, spec, weight="w", numTrees=15, maxDepth=4)
    forest = model.stages[-1]
    nodes = ce.forest_nodes(spark, forest, scratch_path(spark, "test-forest"))
    assert nodes.count() == forest.totalNumNodes
    held = models.vectors(model.stages[0], df, ["id"])
    want = {r.id: (r.prediction, list(r.s)) for r in forest.transform(held).select("id", "prediction", vector_to_array("probability").alias("s")).collect()}
    got = {r.id: (r.prediction, list(r.shares)) for r in
           ce.score_by_nodes(held, ["id"], nodes, 15, 4, forest.totalNumNodes).collect()}
    assert got.keys() == want.keys()
    for k, (p, s) in want.items():
        assert got[k][0] == p and got[k][1] == pytest.approx(s, abs=1e-12)
    # the same table, scored by another engine
    con = duckdb.connect()
    con.register("n", nodes.toArrow())
    con.register("x", held.select("id", vector_to_array("features").alias("x")).toArrow())
    rows = con.execute("""
        with recursive walk as (
            select id, x, tree, 0 as node from x, (select distinct tree from n) t
            union all
            select id, x, walk.tree,
                   case when coalesce(x[feature + 1] <= threshold, list_contains(left_values, x[feature + 1])) then n."left" else n."right" end
            from walk join n on n.tree = walk.tree and n.node = walk.node where n."left" is not null),
        leaf as (select id, counts[1] / (counts[1] + counts[2]) as s0, counts[2] / (counts[1] + counts[2]) as s1
                 from walk join n on n.tree = walk.tree and n.node = walk.node where n."left" is null)
        select id, sum(s0) / 15, sum(s1) / 15 from leaf group by id""").fetchall()
    assert len(rows) == len(want)
    for k, s0, s1 in rows:
        assert want[k][1] == pytest.approx([s0, s1], abs=1e-12)


def test_large_forests_are_joined_without_a_broadcast_hint(spark, planted):
    _, _, df = planted
    spec = FeatureSpec(label="y", numeric=["a", "b"])
    df = df.withColumn("id", F.monotonically_increasing_id())
    model = models.train("forest", df, spec, numTrees=3, maxDepth=3)
    nodes = ce.forest_nodes(spark, model.stages[-1], scratch_path(spark, "test-forest"))
    held = models.vectors(model.stages[0], df, ["id"])
    small, large = (ce.score_by_nodes(held, ["id"], nodes, 3, 3, n) for n in (10, ce.SMALL_FOREST + 1))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_small_forests_are_walked_without_multiplying_or_shuffling_rows(spark, planted):
    """One pass over the rows, not a row per tree and a join per level; the shares are those of the joins."""
    _, _, df = planted
    spec = FeatureSpec(label="y", categorical=["kind"], numeric=["a", "b"], one_hot=False)
    df = df.withColumn("id", F.monotonically_increasing_id())
    model = models.train("forest", df, spec, numTrees=9, maxDepth=4)
    nodes = ce.forest_nodes(spark, model.stages[-1], scratch_path(spark, "test-forest"))
    held = models.vectors(model.stages[0], df, ["id"])
    got = ce.score_by_nodes(held, ["id"], nodes, 9, 4, model.stages[-1].totalNumNodes)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Join", "Generate", "Aggregate"))
    want = {r.id: r for r in ce.score_by_joins(held, ["id"], nodes, 9, 4).collect()}
    rows = got.collect()
    assert len(rows) == len(want) and all(r.prediction == want[r.id].prediction and r.shares == pytest.approx(want[r.id].shares, abs=1e-12) for r in rows)


def test_certificate_of_columns_is_that_of_vectors(spark, planted, monkeypatch):
    """Fits of one set of weights share their passes over stored columns; no vectors are stored and Spark fits nothing."""
    _, _, df = planted
    features = fit_features(SPEC, df)
    names = ce.feature_names(features, SPEC)
    table = models.vectors(features, df, ["y", "w"])
    fits = {"weighted": (True, {}), "unweighted": (False, {"regParam": 0.05}), "light": (True, {"regParam": 0.01, "tol": 1e-10, "maxIter": 1000})}
    monkeypatch.setattr(models, "vectors", lambda *a: pytest.fail("vectors are stored"))
    monkeypatch.setattr(models.LogisticRegression, "_fit", lambda *a: pytest.fail("Spark's fit"))
    for name, (rows, model) in models.fit_all_logistic(features, df, "y", "w", fits).items():
        weight = "w" if fits[name][0] else None
        want, got = (by_feature(ce.logistic_certificate(t, model, names, "y", weight)) for t in (table, rows))
        assert want.keys() == got.keys() and max(r.violation for r in got.values()) < 1e-6
        for k, r in got.items():
            assert all(a == b if a is None or b is None else a == pytest.approx(b, abs=1e-8) for a, b in zip(r, want[k], strict=True) if not isinstance(a, str))
