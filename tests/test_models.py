import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from dayspan.operators import evaluate, models
from dayspan.operators.features import FeatureSpec, infer_features, temporal_split


def _planted(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    return li.select((F.col("l_quantity") > 25).cast("double").alias("label"), "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax", "l_returnflag", F.year("l_shipdate").alias("year"))


SPEC = FeatureSpec(label="label", categorical=["l_returnflag"],
                   numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@pytest.mark.parametrize("kind,params,floor", [
    ("logistic", {"regParam": 0.0, "elasticNetParam": 0.0}, 0.95),
    ("naive_bayes", {}, 0.55),
    ("forest", {"numTrees": 20}, 0.95),
])
def test_planted_signal(spark, kind, params, floor):
    df = _planted(spark)
    train, test = temporal_split(df, "year", 1997, [1997, 1998])
    model = models.train(kind, train, SPEC, **params)
    acc = evaluate.accuracy(models.score(model, test)).first()["accuracy"]
    assert acc >= floor


def test_spec_rejects_forbidden():
    with pytest.raises(ValueError):
        FeatureSpec(label="y", numeric=["leak"], forbidden=["leak"]).check()


def test_infer_features_by_type(spark):
    spec = infer_features(_planted(spark), "label", exclude=["year"])
    assert spec.categorical == ["l_returnflag"] and "l_quantity" in spec.numeric


def test_forest_cardinality_check(spark):
    """Index-coded columns are checked against maxBins; one-hot ones need no check."""
    rows = [(f"v{i % 120}", float(i % 2)) for i in range(480)]
    df = spark.createDataFrame(rows, "code string, label double")
    with pytest.raises(ValueError, match="maxBins"):
        models.train("forest", df, FeatureSpec(label="label", categorical=["code"], one_hot=False), numTrees=2)
    model = models.train("forest", df, FeatureSpec(label="label", categorical=["code"]), numTrees=2)
    assert models.score(model, df).count() == 480


def test_weighted_forest_and_tuning(spark):
    from dayspan.operators.balance import class_weights
    df = _planted(spark)
    train, test = temporal_split(df, "year", 1997, [1997, 1998])
    train = class_weights(train, "label", "weight")
    model = models.train("forest", train, SPEC, weight="weight", numTrees=10)
    assert evaluate.accuracy(models.score(model, test)).first()["accuracy"] >= 0.95
    cv = models.tune("logistic", train, SPEC, weight="weight", grid={"regParam": [0.0, 0.1]}, folds=2,
                     parallelism=2)
    assert evaluate.accuracy(models.score(cv, test)).first()["accuracy"] >= 0.95
    bt = models.backtest(cv, df, "year", [1997, 1998], "label")
    assert bt.select("year").distinct().count() == 2


def test_stage3_on_a_given_day_matrix(spark):
    from dayspan.plans import training as tr
    from dayspan.plans.day_matrix import day_matrix
    m = tr.prepare_model_frame(day_matrix(spark, SF_SMALL))
    train, test = tr.train_test(m, 1998, [1998, 1999])
    assert train.where("year >= 1998").count() == 0
    assert set(r["year"] for r in test.select("year").distinct().collect()) <= {1998, 1999}
    model = models.train("naive_bayes", train, tr.SPEC)
    assert evaluate.confusion_matrix(models.score(model, test), "label").agg(F.sum("count")).first()[0] == test.count()


def test_folds_do_not_depend_on_the_layout_and_areas_equal_rank_sums(spark):
    """A row's fold comes from its key; areas agree with a plain count of ordered pairs, ties and all."""
    import random
    from dayspan.operators import models
    df = spark.range(4000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("k"))
    layouts = [df.repartition(n).withColumn("fold", models.fold_of(["id", "k"], 4)) for n in (1, 9)]
    a, b = ({r.id: r.fold for r in d.collect()} for d in layouts)
    assert a == b and set(a.values()) == {0, 1, 2, 3} and min(list(a.values()).count(f) for f in range(4)) > 850
    rng = random.Random(2)
    rows = [(f, rng.choice([0, 1]), round(rng.random(), rng.choice([1, 6]))) for f in (0, 1, 2) for _ in range(500)] + [(3, 1, 0.5)]
    per = spark.createDataFrame(rows, "fold int, label int, score double").groupBy("fold", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    for r in models._areas(per).collect():
        pos, neg = ([s for f, y, s in rows if f == r.fold and y == want] for want in (1, 0))
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if neg else None
        assert r["rows"] == len(pos) + len(neg) and r.positives == len(pos)
        assert r.auc is None if want is None else abs(r.auc - want) < 1e-12


def test_forest_rows_are_spread_by_the_size_they_take_in_the_fit(spark, monkeypatch):
    df = spark.range(1000).coalesce(1)
    assert models.spread_for_forest(df, 200).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "FOREST_TASK_BYTES", 100_000)  # 100 rows of 200 trees
    wide = models.spread_for_forest(df, 200)
    assert wide.rdd.getNumPartitions() == 10 and wide.distinct().count() == 1000
    assert max(len(p) for p in wide.rdd.glom().collect()) <= 110
    assert models.spread_for_forest(df.repartition(20), 200).rdd.getNumPartitions() == 20


def test_rounding_agrees_with_spark_bit_by_bit(spark):
    import random
    from dayspan.functions.columns import round_half_up
    rng = random.Random(3)
    xs = [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 18) for _ in range(20_000)]
    xs += [k / 2e6 for k in range(-2001, 2001)] + [rng.randrange(10**9) / 1e6 + 5e-7 for _ in range(5000)] + [rng.randrange(10**7) / 1e6 + 4.99e-7 for _ in range(5000)]
    xs += [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1e300, 5e-324, 1e5, 99999.9999995, 1e11 + 0.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    r = df.select("x", round_half_up("x", 6).alias("a"), F.round("x", 6).alias("b"))
    assert r.where("not (a <=> b)").count() == 0


def test_feature_rows_take_no_lambda(spark):
    """The one-hot part is counted and the scaled values are rounded by compiled expressions."""
    from dayspan.plans import catalog
    out = catalog.QUERIES["features_pipeline"](spark, SF_SMALL)
    assert "lambdafunction" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.hot for r in out.select("hot").distinct().collect()} <= set(range(7)) and dict(out.dtypes)["hot"] == "bigint"
