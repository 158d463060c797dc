"""Tables that prove a fitted model: optimality of a linear model, trees as rows.

A fit is iterative and has no SQL of its own, but its result can be checked in one
pass over the data: a logistic regression by the gradient of its loss at the
fitted coefficients, a forest by scoring its node table with joins.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.operators.features import FeatureSpec
from dayspan.operators.forest import votes
from dayspan.operators.logistic import Rows, summed

# tasks get this module's functions with their job, so the core needs nothing installed on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

INTERCEPT = "(intercept)"


def feature_names(features: PipelineModel, spec: FeatureSpec) -> list[str]:
    """Names of the vector's places, in order: ``column=value`` for one-hot
    columns, the column's name for all others."""
    if not spec.one_hot or not spec.categorical:
        return [*spec.categorical, *spec.numeric, *spec.passthrough]
    values = features.stages[0].labelsArray
    return [f"{c}={v}" for c, vs in zip(spec.categorical, values, strict=True) for v in vs] + [*spec.numeric, *spec.passthrough]


def coefficient_table(model: LogisticRegressionModel, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """(place, feature, coefficient) of a binary model; the intercept has place -1."""
    rows = [(j, n, float(c)) for j, (n, c) in enumerate(zip(names, model.coefficients.toArray(), strict=True))]
    return spark.createDataFrame([*rows, (-1, INTERCEPT, float(model.intercept))], "place int, feature string, coefficient double")


def _weighted_sums(table: DataFrame, residual, weight, features: str) -> DataFrame:
    """(place, total, mass, deviation): per place of the vector the sum of residual * weight * value and
    its weighted deviation; place -1 has the sum of residual * weight.

    ``Summarizer`` takes no negative weights, so it sums (1 + residual) * weight (residuals are
    within -1 and 1) and weight; a task sends two vectors, whatever its rows."""
    x = F.col(features)
    w = weight.cast("double")
    one = table.agg(F.sum(w).alias("mass"), F.sum(residual * w).alias("rest"),
                    Summarizer.metrics("sum").summary(x, (F.lit(1.0) + residual) * w).alias("shifted"),
                    Summarizer.metrics("sum", "std").summary(x, w).alias("all"))
    arrays = one.select("mass", "rest", vector_to_array("shifted.sum").alias("shifted"), vector_to_array("all.sum").alias("plain"),
                        vector_to_array("all.std").alias("std"))
    places = arrays.withColumn("place", F.explode(F.sequence(F.lit(-1), F.size("std") - 1)))
    at = F.col("place")
    total = F.when(at < 0, F.col("rest")).otherwise(F.get("shifted", at) - F.get("plain", at))
    return places.select("place", "mass", total.alias("total"), F.get("std", at).alias("deviation"))


def _sums_of_columns(rows: Rows, model: LogisticRegressionModel) -> DataFrame:
    """(place, mass, total, null_total, deviation): ``_weighted_sums`` of both residuals on rows stored as columns. The residuals of the
    fit take a pass; all else is in the moments of the rows."""
    b = np.append(model.intercept, model.coefficients.toArray())

    def residuals(x, y, w, fold):
        yield 0, (w * (1 / (1 + np.exp(-np.clip(x @ b, -700, 700))) - y)) @ x

    fit = summed(rows, residuals, 1)[0]
    whole = sum(rows.moments().values())
    squares, s1, s2, sy = whole[1], *np.split(whole[2:], 3)
    mass = s1[0]
    spread = np.maximum(s2 - s1 * s1 / mass, 0) / (mass - squares / mass)
    deviation = np.where(spread > 1e-14 * s2 / mass, np.sqrt(spread), 0.0)
    null = s1 * (sy[0] / mass) - sy
    out = [(j - 1, float(mass), float(fit[j]), float(null[j]), float(deviation[j]) if j else None) for j in range(len(b))]
    return rows.rows.sparkSession.createDataFrame(out, "place int, mass double, total double, null_total double, deviation double")


def logistic_certificate(table: DataFrame | Rows, model: LogisticRegressionModel, names: Sequence[str], label: str,
                         weight: str | None = None, features: str = "features") -> DataFrame:
    """Optimality of a binary logistic regression on its training vectors.

    The fit minimises the weighted mean log loss plus, over coefficients in units
    of their feature's weighted deviation, ``l1 * |b| + l2 / 2 * b * b`` (``l1`` and ``l2`` from
    regParam and elasticNetParam). At the optimum the gradient g of loss and l2 term
    is -l1 * sign(b) where b is not 0 and within [-l1, l1] where it is; the intercept has no penalty.

    One row per feature and one for the intercept: feature, coefficient, deviation,
    gradient (at the fit), null_gradient (of the loss where all coefficients are 0, so a statistic of the data
    alone), l1, and violation, the distance of the gradient from where it must be.
    Features without any deviation have gradient 0. Two passes of one aggregate each, or with ``Rows`` (whose weights count, not
    ``weight``) one beside that of their moments; what reaches the driver is a row a feature.
    """
    reg, share = model.getOrDefault("regParam"), model.getOrDefault("elasticNetParam")
    l1, l2 = reg * share, reg * (1 - share)
    if isinstance(table, Rows):
        spark, sums = table.rows.sparkSession, _sums_of_columns(table, model)
    else:
        w = F.col(weight) if weight else F.lit(1.0)
        y = F.col(label).cast("double")
        scored = model.transform(table)
        fit = _weighted_sums(scored, vector_to_array(model.getProbabilityCol())[1] - y, w, features)
        base = table.agg(F.try_divide(F.sum(y * w), F.sum(w)).alias("rate")).scalar()
        null = _weighted_sums(table, base - y, w, features).select(F.col("place").alias("p"), F.col("total").alias("null_total"))
        spark, sums = table.sparkSession, fit.join(F.broadcast(null), F.col("place") == F.col("p"))
    b = coefficient_table(model, names, spark).withColumnRenamed("place", "q")
    rows = sums.join(F.broadcast(b), F.col("place") == F.col("q"))

    def unit(total: str):
        mean = F.col(total) / F.col("mass")
        return F.when(F.col("place") < 0, mean).otherwise(F.coalesce(F.try_divide(mean, F.col("deviation")), F.lit(0.0)))

    scaled = F.coalesce(F.col("coefficient") * F.col("deviation"), F.lit(0.0))
    gradient = unit("total") + F.when(F.col("place") < 0, 0.0).otherwise(l2 * scaled)
    off = (F.when(F.col("place") < 0, F.abs("gradient")).when(scaled != 0, F.abs(F.col("gradient") + l1 * F.signum(scaled)))
           .otherwise(F.greatest(F.abs("gradient") - l1, F.lit(0.0))))
    return rows.withColumn("gradient", gradient).select(
        "feature", "coefficient", "deviation", "gradient", unit("null_total").alias("null_gradient"), F.lit(l1).alias("l1"), off.alias("violation"))


def forest_nodes(spark: SparkSession, model: RandomForestClassificationModel, path: str) -> DataFrame:
    """The trees as rows: tree, node (0 is the root), feature (place in the vector), threshold
    (goes left up to it), left_values (of a categorical feature: goes left if among them), left, right, counts
    (weight of each class). Leaves have null left and right. The model is written to ``path`` and
    its table read from there, by the executors."""
    model.write().overwrite().save(path)
    n, split = "nodeData", "nodeData.split"
    inner, listed = F.col(f"{n}.leftChild") >= 0, F.col(f"{split}.numCategories") >= 0
    values = F.col(f"{split}.leftCategoriesOrThreshold")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col(f"{n}.id").alias("node"), F.when(inner, F.col(f"{split}.featureIndex")).alias("feature"),
        F.when(inner & ~listed, F.get(values, F.lit(0))).alias("threshold"), F.when(inner & listed, values).alias("left_values"),
        F.when(inner, F.col(f"{n}.leftChild")).alias("left"), F.when(inner, F.col(f"{n}.rightChild")).alias("right"),
        F.col(f"{n}.impurityStats").alias("counts"))


#: nodes up to which the table is sent to every task; 200 trees of the default depth have 12,600 at most
SMALL_FOREST = 1 << 18


def score_by_nodes(rows: DataFrame, ids: Sequence[str], nodes: DataFrame, trees: int, depth: int, total: int, classes: int = 2,
                   features: str = "features") -> DataFrame:
    """``ids``, prediction and shares (of the classes, averaged over the trees) by walking the node table.

    ``total``: nodes in the table. A small table is sent to every task, which takes each row from the root of every tree
    down to a leaf, so rows are neither multiplied nor shuffled. With a larger one each row starts at the root of
    every tree, and a join a level by (tree, node) moves it to a child: ``depth``
    joins and rows * trees rows in flight, none of them stored. Ties go to the smaller class.
    """
    walk = votes(rows.sparkSession, nodes.collect()) if total <= SMALL_FOREST else None
    if walk is not None:
        voted = rows.select(*ids, walk(vector_to_array(features)).alias("votes"))
        shares = voted.select(*ids, F.array(*[F.get("votes", F.lit(c)) / trees for c in range(classes)]).alias("shares"))
        return shares.select(*ids, (F.array_position("shares", F.array_max("shares")) - 1).cast("double").alias("prediction"), "shares")
    return score_by_joins(rows, ids, nodes, trees, depth, classes, features)


def score_by_joins(rows: DataFrame, ids: Sequence[str], nodes: DataFrame, trees: int, depth: int, classes: int = 2, features: str = "features") -> DataFrame:
    """``score_by_nodes`` by a join a level."""
    step = nodes.where(F.col("left").isNotNull()).select(
        F.col("tree").alias("t"), F.col("node").alias("n"), "feature", "threshold", "left_values", "left", "right")
    state = rows.select(*ids, vector_to_array(features).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
                        F.lit(0).alias("node"))
    value = F.get("x", F.col("feature"))
    goes_left = F.coalesce(value <= F.col("threshold"), F.array_contains("left_values", value))
    for _ in range(depth):
        state = state.join(step, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")), "left")
        child = F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        state = state.select(*ids, "x", "tree", child.alias("node"))
    weight = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
    shares = F.transform("counts", lambda c: F.coalesce(F.try_divide(c, weight), F.lit(0.0)))
    leaves = nodes.where(F.col("left").isNull()).select(F.col("tree").alias("t"), F.col("node").alias("n"), shares.alias("own"))
    state = state.join(leaves, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
    mean = [(F.sum(F.get("own", F.lit(c))) / trees).alias(f"s{c}") for c in range(classes)]
    votes = state.groupBy(*ids).agg(*mean).select(*ids, F.array(*[f"s{c}" for c in range(classes)]).alias("shares"))
    return votes.select(*ids, (F.array_position("shares", F.array_max("shares")) - 1).cast("double").alias("prediction"), "shares")
