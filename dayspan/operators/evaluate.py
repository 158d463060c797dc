"""Evaluation of scored rows: confusion matrix, accuracy, AUC, predicted vs
real rates overall and per day, and the summary of the daily errors."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.functions.columns import ratio


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, prediction, count)."""
    return scored.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("count"))


def accuracy(scored: DataFrame, label: str = "label", prediction: str = "prediction",
             by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows where prediction equals label (one row per ``by``)."""
    hit = F.when(F.col(label) == F.col(prediction), F.lit(1.0)).otherwise(F.lit(0.0))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(hit), 6).alias("accuracy"))


def auc(spark: SparkSession, scored: DataFrame, label: str = "label", raw: str = "rawPrediction") -> DataFrame:
    """Area under the ROC curve (Spark's evaluator, distributed sort, every
    distinct score a point), as a one-row frame."""
    v = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, metricName="areaUnderROC", numBins=0).evaluate(scored)
    return spark.createDataFrame([(float(v),)], "auc double")


def rate_gap(scored: DataFrame, label: str = "label", prediction: str = "prediction", positive=1) -> DataFrame:
    """Predicted share, real share and their absolute gap over all rows
    (sums of row counts, not counts of confusion cells)."""
    pred = F.count_if(F.col(prediction) == F.lit(positive))
    real = F.count_if(F.col(label) == F.lit(positive))
    n = F.count(F.lit(1))
    return scored.agg(n.alias("total"), pred.alias("predicted"), real.alias("real")) \
                 .withColumn("predicted_rate", F.round(ratio("predicted", "total"), 6)) \
                 .withColumn("real_rate", F.round(ratio("real", "total"), 6)) \
                 .withColumn("gap", F.round(F.abs(ratio(F.col("predicted") - F.col("real"), "total")), 6))


def daily_error(scored: DataFrame, day: str = "day", label: str = "label", prediction: str = "prediction",
                positive=1) -> DataFrame:
    """Per day, in one aggregate: rows, real and predicted positives, their
    rates and the errors over the total and over the real positives.

    Every day is kept; ``error_over_absences`` is null on a day without real
    positives.
    """
    d = scored.groupBy(day).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col(label) == F.lit(positive)).alias("count_label"),
        F.count_if(F.col(prediction) == F.lit(positive)).alias("count_prediction"))
    diff = F.abs(F.col("count_prediction") - F.col("count_label"))
    return d.withColumn("real_rate", F.round(ratio("count_label", "count"), 6)) \
            .withColumn("predicted_rate", F.round(ratio("count_prediction", "count"), 6)) \
            .withColumn("error_over_total", F.round(ratio(diff, "count"), 6)) \
            .withColumn("error_over_absences", F.round(ratio(diff, "count_label"), 6))


def error_summary(daily: DataFrame) -> DataFrame:
    """Mean and sample deviation of the daily errors and predicted counts."""
    cols = ["error_over_total", "error_over_absences", "count_prediction"]
    aggs = []
    for c in cols:
        aggs += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 6).alias(f"{c}_std")]
    return daily.agg(F.count(F.lit(1)).alias("days"), *aggs)
