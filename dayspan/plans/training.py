"""Stage 3 on the day matrix: model frame, feature spec, stand-in scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.operators.features import FeatureSpec, temporal_split
from dayspan.plans.day_matrix import day_matrix
from dayspan.sources import fixtures as fx
from dayspan.sources.tables import materialize as materialize_table

LABEL = "label"
# Columns derived from the label or from the whole contract (incl. the day
# predicted) must never be features.
FORBIDDEN = ["absent", "absent_share", "absence_class", "total_absence_days", "total_absence_share"]

CATEGORICAL = ["weekday", "age_band", "tenure_band", "cost_center", "category", "contract_type"]
NUMERIC = {"age_d": "age_days", "tenure_d": "tenure_days", "span_d": "span_days", "concurrent_d": "concurrent", "week_d": "week_of_year"}

SPEC = FeatureSpec(label=LABEL, categorical=CATEGORICAL, numeric=list(NUMERIC), passthrough=["holiday_d"], forbidden=FORBIDDEN)
# Trees take the category indexes as they are.
FOREST_SPEC = FeatureSpec(label=LABEL, categorical=CATEGORICAL, numeric=list(NUMERIC), passthrough=["holiday_d"],
                          forbidden=FORBIDDEN, one_hot=False)

# what these specs and a row's key need of the day matrix
MODEL_COLUMNS = ["contract_id", "day", *CATEGORICAL, *NUMERIC.values(), "holiday"]

STAND_IN_CUT = 0.2


def model_frame(spark: SparkSession, sf_dir: str, materialize: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Day matrix with a double label and double copies of the numerics.

    Stage 3 reads the day matrix several times (class histogram, feature
    fits, iterative model fit, scoring of the held-out year), so by default
    it is written once as a table into the shared checkpoint folder -- the
    stage boundary -- instead of being recomputed for every pass, partitioned by year, so that
    the training years, the test year and a back-test read their own files only. Single-pass
    consumers pass ``materialize=False``. ``columns``: those of the matrix that the caller reads; only these,
    the label and the year are computed and stored (default: all).
    """
    m = day_matrix(spark, sf_dir)
    if columns is not None:
        m = m.select(*dict.fromkeys([*columns, "absent", "year"]))
    if materialize:
        m = materialize_table(m, "day-matrix", partition_by=["year"])
    return prepare_model_frame(m)


def prepare_model_frame(m: DataFrame) -> DataFrame:
    """Any day matrix (e.g. from ``build_day_matrix``) with a double label and
    double copies of the numerics it has, ready for ``SPEC`` / ``FOREST_SPEC``."""
    return m.withColumns({
        LABEL: F.col("absent").cast("double"),
        **{d: F.col(c).cast("double") for d, c in {**NUMERIC, "holiday_d": "holiday"}.items() if c in m.columns},
    })


def train_test(df: DataFrame, train_before: int | None = None,
               test_years=None) -> tuple[DataFrame, DataFrame]:
    """Years before ``train_before`` train, ``test_years`` test (defaults: the
    fixture's 1999 split)."""
    return temporal_split(df, "year", train_before or fx.TRAIN_BEFORE,
                          list(test_years) if test_years else [fx.TEST_YEAR])


def stand_in_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic predictor for exact evaluation checks: predict absent
    when the contract's absence share reaches the cut."""
    m = model_frame(spark, sf_dir, materialize=False)
    return m.withColumn("prediction", F.when(F.col("total_absence_share") >= STAND_IN_CUT, F.lit(1.0))
                        .otherwise(F.lit(0.0)))


# Line items with a planted label (l_quantity > 25) and four numeric features,
# trained on ship years before 1997 and scored on 1997-1998.
LINE_SPEC = FeatureSpec(label="label", numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def line_frame(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = fx.table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") > 25).cast("double").alias("label"), "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", F.year("l_shipdate").alias("year"))
    return temporal_split(li, "year", 1997, [1997, 1998])
