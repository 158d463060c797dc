"""Stage 2: the day matrix, one row per contract and calendar day.

Absences are folded per worker, division and month to bit masks of days, one
for each class. Spans meet them month by month once, in stage 1, where their totals are
found; the masks of the months in which a span meets absences stay with it as an array, and the curated spans
are expanded to days without another join. Then: share per
concurrent assignment, age and tenure in days, holiday flag, calendar
features and age/tenure bands whose cut points come from span-level min/max
(exact, since age and tenure grow with the day along a span).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.functions.columns import guarded_greatest
from dayspan.operators.bands import range_bands
from dayspan.operators.calendar import calendar_features, elapsed_days, flag_periods
from dayspan.operators.intervals import flagged_days_of, share
from dayspan.operators.clean import exclude_values
from dayspan.plans.curation import curate_spans, curated_spans
from dayspan.plans.spans import KEYS, SPAN
from dayspan.sources import fixtures as fx
from dayspan.sources.tables import materialize

# Youngest age in days, cut points of the age and tenure bands as fractions of their range.
AGE_FLOOR = 16 * 365
AGE_FRACTIONS = [(1, 6), (2, 6), (4, 6)]
AGE_LABELS = ["band_1", "band_2", "band_3", "band_4"]
TENURE_FRACTIONS = [(1, 40), (2, 40), (4, 40), (6, 40), (9, 40)]
TENURE_LABELS = ["tenure_1", "tenure_2", "tenure_3", "tenure_4", "tenure_5", "tenure_6"]
NO_ABSENCE = "no_absence"

SPAN_COLS = ["contract_id", *KEYS, "cost_center", "category", "contract_type", *SPAN, "span_days",
             "hire_date", "birth_date", "concurrent", "total_absence_days", "total_absence_share"]


def absence_days(spans: DataFrame) -> DataFrame:
    """Contract-days with ``absent`` (0/1) and ``absence_class`` (sorted
    distinct classes joined by ',', or ``no_absence``), from curated spans with
    their ``absence_months``."""
    m = flagged_days_of(spans, "absence_months", SPAN)
    named = F.when(F.size("labels") > 0, F.array_join("labels", ",")).otherwise(F.lit(NO_ABSENCE))
    return m.withColumn("absence_class", F.coalesce(named, F.lit(NO_ABSENCE))).withColumnRenamed("flag", "absent").drop("labels")


def span_ranges(spans: DataFrame) -> dict:
    """min/max of age and tenure over all contract-days, from the spans.

    Age and tenure grow by one per day along a span, so their extremes over
    the days are reached at the span ends (the age floor is monotone too).
    One struct-valued scalar subquery: evaluated once, reused by all four
    references, nothing collected into driver code.
    """
    age_lo = guarded_greatest(F.datediff(F.col("span_start"), F.col("birth_date")), F.lit(AGE_FLOOR))
    age_hi = guarded_greatest(F.datediff(F.col("span_end"), F.col("birth_date")), F.lit(AGE_FLOOR))
    stats = spans.agg(F.struct(
        F.min(age_lo).alias("age_lo"), F.max(age_hi).alias("age_hi"),
        F.min(F.datediff(F.col("span_start"), F.col("hire_date"))).alias("tenure_lo"),
        F.max(F.datediff(F.col("span_end"), F.col("hire_date"))).alias("tenure_hi"))).scalar()
    return {k: stats.getField(k) for k in ("age_lo", "age_hi", "tenure_lo", "tenure_hi")}


def day_features(m: DataFrame, spans: DataFrame, holidays: DataFrame) -> DataFrame:
    m = share(m, "absent", "concurrent", "absent_share")
    m = elapsed_days(m, "birth_date", "day", "age_days", floor=AGE_FLOOR)
    m = elapsed_days(m, "hire_date", "day", "tenure_days")
    m = flag_periods(m, "day", holidays, "holiday")
    m = calendar_features(m, "day")
    r = span_ranges(spans)
    m = range_bands(m, "age_days", AGE_FRACTIONS, AGE_LABELS, r["age_lo"], r["age_hi"], "age_band")
    return range_bands(m, "tenure_days", TENURE_FRACTIONS, TENURE_LABELS, r["tenure_lo"], r["tenure_hi"],
                       "tenure_band")


def day_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage 2 over the stage-1 output, which is written as a table into the
    shared checkpoint folder (the stage boundary): lineage is cut there and it
    is read, not recomputed, by the span-level min/max subqueries and the days."""
    spans = spans_table(curated_spans(spark, sf_dir, months=True))
    return day_features(absence_days(spans), spans, fx.holiday_periods(spark))


def spans_table(spans: DataFrame) -> DataFrame:
    """The spans as a stage table, read for the extremes of age and tenure and for the days."""
    return materialize(spans.select(*SPAN_COLS, "absence_months"), "curated-spans")


def build_day_matrix(contracts: DataFrame, absences: DataFrame, holidays: DataFrame, window, as_of,
                     excluded=(), keys=KEYS) -> DataFrame:
    """Stages 1 and 2 on any contract, absence and holiday tables (columns as
    in ``fixtures``): absences of the ``excluded`` classes are dropped (a null
    class is kept), both tables are clipped to ``window``, the stage-1 output is
    written as a table into the shared checkpoint folder, and the day matrix is
    returned."""
    kept = exclude_values(absences, "absence_class", excluded, keep_null=True)
    spans = spans_table(curate_spans(contracts, kept, window, as_of, keys, months=True))
    return day_features(absence_days(spans), spans, holidays)
