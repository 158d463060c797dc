"""Stage-1 building blocks on the stand-in data: clipped contract spans and
the absences that count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dayspan.operators.clean import exclude_values
from dayspan.operators.intervals import clip_span, span_days
from dayspan.sources import fixtures as fx

SPAN = ("span_start", "span_end")
KEYS = ["worker_id", "division"]


def clipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts touching the window, clipped to it, with their length."""
    c = fx.contracts(spark, sf_dir)
    c = clip_span(c, "start_date", "end_date", fx.WINDOW_START, fx.WINDOW_END, *SPAN)
    return span_days(c, *SPAN, "span_days")


def kept_absences(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Absences without the excluded classes (a null class is kept)."""
    return exclude_values(fx.absences(spark, sf_dir, distinct), "absence_class", fx.EXCLUDED_CLASSES,
                          keep_null=True)


def clipped_absences(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Kept absences clipped to the window (days outside can match nothing)."""
    return clip_span(kept_absences(spark, sf_dir, distinct), "start_date", "end_date",
                     fx.WINDOW_START, fx.WINDOW_END, "abs_start", "abs_end")
