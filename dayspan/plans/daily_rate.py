"""Minimum slice: share of contract-days with an absence, per calendar day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.operators.intervals import day_events, expand_days, flagged_days
from dayspan.plans.spans import KEYS, SPAN, clipped_absences, clipped_spans
from dayspan.sources import fixtures as fx


def contract_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (contract, day) of the clipped spans."""
    spans = clipped_spans(spark, sf_dir).select("contract_id", *KEYS, *SPAN)
    return expand_days(spans, *SPAN, "day")


def absence_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absences folded per (worker, division, day): count and sorted classes."""
    return day_events(clipped_absences(spark, sf_dir), KEYS, "abs_start", "abs_end", "absence_class")


def daily_absence_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, contract_days, absent_days, absence_rate.

    Spans and absences meet by worker, division and month on narrow rows (the
    absences folded to a bit mask of days), and contract-days are counted per
    day in the task that expands them.
    """
    spans = clipped_spans(spark, sf_dir).select(*KEYS, *SPAN)
    # duplicate absence rows collapse in the masks, so the row-level dedupe is skipped
    absences = clipped_absences(spark, sf_dir, distinct=False)
    days = flagged_days(spans, absences, KEYS, SPAN, ("abs_start", "abs_end"), (fx.WINDOW_START, fx.WINDOW_END))
    out = days.groupBy("day").agg(F.count(F.lit(1)).alias("contract_days"), F.sum("flag").alias("absent_days"))
    return out.withColumn("absence_rate", F.round(F.col("absent_days") / F.col("contract_days"), 6))


DAILY_ABSENCE_RATE_SQL = """
select c.day, count(*) as contract_days,
       cast(sum(case when exists (select 1 from kept_absences a
                                   where a.worker_id = c.worker_id and a.division = c.division
                                     and c.day between a.start_date and a.end_date)
                     then 1 else 0 end) as bigint) as absent_days,
       round(sum(case when exists (select 1 from kept_absences a
                                   where a.worker_id = c.worker_id and a.division = c.division
                                     and c.day between a.start_date and a.end_date)
                     then 1 else 0 end) / count(*), 6) as absence_rate
from (select worker_id, division,
             cast(unnest(generate_series(span_start, span_end, interval 1 day)) as date) as day
      from spans) c
group by c.day"""
