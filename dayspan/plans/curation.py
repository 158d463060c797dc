"""Stage 1: curated contract spans, one row per contract.

contracts -> blank defaults -> hire date default -> previous end per worker
and division -> open-ended repair -> clip to the window -> span length ->
hire date capped at the span start -> concurrent assignments -> absence
totals from the overlap join (skew-safe bucketed variant).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.functions.columns import ratio
from dayspan.operators.clean import cap_date, case_label, cast_columns, fill_blank, fill_null, presence_flag, recode
from dayspan.operators.groups import fold_children, group_size, group_value, previous_end
from dayspan.operators.intervals import (clip_span, interval_overlap_join_bucketed, overlap_day_totals, overlap_days,
                                         repair_open_ended, span_days)
from dayspan.plans.spans import KEYS, SPAN, kept_absences
from dayspan.sources import fixtures as fx
from dayspan.sources.tables import materialize as materialize_table

BLANK_DEFAULTS = {"cost_center": "undefined", "category": "undefined"}
CONCURRENT_KEYS = ["worker_id", "span_start", "span_end"]
ROW = "__row"
# spans are clipped to the window, so every overlap lies inside it
WINDOW = (fx.WINDOW_START, fx.WINDOW_END)


def dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in dependents: one per line item of a contract (order).

    contract_id, relation (blank for every third line), object_id (null for
    every fourth line, else 0..2), so all four blank/null cases occur.
    """
    li = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    return li.select(
        F.col("l_orderkey").alias("contract_id"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("")).otherwise(F.col("l_linestatus")).alias("relation"),
        F.when(F.col("l_linenumber") % 4 == 0, F.lit(None).cast("int"))
         .otherwise((F.col("l_partkey") % 3).cast("int")).alias("object_id"),
    )


def dependent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = presence_flag(dependents(spark, sf_dir), "relation", "object_id", "has_dependent")
    return case_label(d, "relation", "has_dependent", "some", "none", out="relation_label")


def prepare_contracts(contracts: DataFrame, as_of, keys=KEYS) -> DataFrame:
    """Blank defaults, hire date default, previous end per ``keys`` and
    open-ended repair on any contract table with the columns of
    ``fixtures.contracts``. The defaulted contracts are a stage table, read
    for the previous ends (``prev_end``), which only the open-ended ones need and get, and again for the rows."""
    c = fill_blank(contracts, BLANK_DEFAULTS)
    c = materialize_table(fill_null(c, {"hire_date": F.col("start_date")}), "contracts")
    is_open = F.coalesce(F.year("end_date") == fx.OPEN_END.year, F.lit(False))
    repaired = previous_end(c, keys, "end_date", as_of, "prev_end", onto=c.where(is_open))
    c = c.where(~is_open).withColumn("prev_end", F.lit(None).cast("date")).unionByName(repaired)
    return repair_open_ended(c, "start_date", "end_date", "prev_end", out="eff_start")


def prepared_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_contracts(fx.contracts(spark, sf_dir), fx.AS_OF)


def curated_spans(spark: SparkSession, sf_dir: str, materialize: bool = False,
                  absences: DataFrame | None = None, months: bool = False) -> DataFrame:
    """One row per contract touching the window. ``absences`` (worker_id,
    division, absence_class, start_date, end_date) default to the kept
    absences; absences already clipped to the window give the same totals,
    since every span lies inside the window. ``months``: see ``curate_spans``."""
    own = absences is None  # the line items' absences may repeat; the fold counts equal ones once
    absences = kept_absences(spark, sf_dir, distinct=False) if own else absences
    return curate_spans(fx.contracts(spark, sf_dir), absences, WINDOW, fx.AS_OF, materialize=materialize, months=months, distinct=own)


def curate_spans(contracts: DataFrame, absences: DataFrame, window, as_of, keys=KEYS,
                 concurrent_keys=CONCURRENT_KEYS, totals: str = "sum", materialize: bool = False,
                 months: bool = False, distinct: bool = False) -> DataFrame:
    """Stage 1 on any contract and absence tables with the columns of
    ``fixtures.contracts`` / ``fixtures.absences``, which pass through as they
    are (birth date included).

    ``window`` (first, last day) and ``as_of`` are the caller's; ``keys`` are
    the columns that tie an absence to a contract (e.g. also cost centre, order
    and contract) and group the previous ends; ``concurrent_keys`` those that
    group concurrent assignments. ``totals``: see ``absence_totals``. ``months``:
    the spans also get ``absence_months``, the months in which they meet absences, for the day matrix.
    ``distinct``: absences that agree in keys, class and dates count once (as their ``distinct`` rows would,
    without a shuffle of its own).
    """
    if window is None or as_of is None:
        raise ValueError("window and as_of are required")
    c = prepare_contracts(contracts, as_of, keys)
    c = clip_span(c, "eff_start", "end_date", window[0], window[1], *SPAN)
    c = span_days(c, *SPAN, "span_days")
    c = cap_date(c, "hire_date", "span_start")
    # the spans are a stage table with an identity of their own, read for the
    # concurrent counts, the totals and the rows
    c = materialize_table(c.withColumn(ROW, F.monotonically_increasing_id()), "spans")
    t = absence_totals(c, absences, window, keys, totals, months, distinct)
    # counts and totals are found on narrow rows; the wide ones are shuffled once, by their identity, for both
    n = group_size(c.select(ROW, *concurrent_keys), concurrent_keys, "concurrent").where(F.col("concurrent") > 1)
    n = n.select(F.col(ROW).alias("__row1"), "concurrent")
    c = c.join(t.withColumnRenamed(ROW, "__row2"), F.col(ROW) == F.col("__row2"), "left") \
         .join(n, F.col(ROW) == F.col("__row1"), "left").drop(ROW, "__row1", "__row2") \
         .withColumn("concurrent", F.coalesce("concurrent", F.lit(1).cast("long"))) \
         .withColumn("total_absence_days", F.coalesce(F.col("total_absence_days"), F.lit(0).cast("long"))) \
         .withColumn("total_absence_share", F.round(ratio("total_absence_days", "span_days"), 6))
    return materialize_table(c, "curated-spans") if materialize else c


def curate_parts(parts: DataFrame, casts, mapping: DataFrame, bindings, dependents: DataFrame, flag: str, absences: DataFrame,
                 window, as_of, **options) -> DataFrame:
    """Stage 1 from raw parts (``read_parts``): casts that turn unreadable
    values into null, codes replaced through the dictionary, the dependents
    folded to one count per contract, then ``curate_spans``."""
    c = recode(cast_columns(parts, casts), mapping, bindings)
    n = fold_children(dependents, ["contract_id"], flag, "dependents").withColumnRenamed("contract_id", "__child")
    c = c.join(n, F.col("contract_id") == F.col("__child"), "left").drop("__child")
    c = c.withColumn("dependents", F.coalesce("dependents", F.lit(0).cast("long")))
    return curate_spans(c, absences, window, as_of, **options)


def overlap_rows(spans: DataFrame, absences: DataFrame) -> DataFrame:
    """Every span with every absence of the same worker and division that
    overlaps it (left join), the clipped overlap and its days."""
    left = spans.select("contract_id", *KEYS, *SPAN, "span_days")
    j = interval_overlap_join_bucketed(left, absences, KEYS, SPAN, ("start_date", "end_date"), WINDOW, how="left")
    return overlap_days(j, "overlap_start", "overlap_end", "overlap_days")


def absence_totals(spans: DataFrame, absences: DataFrame, window, keys=KEYS, totals: str = "sum",
                   months: bool = False, distinct: bool = False) -> DataFrame:
    """``__row`` and total_absence_days of the spans (with that identity) that
    any absence overlaps. ``sum`` adds the overlaps of all absences, so a day
    under two absences counts twice; ``distinct_days`` counts it once.
    ``window`` bounds every span (they are clipped to it). With ``months`` also ``absence_months``; ``distinct``:
    equal absences count once (both: ``overlap_day_totals``)."""
    if totals not in ("sum", "distinct_days"):
        raise ValueError("totals must be 'sum' or 'distinct_days'")
    t = overlap_day_totals(spans, absences, ROW, keys, SPAN, ("start_date", "end_date"), window,
                           label="absence_class", months="absence_months" if months else None, distinct=distinct)
    return t.select(ROW, F.col("overlap_days" if totals == "sum" else "covered_days").alias("total_absence_days"),
                    *(["absence_months"] if months else []))


def contract_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap rows with the contract totals attached to each (D4). The rows
    are a stage table, read once for the totals and once for the rows."""
    spans = fx.contracts(spark, sf_dir)
    spans = span_days(clip_span(spans, "start_date", "end_date", fx.WINDOW_START, fx.WINDOW_END, *SPAN),
                      *SPAN, "span_days")
    rows = materialize_table(overlap_rows(spans, kept_absences(spark, sf_dir)), "overlap-rows")
    rows = group_value(rows, ["contract_id"], F.sum("overlap_days").cast("long"), "total_absence_days")
    return rows.withColumn("total_absence_share", F.round(ratio("total_absence_days", "span_days"), 6))


# ---- oracle text (DuckDB) ---------------------------------------------------

def _d(x: dt.date) -> str:
    return f"date '{x.isoformat()}'"


CURATED_SQL = f"""
c1 as (select contract_id, worker_id, division,
         case when trim(cost_center) = '' then 'undefined' else cost_center end as cost_center,
         case when trim(category) = '' then 'undefined' else category end as category,
         contract_type, start_date, end_date, coalesce(hire_date, start_date) as hire_date, birth_date, amount
       from contracts),
pe as (select worker_id, division,
              max(case when end_date <= {_d(fx.AS_OF)} then end_date end) + 1 as prev_end
       from c1 group by worker_id, division),
c2 as (select c1.*, pe.prev_end,
              case when year(c1.end_date) = 9999 and pe.prev_end is not null then pe.prev_end
                   else c1.start_date end as eff_start
       from c1 left join pe on c1.worker_id is not distinct from pe.worker_id
                           and c1.division is not distinct from pe.division),
c3 as (select *, case when eff_start < {_d(fx.WINDOW_START)} then {_d(fx.WINDOW_START)} else eff_start end as span_start,
                 case when end_date > {_d(fx.WINDOW_END)} then {_d(fx.WINDOW_END)} else end_date end as span_end
       from c2),
c4 as (select * replace (case when hire_date > span_start then span_start else hire_date end as hire_date),
              cast(datediff('day', span_start, span_end) + 1 as int) as span_days,
              count(*) over (partition by worker_id, span_start, span_end) as concurrent
       from c3 where span_start <= span_end),
tot as (select c4.contract_id,
               cast(sum(datediff('day', greatest(c4.span_start, a.start_date), least(c4.span_end, a.end_date)) + 1)
                    as bigint) as total_absence_days
        from c4 join kept_absences a on a.worker_id = c4.worker_id and a.division = c4.division
                 and a.start_date <= c4.span_end and a.end_date >= c4.span_start
        group by c4.contract_id),
curated as (select c4.*, coalesce(tot.total_absence_days, 0) as total_absence_days,
                   round(coalesce(tot.total_absence_days, 0) / c4.span_days, 6) as total_absence_share
            from c4 left join tot using (contract_id))"""


def with_curated(body: str) -> str:
    from dayspan.sources.fixtures import with_views
    head = with_views("", "contracts", "absences", "kept_absences")
    return head.rstrip() + ",\n" + CURATED_SQL + "\n" + body
