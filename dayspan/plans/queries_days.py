"""Named queries for the day matrix (stage 2) and its quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.columns import round_half_up
from dayspan.operators import intervals
from dayspan.operators.calendar import calendar_features, elapsed_days, flag_periods
from dayspan.operators.features import split_label
from dayspan.operators.quality import prevalence, violations
from dayspan.plans import curation, day_matrix as dm
from dayspan.plans.catalog import register
from dayspan.plans.daily_rate import contract_days
from dayspan.plans.spans import KEYS, SPAN, clipped_spans, kept_absences
from dayspan.sources import fixtures as fx


def _round(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: round_half_up(c, 6) for c in cols})


def _matrix(spark, sf) -> DataFrame:
    return dm.day_matrix(spark, sf)


# ---- oracle building blocks (DuckDB) ------------------------------------------

MATRIX_CTES = f"""
, mdays as (select c.*, cast(unnest(generate_series(c.span_start, c.span_end, interval 1 day)) as date) as day
            from curated c)
, mflags as (select d.contract_id, d.day,
                    max(case when a.worker_id is not null then 1 else 0 end) as absent,
                    string_agg(distinct a.absence_class, ',' order by a.absence_class) as classes
             from mdays d left join kept_absences a
               on a.worker_id = d.worker_id and a.division = d.division
              and d.day between a.start_date and a.end_date
             group by d.contract_id, d.day)
, m0 as (select d.contract_id, d.worker_id, d.division, d.cost_center, d.category, d.contract_type,
                d.span_start, d.span_end, d.span_days, d.hire_date, d.birth_date, d.concurrent,
                d.total_absence_days, d.total_absence_share, d.day, f.absent,
                case when f.classes is null or f.classes = '' then '{dm.NO_ABSENCE}' else f.classes end
                  as absence_class,
                round(f.absent / d.concurrent, 6) as absent_share,
                cast(greatest(datediff('day', d.birth_date, d.day), {dm.AGE_FLOOR}) as int) as age_days,
                cast(datediff('day', d.hire_date, d.day) as int) as tenure_days,
                case when exists (select 1 from holidays h where d.day between h.start_date and h.end_date)
                     then 1 else 0 end as holiday,
                cast(weekofyear(d.day) as int) as week_of_year, strftime(d.day, '%a') as weekday,
                cast(year(d.day) as int) as year
         from mdays d join mflags f on f.contract_id = d.contract_id and f.day = d.day)
, ar as (select cast(min(age_days) as double) as lo, cast(max(age_days) as double) as hi,
                cast(min(tenure_days) as double) as tlo, cast(max(tenure_days) as double) as thi from m0)
, matrix as materialized (select m0.*, {{age_case}} as age_band, {{tenure_case}} as tenure_band from m0, ar)
"""


def _band_case(col: str, lo: str, hi: str, fractions, labels) -> str:
    parts = [f"when {col} is null then 'unknown'"]
    for (k, n), label in zip(fractions, labels[:-1]):
        parts.append(f"when {col} < {lo} + ({hi} - {lo}) * {k} / {n} then '{label}'")
    return "case " + " ".join(parts) + f" else '{labels[-1]}' end"


def with_matrix(body: str) -> str:
    ctes = MATRIX_CTES.format(
        age_case=_band_case("age_days", "ar.lo", "ar.hi", dm.AGE_FRACTIONS, dm.AGE_LABELS),
        tenure_case=_band_case("tenure_days", "ar.tlo", "ar.thi", dm.TENURE_FRACTIONS, dm.TENURE_LABELS))
    head = fx.with_views("", "contracts", "absences", "holidays", "kept_absences").rstrip()
    return head + ",\n" + curation.CURATED_SQL + ctes + body


def key_sql(*cols: str) -> str:
    """The text of ``hash_key`` in DuckDB."""
    return " || ".join(f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), 'n')" for c in cols)


# H1 -- expand spans to days -------------------------------------------------------
def q_expand_days(spark, sf):
    return contract_days(spark, sf).select("contract_id", "day")


register("expand_days", q_expand_days, """
select contract_id, cast(unnest(generate_series(span_start, span_end, interval 1 day)) as date) as day
from spans""", ("spans",))


# H7 -- flag rows per contract, by a sweep --------------------------------------------
def q_day_flags(spark, sf):
    """Rows and flagged rows of (contract, overlapping absence, day), counted by
    the sweep of ``overlap_day_totals``: no such row is made."""
    spans = clipped_spans(spark, sf).select("contract_id", *KEYS, *SPAN, "span_days")
    met = intervals.overlap_day_totals(spans, kept_absences(spark, sf), "contract_id", KEYS, SPAN, ("start_date", "end_date"),
                                       (fx.WINDOW_START, fx.WINDOW_END)).withColumnRenamed("contract_id", "met_id")
    j = spans.join(met, F.col("contract_id") == F.col("met_id"), "left")
    pairs = F.greatest(F.coalesce("events", F.lit(0)), F.lit(1))
    return j.select("contract_id", (pairs * F.col("span_days")).cast("long").alias("flag_rows"),
                    F.coalesce("overlap_days", F.lit(0)).cast("long").alias("flagged"))


FLAG_ROWS_SQL = """
select contract_id, day, r_absence_class,
       case when day between overlap_start and overlap_end then 1 else 0 end as absent
from (select s.contract_id, s.span_start, s.span_end, a.absence_class as r_absence_class,
             case when a.start_date is null then null else greatest(s.span_start, a.start_date) end as overlap_start,
             case when a.end_date is null then null else least(s.span_end, a.end_date) end as overlap_end,
             cast(unnest(generate_series(s.span_start, s.span_end, interval 1 day)) as date) as day
      from spans s left join kept_absences a
        on a.worker_id = s.worker_id and a.division = s.division
       and a.start_date <= s.span_end and a.end_date >= s.span_start) o"""

register("day_flags", q_day_flags, f"""
select contract_id, count(*) as flag_rows, cast(sum(absent) as bigint) as flagged
from ({FLAG_ROWS_SQL}) r group by contract_id""", ("spans", "kept_absences"))


# E6, H8, H9 -- fold the flag rows per contract-day -------------------------------------
def q_fold_days(spark, sf):
    spans = clipped_spans(spark, sf).select("contract_id", *KEYS, *SPAN)
    # the concurrent assignments join the spans, before these become days
    spans = spans.join(curation.curated_spans(spark, sf).select("contract_id", "concurrent"), "contract_id")
    folded = intervals.flagged_days(spans, kept_absences(spark, sf, distinct=False), KEYS, SPAN, ("start_date", "end_date"),
                                    (fx.WINDOW_START, fx.WINDOW_END), "absence_class")
    named = F.when(F.size("labels") > 0, F.array_join("labels", ",")).otherwise(F.lit(dm.NO_ABSENCE))
    folded = folded.select("contract_id", "day", F.col("flag").alias("absent"), F.coalesce(named, F.lit(dm.NO_ABSENCE)).alias("absence_class"), "concurrent")
    folded = intervals.share(folded, "absent", "concurrent", "absent_share")
    return _round(folded, ["absent_share"])


def _fold_days_sql() -> str:
    head = fx.with_views("", "contracts", "absences", "kept_absences").rstrip()
    spans = f", spans as ({fx.SPANS_SQL})"
    body = """
, fr as (""" + FLAG_ROWS_SQL + f""")
select fr.contract_id, fr.day, max(absent) as absent,
       coalesce(string_agg(distinct case when absent = 1 then r_absence_class end, ','
                           order by case when absent = 1 then r_absence_class end), '{dm.NO_ABSENCE}')
         as absence_class,
       any_value(c.concurrent) as concurrent,
       round(max(absent) / any_value(c.concurrent), 6) as absent_share
from fr join curated c using (contract_id)
group by fr.contract_id, fr.day"""
    return head + ",\n" + curation.CURATED_SQL + spans + body


register("fold_days", q_fold_days, _fold_days_sql())


# Day matrix and its parts --------------------------------------------------------------
def q_elapsed_days(spark, sf):
    return _matrix(spark, sf).select("contract_id", "day", "age_days", "tenure_days")


register("elapsed_days", q_elapsed_days, with_matrix("select contract_id, day, age_days, tenure_days from matrix"))


def q_holiday_periods(spark, sf):
    d = contract_days(spark, sf).select("contract_id", "day")
    return flag_periods(d, "day", fx.holiday_periods(spark), "holiday")


register("holiday_periods", q_holiday_periods, """
select d.contract_id, d.day,
       case when exists (select 1 from holidays h where d.day between h.start_date and h.end_date)
            then 1 else 0 end as holiday
from (select contract_id, cast(unnest(generate_series(span_start, span_end, interval 1 day)) as date) as day
      from spans) d""", ("spans", "holidays"))


def q_calendar_features(spark, sf):
    return calendar_features(contract_days(spark, sf).select("contract_id", "day"), "day")


register("calendar_features", q_calendar_features, """
select contract_id, day, cast(weekofyear(day) as int) as week_of_year, strftime(day, '%a') as weekday,
       cast(year(day) as int) as year
from (select contract_id, cast(unnest(generate_series(span_start, span_end, interval 1 day)) as date) as day
      from spans) d""", ("spans",))


def q_age_bands(spark, sf):
    return _matrix(spark, sf).select("contract_id", "day", "age_days", "age_band")


register("age_bands", q_age_bands, with_matrix("select contract_id, day, age_days, age_band from matrix"))


def q_tenure_bands(spark, sf):
    return _matrix(spark, sf).select("contract_id", "day", "tenure_days", "tenure_band")


register("tenure_bands", q_tenure_bands,
         with_matrix("select contract_id, day, tenure_days, tenure_band from matrix"))

MATRIX_COLS = ["contract_id", "worker_id", "division", "cost_center", "category", "contract_type", "span_start",
               "span_end", "span_days", "hire_date", "birth_date", "concurrent", "total_absence_days",
               "total_absence_share", "day", "absent", "absence_class", "absent_share", "age_days", "tenure_days",
               "holiday", "week_of_year", "weekday", "year", "age_band", "tenure_band"]


def q_day_matrix(spark, sf):
    return _round(_matrix(spark, sf), ["absent_share", "total_absence_share"]).select(*MATRIX_COLS)


register("day_matrix", q_day_matrix, with_matrix("select " + ", ".join(MATRIX_COLS) + " from matrix"))


# E12 -- prevalence of the positive label -------------------------------------------
def q_prevalence(spark, sf):
    return prevalence(_matrix(spark, sf), "absent", 1)


register("prevalence", q_prevalence, with_matrix("""
select count(*) as rows, count(*) filter (where absent = 1) as positives,
       round(count(*) filter (where absent = 1) / count(*), 6) as prevalence from matrix"""))


# C8 -- rule violations -------------------------------------------------------------
def q_quality_violations(spark, sf):
    m = _matrix(spark, sf)
    rules = {"absent_above_one": F.col("absent") > 1,
             "total_share_above_one": F.col("total_absence_share") > 1,
             "absent_on_holiday": (F.col("absent") == 1) & (F.col("holiday") == 1)}
    return violations(m, ["worker_id"], rules)


register("quality_violations", q_quality_violations, with_matrix("""
select distinct 'absent_above_one' as rule, worker_id from matrix where absent > 1
union select distinct 'total_share_above_one', worker_id from matrix where total_absence_share > 1
union select distinct 'absent_on_holiday', worker_id from matrix where absent = 1 and holiday = 1"""))


# C4 -- temporal split ---------------------------------------------------------------
def q_temporal_split(spark, sf):
    d = calendar_features(contract_days(spark, sf).select("contract_id", "day"), "day")
    return split_label(d, "year", fx.TRAIN_BEFORE, [fx.TEST_YEAR]).select("contract_id", "day", "part")


register("temporal_split", q_temporal_split, f"""
select contract_id, day, case when year(day) < {fx.TRAIN_BEFORE} then 'train' else 'test' end as part
from (select contract_id, cast(unnest(generate_series(span_start, span_end, interval 1 day)) as date) as day
      from spans) d
where year(day) < {fx.TRAIN_BEFORE} or year(day) = {fx.TEST_YEAR}""", ("spans",))
