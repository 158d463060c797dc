"""Calendar features of a day column, period flags and elapsed days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.columns import guarded_greatest

# The day set of a period table holds distinct DATE values, so it can never
# exceed the size of the date domain (0001-01-01 .. 9999-12-31): a proven
# bound of 3,652,059 four-byte rows, safe to broadcast without a count.
DATE_DOMAIN_DAYS = 3_652_059


# Short English weekday names, Sunday first (dayofweek 1..7),
# the same text as date_format(d, 'E') in the default locale.
WEEKDAY_NAMES = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def weekday_name(d) -> "F.Column":
    """Short weekday name by array lookup on ``dayofweek`` (codegen'd, no
    per-row formatter)."""
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), F.dayofweek(d))


def calendar_features(df: DataFrame, day: str, week: str = "week_of_year",
                      weekday: str = "weekday", year: str = "year") -> DataFrame:
    """ISO week number, short weekday name (``Mon``) and year of ``day``."""
    d = F.col(day)
    return df.withColumns({week: F.weekofyear(d), weekday: weekday_name(d), year: F.year(d)})


def period_days(periods: DataFrame, start: str = "start_date", end: str = "end_date",
                day: str = "day") -> DataFrame:
    """Distinct days covered by any period of the table."""
    p = periods.where(F.col(start) <= F.col(end))
    return p.select(F.explode(F.sequence(F.col(start), F.col(end))).alias(day)).distinct()


def flag_periods(df: DataFrame, day: str, periods: DataFrame, out: str = "in_period",
                 start: str = "start_date", end: str = "end_date") -> DataFrame:
    """1 when ``day`` falls in any ``[start, end]`` period, else 0.

    The periods become a set of distinct days, bounded by the date domain
    (``DATE_DOMAIN_DAYS``), which is broadcast; the lookup is an equi-join on
    the day instead of a range test per row and period.
    """
    days = F.broadcast(period_days(periods, start, end, "__pday").withColumn("__hit", F.lit(1)))
    j = df.join(days, df[day] == days["__pday"], "left")
    return j.withColumn(out, F.coalesce(F.col("__hit"), F.lit(0))).drop("__pday", "__hit")


def elapsed_days(df: DataFrame, since: str, day: str, out: str, floor: int | None = None) -> DataFrame:
    """Days from ``since`` to ``day``; raised to ``floor`` if given. Null
    ``since`` stays null."""
    v = F.datediff(F.col(day), F.col(since))
    if floor is not None:
        v = guarded_greatest(v, F.lit(floor))
    return df.withColumn(out, v)
