"""Named queries (one per operator of the inventory) and their oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
stand-in tables; the oracle is DuckDB SQL over the same parquet views, with
the fixture views prepended as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dayspan.plans import daily_rate
from dayspan.sources.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, fn: Query, sql: str | None = None, views: tuple[str, ...] = ()) -> None:
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = with_views(sql, *views) if views else sql


register("daily_absence_rate", daily_rate.daily_absence_rate, daily_rate.DAILY_ABSENCE_RATE_SQL,
         ("spans", "kept_absences"))

# Importing the query modules registers their queries.
from dayspan.plans import queries_curation  # noqa: E402,F401
from dayspan.plans import queries_days  # noqa: E402,F401
from dayspan.plans import queries_models  # noqa: E402,F401
from dayspan.plans import queries_certificates  # noqa: E402,F401
