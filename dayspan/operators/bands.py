"""Bands of a numeric column at cut points that are fractions of its range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.functions.columns import as_col


def value_range(df: DataFrame, col: str | Column) -> tuple[Column, Column]:
    """min and max of ``col`` as scalar-subquery columns.

    Evaluated once on the cluster and inlined in the plan; nothing is
    collected into driver code and no join is needed.
    """
    c = as_col(col)
    return df.agg(F.min(c)).scalar(), df.agg(F.max(c)).scalar()


def cut_points(lo, hi, fractions: Sequence[tuple[int, int]]) -> list[Column]:
    """``lo + (hi - lo) * k / n`` for every fraction ``(k, n)``, as doubles."""
    lo, hi = as_col(F.lit(lo) if not isinstance(lo, Column) else lo), \
        as_col(F.lit(hi) if not isinstance(hi, Column) else hi)
    width = hi.cast("double") - lo.cast("double")
    return [lo.cast("double") + width * F.lit(k) / F.lit(n) for k, n in fractions]


def range_bands(df: DataFrame, col: str, fractions: Sequence[tuple[int, int]], labels: Sequence[str],
                lo=None, hi=None, out: str = "band", unknown: str = "unknown") -> DataFrame:
    """Label each row by the half-open band ``[cut_i, cut_{i+1})`` its value
    falls in; below the first cut -> ``labels[0]``, from the last cut on ->
    ``labels[-1]``; null -> ``unknown``.

    ``lo``/``hi`` default to the column's own min and max (scalar subqueries).
    """
    if len(labels) != len(fractions) + 1:
        raise ValueError("need one label more than cut points")
    if lo is None or hi is None:
        lo, hi = value_range(df, col)
    cuts = cut_points(lo, hi, fractions)
    v = F.col(col)
    expr = F.when(v.isNull(), F.lit(unknown))
    for cut, label in zip(cuts, labels[:-1]):
        expr = expr.when(v < cut, F.lit(label))
    return df.withColumn(out, expr.otherwise(F.lit(labels[-1])))
