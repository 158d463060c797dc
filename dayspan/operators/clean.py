"""Cleaning and recoding: casts, rounding, blank/null defaults, flags,
filters, dedupes, and the code dictionary as a broadcast join."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.functions.columns import as_col, blank


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop listed columns; names that are absent are ignored."""
    return df.drop(*cols)


def dedupe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Full-row (or listed-column) dedupe. With ``cols`` the surviving row is
    arbitrary; use ``dedupe_keep_first`` when the survivor matters."""
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep, per key, the first row by ``order`` (which must be a total order
    within a key for a deterministic survivor).

    Done as a ``min_by`` over a struct of all columns keyed by the order
    columns: a hash aggregate with map-side combine, so a hot key is reduced
    in every map task instead of being sorted in one.
    """
    order = [as_col(o) for o in order]
    others = [c for c in df.columns if c not in keys]
    ordkey = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)])
    row = F.struct(*[F.col(c) for c in others])
    return df.groupBy(*keys).agg(F.min_by(row, ordkey).alias("__row")) \
             .select(*keys, *[F.col("__row")[c].alias(c) for c in others]) \
             .select(*df.columns)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns; a value that does not parse becomes null (``try_cast``),
    also under ANSI mode."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def round_columns(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Cast to double and round half-up to a fixed number of digits."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})


def fill_blank(df: DataFrame, defaults: Mapping[str, str], nulls: bool = False) -> DataFrame:
    """Replace blank text (after trim) by a default; with ``nulls`` also null."""
    out = {}
    for c, d in defaults.items():
        cond = blank(c)
        if nulls:
            cond = cond | F.col(c).isNull()
        out[c] = F.when(cond, F.lit(d)).otherwise(F.col(c))
    return df.withColumns(out)


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace null by a constant or by another column (a Column value)."""
    return df.withColumns({
        c: F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)) for c, v in values.items()})


def pad_code(df: DataFrame, col: str, width: int, default: str | None = None) -> DataFrame:
    """Keep a numeric code as text, left-padded with zeros; null -> default."""
    padded = F.lpad(F.col(col).cast("string"), width, "0")
    return df.withColumn(col, F.coalesce(padded, F.lit(default)) if default is not None else padded)


def presence_flag(df: DataFrame, text_col: str, id_col: str, out: str) -> DataFrame:
    """1 if ``text_col`` holds text, or it is blank while ``id_col`` holds a
    non-zero id; 0 otherwise (null text counts as absent)."""
    t, i = F.col(text_col), F.col(id_col)
    present = (t.isNotNull() & ~blank(t)) | (blank(t) & i.isNotNull() & (i != 0))
    return df.withColumn(out, F.when(present, F.lit(1)).otherwise(F.lit(0)))


def case_label(df: DataFrame, text_col: str, flag_col: str, if_one: str, if_zero: str,
               out: str | None = None) -> DataFrame:
    """Blank text becomes ``if_one`` / ``if_zero`` by the flag; text and null
    pass through."""
    t, f = F.col(text_col), F.col(flag_col)
    return df.withColumn(out or text_col,
                         F.when(blank(t) & (f == 1), F.lit(if_one))
                          .when(blank(t) & (f == 0), F.lit(if_zero))
                          .otherwise(t))


def cap_date(df: DataFrame, col: str, cap: str, out: str | None = None) -> DataFrame:
    """``col`` if it is not after ``cap``, else ``cap`` (null stays null)."""
    return df.withColumn(out or col, F.when(F.col(col) > F.col(cap), F.col(cap)).otherwise(F.col(col)))


def exclude_values(df: DataFrame, col: str, values: Iterable[object], keep_null: bool = True) -> DataFrame:
    """Remove rows whose ``col`` is in ``values``; nulls kept unless told."""
    c = F.col(col)
    cond = ~c.isin(*values)
    cond = (c.isNull() | cond) if keep_null else (c.isNotNull() & cond)
    return df.where(cond)


def ended_before(df: DataFrame, end: str, as_of: dt.date | str, inclusive: bool = True) -> DataFrame:
    """Rows whose ``end`` is on/before (or strictly before) ``as_of``.

    ``as_of`` is an argument, never the wall clock, so results are repeatable.
    """
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    e = F.col(end)
    return df.where(e <= F.lit(as_of) if inclusive else e < F.lit(as_of))


# ---- the code dictionary ----------------------------------------------------

def build_mapping(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Merge two ``(category, raw, canonical)`` tables: a category present in
    ``overrides`` replaces the whole default category."""
    cats = overrides.select("category").distinct()
    kept = defaults.join(cats, "category", "left_anti")
    return kept.unionByName(overrides.select("category", "raw", "canonical"))


def recode(df: DataFrame, mapping: DataFrame, bindings: Mapping[str, str]) -> DataFrame:
    """Replace coded values through the dictionary; unknown values pass.

    ``bindings`` maps a column to its category. A raw value listed twice in
    a category keeps its smallest canonical value. The planner broadcasts the
    mapping if its measured size allows (adaptive execution), else it shuffles.
    """
    out = df
    for col, cat in bindings.items():
        # one canonical value per raw value, so the join never multiplies rows
        m = mapping.where(F.col("category") == cat).groupBy(F.col("raw").alias("__raw")) \
                   .agg(F.min("canonical").alias("__canon"))
        out = out.join(m, out[col] == m["__raw"], "left") \
                 .withColumn(col, F.coalesce(F.col("__canon"), F.col(col))) \
                 .drop("__raw", "__canon")
    return out
