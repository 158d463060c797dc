"""Small Column builders. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guarded_greatest(a: str | Column, b: str | Column) -> Column:
    """``greatest`` that is null when either side is null.

    Plain ``greatest`` skips nulls, which would turn a missing partner into a
    full-length overlap.
    """
    a, b = as_col(a), as_col(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a >= b, a).otherwise(b)


def guarded_least(a: str | Column, b: str | Column) -> Column:
    a, b = as_col(a), as_col(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a <= b, a).otherwise(b)


def days_inclusive(start: str | Column, end: str | Column) -> Column:
    """Number of calendar days in ``[start, end]`` (null if either is null)."""
    return F.datediff(as_col(end), as_col(start)) + F.lit(1)


def ratio(num: str | Column, den: str | Column) -> Column:
    """Division that yields null on a zero or null denominator (ANSI safe)."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def round_half_up(c: str | Column, digits: int) -> Column:
    """``F.round`` of a double, value for value, without decimal arithmetic on most rows.

    Away from a tie the nearest whole number of 10^-digits is plain; only what lies within 0.001 of
    a tie, or has 10^11 units and more (where a double is too coarse for that), NaN included, is left to ``F.round``.
    """
    x, unit = as_col(c).cast("double"), F.lit(10.0 ** digits)
    up = F.floor(x * unit + 0.5)
    plain = (F.abs(x * unit) < 1e11) & (F.abs(x * unit - up) < 0.499)
    return F.when(plain, up / unit).otherwise(F.round(x, digits))


def hash_key(cols: Sequence[str | Column]) -> Column:
    """Text key of one or more columns, the input of the md5 coins.

    Each column is written as ``length:text``, a null as ``n``, so that two
    keys share a text only if they are equal column by column.
    """
    parts = [as_col(c).cast("string") for c in cols]
    return F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("n")) for c in parts])


def hash_unit(cols: Sequence[str | Column], salt: str = "") -> Column:
    """Deterministic number in [0, 1) from the md5 of the key (and a salt).

    The first 8 hex digits of md5 read as an unsigned 32-bit integer, divided
    by 2^32. Reproducible across runs, engines and executor loss, unlike
    ``rand()``.
    """
    key = hash_key(cols)
    if salt:
        key = F.concat(key, F.lit(salt))
    top = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return top.cast("double") / F.lit(4294967296.0)


def blank(c: str | Column) -> Column:
    """True for text that is empty after trimming (null stays null)."""
    return F.trim(as_col(c)) == F.lit("")


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition on equal keys where null matches null."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond
