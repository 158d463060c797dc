"""Group values attached back to rows, folds and totals.

A value of a group (latest end, group size, total) is computed by a hash
aggregate, which combines map-side, and joined back on the keys. Compared with
a window over the keys, a hot key never has to sit in one task: the aggregate
is pre-combined and the rejoin can be split by AQE's skew handling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_value(df: DataFrame, keys: Sequence[str], value: Column, out: str,
                null_keys: str = "group", onto: DataFrame | None = None) -> DataFrame:
    """Attach ``value`` (an aggregate over the rows of each key) to every row
    (of ``onto``, when given: the rows that need it).

    ``null_keys='group'``: null is a key value like any other (rows with null
    keys get the value of their null group). ``'exclude'``: a row with a null
    key gets null, as an ordinary equi-join would give.
    """
    if null_keys not in ("group", "exclude"):
        raise ValueError("null_keys must be 'group' or 'exclude'")
    rows = df if onto is None else onto
    if null_keys == "group":
        # keys as one struct, in which nulls are equal: a join on it meets the groups where the aggregate left them
        agg = df.groupBy(F.struct(*keys).alias("__g")).agg(value.alias(out))
        return rows.join(agg, F.struct(*[rows[k] for k in keys]) == agg["__g"], "left").drop("__g")
    renamed = {k: f"__g_{i}" for i, k in enumerate(keys)}
    agg = df.groupBy(*keys).agg(value.alias(out)) \
            .select(*[F.col(k).alias(renamed[k]) for k in keys], out)
    return rows.join(agg, [rows[k] == agg[renamed[k]] for k in keys], "left").drop(*renamed.values())


def group_size(df: DataFrame, keys: Sequence[str], out: str = "group_size",
               null_keys: str = "group") -> DataFrame:
    """Number of rows sharing the keys, on every row."""
    return group_value(df, keys, F.count(F.lit(1)), out, null_keys)


def previous_end(df: DataFrame, keys: Sequence[str], end: str, as_of, out: str = "prev_end",
                 null_keys: str = "group", onto: DataFrame | None = None) -> DataFrame:
    """Day after the latest ``end`` on or before ``as_of`` within the keys
    (on every row, or on those of ``onto``)."""
    latest = F.max(F.when(F.col(end) <= F.lit(as_of), F.col(end)))
    return group_value(df, keys, F.date_add(latest, 1), out, null_keys, onto)


def fold_children(df: DataFrame, keys: Sequence[str], flag: str, out: str | None = None) -> DataFrame:
    """One row per parent key with the sum of the children's flags."""
    return df.groupBy(*keys).agg(F.sum(flag).cast("long").alias(out or flag))


def grand_totals(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """One row: ``{out: sum(col)}`` for each entry of ``cols``."""
    return df.agg(*[F.sum(c).cast("long").alias(o) for o, c in cols.items()])
