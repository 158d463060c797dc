"""Data-quality reports: column profile, prevalence, rule violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long table: column, rows, nulls, blanks, distinct (exact, non-null).

    The frame is unpivoted to (column, text value); the distinct count groups
    by (column, value) first, so the work spreads over the values.
    """
    cols = list(cols or df.columns)
    longf = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value")
    return longf.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.count_if(F.trim(F.col("value")) == "").alias("blanks"),
        F.countDistinct("value").alias("distinct_values"),
    )


#: relative error (one standard deviation) of the distinct counts: 1.04 / sqrt(2^12); and the share by which
#: the rank of a quantile may be off, at 99% confidence, with 200 items a level
DISTINCT_ERROR, RANK_ERROR = 1.04 / 64, 0.0133


def profile_sketched(df: DataFrame, cols: Sequence[str] | None = None, top: int = 3) -> DataFrame:
    """The profile in one pass that makes no row per column: column, rows, nulls, blanks,
    distinct_values (estimated), median (of numbers and of dates, as days since 1970; estimated, null for others),
    most_frequent (array of value, n; estimated).

    Every column is one set of mergeable sketches (HyperLogLog, KLL, frequent items) of bounded
    size, so a task sends a few KB for each column, whatever its rows and values. Errors: ``DISTINCT_ERROR``,
    ``RANK_ERROR``; ``profile`` is the exact form.
    """
    cols = list(cols or df.columns)
    kinds = {c: df.schema[c].dataType for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        text = F.col(c).cast("string")
        number = (F.col(c).cast("double") if isinstance(kinds[c], NumericType)
                  else F.unix_date(c).cast("double") if isinstance(kinds[c], DateType) else None)
        median = F.lit(None).cast("double")
        marked = F.concat(F.lit("="), text)  # the sketch leaves out empty text
        if number is not None:
            sketch = F.kll_sketch_agg_double(F.when(~F.isnan(number), number))
            median = F.when(F.count(number) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(0.5)))
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(text.isNull()).alias("nulls"),
            F.count_if(F.trim(text) == "").alias("blanks"), F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(marked, 12)), F.lit(0).cast("long")).alias("distinct_values"),
            median.alias("median"), F.transform(F.filter(F.expr(f"approx_top_k(cast(`{c}` as string), {top + 1})"), lambda x: x["item"].isNotNull()),
                                                lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n"))).alias("most_frequent")).alias(f"c{i}"))
    one = df.agg(*aggs).select(F.explode(F.array(*[f"c{i}" for i in range(len(cols))])).alias("p"))
    return one.select("p.*").withColumn("most_frequent", F.slice("most_frequent", 1, top))


def prevalence(df: DataFrame, label: str, positive=1, out: str = "prevalence") -> DataFrame:
    """One row: rows, positives and their share."""
    pos = F.count_if(F.col(label) == F.lit(positive))
    return df.agg(F.count(F.lit(1)).alias("rows"), pos.alias("positives"),
                  F.round(pos / F.count(F.lit(1)), 6).alias(out))


def violations(df: DataFrame, id_cols: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Long report ``(rule, *id_cols)``: distinct ids breaking each rule.

    One pass over ``df``: every row emits the names of the rules it breaks.
    """
    hits = F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])
    return df.select(F.explode(hits).alias("rule"), *id_cols).where(F.col("rule").isNotNull()).distinct()
