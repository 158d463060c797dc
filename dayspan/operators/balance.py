"""Class balance: histogram, balanced weights, deterministic resampling and
an exact-size undersample.

Per-class constants come from the label histogram, whose size is the number
of classes; totals over it are scalar subqueries. No per-class loop, no union
of per-class samples, no driver collect, no window over all classes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.functions.columns import hash_key, hash_unit
from dayspan.sources.tables import materialize


def label_histogram(df: DataFrame, label: str) -> DataFrame:
    """label, n, total, classes, share. The totals come from a scalar
    subquery over the histogram (pre-aggregated, one row)."""
    h = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = h.agg(F.struct(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))).scalar()
    return h.withColumn("total", every.getField("total")).withColumn("classes", every.getField("classes")) \
            .withColumn("share", F.col("n") / F.col("total"))


def _attach(df: DataFrame, per_class: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    # a row per class: joined in place, since rows shuffled by class would meet in one task for each class
    small = F.broadcast(per_class.select(F.col(label).alias("__lbl"), *cols))
    return df.join(small, df[label].eqNullSafe(small["__lbl"]), "left").drop("__lbl")


def class_weights(df: DataFrame, label: str, out: str = "weight", base: DataFrame | None = None) -> DataFrame:
    """Balanced weight ``total / (classes * n_class)`` on every row; weights
    of a class sum to ``total / classes``. ``base`` (default ``df``) is the
    frame the histogram is counted on, e.g. the training rows only."""
    h = label_histogram(base if base is not None else df, label)
    h = h.withColumn(out, F.col("total") / (F.col("classes") * F.col("n")))
    out_df = _attach(df, h, label, [out])
    return out_df.withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def sqrt_rates(df: DataFrame, label: str, out: str = "rate") -> DataFrame:
    """Per class: ``sqrt(max_share / share)`` -- the majority keeps its size,
    rarer classes are replicated up by the square root of the imbalance."""
    h = label_histogram(df, label)
    return h.withColumn(out, F.sqrt(h.agg(F.max("share")).scalar() / F.col("share"))).select(label, out)


def replicate(df: DataFrame, rate: Column | str, key: Sequence[str], salt: str = "resample",
              copy: str = "copy") -> DataFrame:
    """Each row kept ``floor(rate)`` times, plus once more when its md5 coin
    falls below the fractional part. Expected size = rate x rows, like
    sampling with replacement, but reproducible."""
    r = F.col(rate) if isinstance(rate, str) else rate
    whole = F.floor(r).cast("int")
    extra = F.when(hash_unit(key, salt) < (r - F.floor(r)), F.lit(1)).otherwise(F.lit(0))
    # the number of copies is named once: a filter on it beside the array would take the md5 a second time
    copies = F.posexplode(F.array_repeat(F.lit(True), whole + extra))
    return df.select("*", copies.alias("__at", "__copy")).withColumn(copy, F.col("__at") + 1).drop("__at", "__copy")


def resample(df: DataFrame, label: str, key: Sequence[str], rates: Mapping[object, float] | None = None,
             salt: str = "resample") -> DataFrame:
    """Resample classes by ``rates`` (class -> rate), or by ``sqrt_rates``
    when none are given. Classes missing from ``rates`` keep rate 1."""
    if rates is None:
        per = sqrt_rates(df, label, "__rate")
        with_rate = _attach(df, per, label, ["__rate"])
    else:
        expr = F.lit(1.0)
        for k, v in rates.items():
            expr = F.when(F.col(label) == F.lit(k), F.lit(float(v))).otherwise(expr)
        with_rate = df.withColumn("__rate", expr)
    return replicate(with_rate, "__rate", key, salt).drop("__rate")


def balance_exact(df: DataFrame, label: str, key: Sequence[str], levels: int = 3, width: int = 4) -> DataFrame:
    """Undersample every class to exactly the size of the smallest, keeping
    per class the rows with the smallest md5 of the key, then (rows that share
    a key) the smallest md5 of the whole row.

    Without a per-class sort: the md5 hex is read ``width`` digits at a time,
    ``levels`` times for the key (then its rest at once, for the few keys that
    agree so far) and as often for the row. At each level a
    histogram of (class, bucket) counts -- at most 16^width rows per class --
    locates the bucket holding the cut; rows below it are kept, rows above
    dropped, and only the rows inside it go to the next level. What is left at
    the cut are equal rows or a few whose digests agree so far; they are ranked
    as distinct rows with their counts, so a key that many rows share never
    gathers in one task.

    The frame is stored as it is and its rows are never shuffled: digests are computed when they are read
    (as text they would take far more room than the rows), and a level's cuts, a row per class, are broadcast.
    """
    cols = df.columns
    pending = materialize(df, "balance-base")
    digest = F.md5(hash_key(key))
    kept_parts, need = [], None
    digits = [(i * width, width) for i in range(levels)]
    # the key's digits level by level, then all that are left of it, then the row's
    for level, (at, n) in enumerate([*digits, (levels * width, 32 - levels * width), *[(32 + a, n) for a, n in digits]]):
        below = F.lit(0).cast("long") if level == 0 else F.col("__lo")  # rows of the class below the current bucket
        pending = pending.withColumn("__b", F.substring(digest, at + 1, n))
        counts = materialize(pending.groupBy(label, below.alias("__lo"), "__b").agg(F.count(F.lit(1)).alias("__c")), "balance-counts")
        if need is None:
            need = counts.groupBy(label).agg(F.sum("__c").alias("n")).agg(F.min("n")).scalar()
        counts = counts.withColumn("__need", need)
        w = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__before", F.col("__lo") + F.coalesce(F.sum("__c").over(w), F.lit(0)))
        whole = F.col("__before") + F.col("__c") <= F.col("__need")
        inside = ~whole & (F.col("__before") < F.col("__need"))
        cuts = counts.groupBy(F.col(label).alias("__cl")).agg(
            F.max(F.when(whole, F.col("__b"))).alias("__last"), F.max(F.when(inside, F.col("__b"))).alias("__cut"),
            F.max(F.when(inside, F.col("__before"))).alias("__at"))
        cuts = materialize(cuts, "balance-cuts")
        tagged = pending.drop("__lo").join(F.broadcast(cuts), pending[label].eqNullSafe(cuts["__cl"]))
        kept_parts.append(tagged.where(F.col("__b") <= F.col("__last")))
        # rows inside the cut bucket: about rows / 16^width per class and level
        pending = tagged.where(F.col("__b") == F.col("__cut")).withColumn("__lo", F.col("__at"))
        if level == 0:
            pending = pending.withColumn("__h", F.concat(digest, F.md5(hash_key(cols))))
            digest = F.col("__h")
        pending = materialize(pending.select(*cols, "__h", "__lo"), "balance-pending")
    alike = pending.groupBy(*pending.columns).agg(F.count(F.lit(1)).alias("__c"))
    rank = Window.partitionBy(label).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    left = need - F.col("__lo") - F.coalesce(F.sum("__c").over(rank), F.lit(0))
    last = alike.withColumn("__n", F.least(F.col("__c"), left)).where(F.col("__n") > 0) \
                .withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    out = last.select(*cols)
    for p in kept_parts:
        out = out.unionByName(p.select(*cols))
    return out
