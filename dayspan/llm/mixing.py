"""Operator 2: mixing sources to target weights on a time-varying curriculum.

Every source gets a target number of words (water-filling of the weights under
a cap of ``max_repeats`` times its size) and a weight schedule over training
time ``t`` in [0, 1], piecewise linear through its knots. The integral of the
schedule, scaled to the target, is the source's cumulative word demand; a
document copy that covers demand interval [a, b) of its source stands at the
time whose cumulative demand is ``a``. ``arrange`` range-sorts copies by it.

Only ids, sizes and sources move; texts do not. Prefix sums within a source go
over ``BUCKETS`` hash buckets first, so a source with most of the rows is
spread over that many groups.

Nulls: a null or empty text has size 0, is taken 0 words and has no copies; a
null source is a source of its own, sorted last. Repeated rows are documents of
their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.llm.common import WORD, row_key, saved

BUCKETS = 4096
#: relative weight at t = 0, 1/2 and 1, by the source's base weight: heavy sources fade, light ones rise
SCHEDULES = {5: (1.4, 1.0, 0.6), 2: (0.8, 1.0, 1.2), 1: (0.5, 1.0, 1.5)}


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """One row per source: source_size, weight, target, training_words (all sizes).

    The fixed point of resharing is min(cap, level x weight) with one level for
    all: sources sorted by cap/weight, the capped ones are those whose ratio
    lies below the level that the rest would get.
    """
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    s = s.withColumn("level", left / free)  # if all before are capped and none from here on
    s = s.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every))
    capped = F.col("level").isNull() | (F.col("ratio") <= F.col("level"))
    return s.select("source", "source_size", "weight", F.sum("source_size").over(every).alias("training_words"),
                    F.when(capped, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def time_of(share: Column, knots: Column) -> Column:
    """The time at which the share (0 to 1) of a source's demand is reached.

    ``knots``: relative weights at equally spaced times. The cumulative demand
    is quadratic in each piece; the piece that holds the share is inverted.
    """
    n = F.size(knots) - 1
    piece = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        i.alias("i"), F.element_at(knots, i + 1).alias("v0"), F.element_at(knots, i + 2).alias("v1")))
    area = F.aggregate(piece, F.lit(0.0), lambda a, p: a + (p["v0"] + p["v1"]) / 2)
    state = F.struct((share * area).alias("rest"), F.lit(None).cast("double").alias("at"))

    def step(s, p):
        here = (p["v0"] + p["v1"]) / 2
        rest, slope = s["rest"], p["v1"] - p["v0"]
        root = F.sqrt(F.greatest(p["v0"] * p["v0"] + 2 * slope * rest, F.lit(0.0)))
        inside = F.try_divide(2 * rest, p["v0"] + root)
        is_here = s["at"].isNull() & ((rest <= here) | (p["i"] == n - 1))
        return F.struct((rest - here).alias("rest"),
                        F.when(is_here, p["i"] + F.least(F.coalesce(inside, F.lit(0.0)), F.lit(1.0))).otherwise(s["at"]).alias("at"))

    return F.aggregate(piece, state, step)["at"] / n


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3,
        schedules: dict[int, Sequence[float]] = SCHEDULES, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, key, size, source_size, target, taken and
    ``copies``, an array of (copy, words, position) with position in words of
    the whole training run. The last copy of a source's order may be cut at
    the end of the target (words < size), so that taken sums to the target's
    whole words."""
    coin = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    sizes = saved(docs.select("doc_id", "source", word_count().alias("size"), row_key().alias("key"))
                  .withColumn("coin", coin)
                  .withColumn("bucket", F.conv(F.substring("coin", 1, 3), 16, 10).cast("int") % BUCKETS), "sizes")
    targets = saved(source_targets(sizes, weights, max_repeats), "targets")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (sizes.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
             .withColumn("ahead", F.coalesce(F.sum("in_bucket").over(before), F.lit(0).cast("long"))))
    ahead = (ahead.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "in_bucket")
             .withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"))
    own = Window.partitionBy("source", "bucket").orderBy("coin", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0).cast("long")))
    placed = placed.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    knots = F.lit(None).cast("array<double>")
    for w, k in schedules.items():
        knots = F.when(F.col("weight") == w, F.array(*[F.lit(float(x)) for x in k])).otherwise(knots)
    knots = F.coalesce(knots, F.array(F.lit(1.0), F.lit(1.0)))
    goal = F.floor("target").cast("long")
    place = F.col("ahead") + F.col("inner")

    def copy(k: int) -> Column:
        at = F.lit(k) * F.col("source_size") + place
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - at))
        share = F.least(F.coalesce(F.try_divide(at.cast("double"), F.col("target")), F.lit(0.0)), F.lit(1.0))
        return F.struct(F.lit(k).alias("copy"), words.alias("words"),
                        (time_of(share, knots) * F.col("training_words")).alias("position"))

    copies = F.filter(F.array(*[copy(k) for k in range(max_repeats)]), lambda c: c["words"] > 0)
    placed = placed.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return placed.select("doc_id", "key", "size", "source_size", "target", taken.alias("taken"), "copies")


def arrange(plan: DataFrame) -> DataFrame:
    """One row per copy in training order: range-partitioned and sorted by position."""
    return (plan.select("*", F.explode("copies").alias("c")).select("*", "c.copy", "c.words", "c.position")
            .drop("c", "copies").orderBy("position", "doc_id", "copy"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order, whole texts, one row per
    copy; a copy cut by the end of a target stays if half of it is inside.
    Clashing column names are safe: the row travels as one struct."""
    plan = mix(docs, **options)
    # rows that repeat id and text share a key and take the copies of one of them each
    copies = (plan.groupBy("key").agg(F.max(F.struct(F.size("copies").alias("n"), F.col("size"), F.col("copies"))).alias("m"))
              .select(F.col("key").alias("mix_key"), "m.size", F.explode("m.copies").alias("c"))
              .where(F.col("c.words") * 2 >= F.col("size")))
    names = [F.col("d")[c].alias(c) for c in docs.columns]
    rows = docs.select(F.struct("*").alias("d"), row_key().alias("row_key"))
    rows = rows.join(copies, F.col("row_key") == F.col("mix_key"))
    return rows.orderBy("c.position", "row_key", "c.copy").select(*names)
