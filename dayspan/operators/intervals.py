"""Span operators: clip, repair, measure, overlap-join, expand to days, fold.

Spans are closed date intervals ``[start, end]`` held in two DateType columns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from dayspan.functions.columns import as_col, days_inclusive, guarded_greatest, guarded_least, ratio
from dayspan.sources.tables import materialize


def _lit_date(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        x = dt.date.fromisoformat(x)
    return F.lit(x)


def clip_span(df: DataFrame, start: str, end: str, low, high,
              out_start: str = "span_start", out_end: str = "span_end",
              drop_empty: bool = True) -> DataFrame:
    """Clip ``[start, end]`` to the observation window ``[low, high]``.

    Null dates stay null. With ``drop_empty`` spans that do not touch the
    window (clipped end before clipped start, or a null bound) are removed,
    so that nothing downstream expands a negative or unknown length.
    """
    lo, hi = _lit_date(low), _lit_date(high)
    s, e = as_col(start), as_col(end)
    out = df.withColumn(out_start, F.when(s < lo, lo).otherwise(s)) \
            .withColumn(out_end, F.when(e > hi, hi).otherwise(e))
    if drop_empty:
        out = out.where(F.col(out_start) <= F.col(out_end))
    return out


def repair_open_ended(df: DataFrame, start: str, end: str, prev_end: str,
                      open_year: int = 9999, out: str | None = None) -> DataFrame:
    """An open-ended span (end in ``open_year``) starts at ``prev_end`` when a
    previous closed span exists; otherwise its start is kept."""
    out = out or start
    return df.withColumn(
        out,
        F.when((F.year(F.col(end)) == open_year) & F.col(prev_end).isNotNull(), F.col(prev_end))
         .otherwise(F.col(start)))


def span_days(df: DataFrame, start: str, end: str, out: str = "span_days") -> DataFrame:
    """Inclusive length in days."""
    return df.withColumn(out, days_inclusive(start, end))


def _overlap_columns(l_start: Column, l_end: Column, r_start: Column, r_end: Column,
                     out_start: str, out_end: str) -> list[Column]:
    return [guarded_greatest(l_start, r_start).alias(out_start),
            guarded_least(l_end, r_end).alias(out_end)]


def interval_overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                          left_span: tuple[str, str], right_span: tuple[str, str],
                          how: str = "left", right_prefix: str = "r_",
                          out_span: tuple[str, str] = ("overlap_start", "overlap_end"),
                          hot: float | None = None, clamp: tuple | None = None) -> DataFrame:
    """Join rows of ``left`` to rows of ``right`` that share the ``on`` keys
    and whose spans overlap (touching ends count). The overlap, clipped to both
    spans, is added as ``out_span`` (null for an unmatched left row).

    A span with a null bound or with its end before its start overlaps nothing.
    Right columns other than the keys are renamed with ``right_prefix``.
    Planned as a sort-merge (or AQE broadcast) join on the keys with the
    range test as residual.

    ``hot`` (a share of the rows, e.g. 0.001): keys with at least about that share of either
    side go through ``interval_overlap_join_bucketed``, whose grid of months spreads
    them over many tasks; all others stay on the plain path, which copies nothing.
    The keys are found by ``hot_keys``; a key taken for hot by mistake costs time only. Key columns of
    two types (integers aside) are joined by the plain path alone. ``clamp`` as there;
    by default the range of the overlaps' first days, taken from the data.
    """
    if hot is not None:
        return _hot_and_cold(left, right, on, left_span, right_span, how, right_prefix, out_span, hot, clamp)
    ls, le = left_span
    r = right.select(*on, *[F.col(c).alias(right_prefix + c) for c in right.columns if c not in on])
    rs, re_ = right_prefix + right_span[0], right_prefix + right_span[1]
    cond = [left[k] == r[k] for k in on] + [r[rs] <= left[le], r[re_] >= left[ls], left[ls] <= left[le], r[rs] <= r[re_]]
    joined = left.join(r, cond, how)
    keep = [left[c] for c in left.columns] + [r[c] for c in r.columns if c not in on]
    return joined.select(*keep, *_overlap_columns(left[ls], left[le], r[rs], r[re_], *out_span))


def _key_hash(on: Sequence[str]) -> Column:
    """By text, so that integers of two widths agree."""
    return F.xxhash64(*[F.col(k).cast("string") for k in on])


def hot_keys(df: DataFrame, on: Sequence[str], share: float) -> list[int]:
    """Hashes of the keys with ``share`` or more of the rows, by a top-k sketch in one pass.

    The sketch holds a bounded number of items a task (a few for each of the 1 / share keys
    there can be) and merges; its error is far below the share asked for, and half the share is
    taken, so no key of the full share is missed. At most 2 / share + 1 numbers reach the driver.
    """
    if not 0 < share <= 1:
        raise ValueError("hot must be a share of the rows, above 0 and at most 1")
    most = min(10_000, int(2 / share) + 1)
    found = df.where(_all_set(on)).select(_key_hash(on).alias("k")).agg(
        F.expr(f"approx_top_k(k, {most}, {min(1_000_000, 16 * most)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [int(r["item"]) for r in found["top"] or [] if r["count"] * 2 >= share * found["n"]]


def _all_set(on: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(k).isNotNull()
    return cond


def _hot_and_cold(left, right, on, left_span, right_span, how, right_prefix, out_span, hot, clamp) -> DataFrame:
    plain = {"how": how, "right_prefix": right_prefix, "out_span": out_span}
    # each side is read for the keys, the range, the plain path and the grid
    left, right = materialize(left, "overlap-left"), materialize(right, "overlap-right")
    # keys that are equal must have one text: the same type on both sides, or integers
    whole = (ByteType, ShortType, IntegerType, LongType)
    one_text = all(a == b or isinstance(a, whole) and isinstance(b, whole) for a, b in ((left.schema[k].dataType, right.schema[k].dataType) for k in on))
    keys = sorted({*hot_keys(left, on, hot), *hot_keys(right, on, hot)}) if one_text else []
    if not keys:
        return interval_overlap_join(left, right, on, left_span, right_span, **plain)
    is_hot = _all_set(on) & _key_hash(on).isin(keys)  # at most 4 / hot + 2 numbers
    if clamp is None:
        # an overlap begins where one of its two spans does
        ends = [df.where(is_hot & (F.col(s) <= F.col(e))).agg(F.min(s).alias("low"), F.max(s).alias("high")).first()
                for df, (s, e) in ((left, left_span), (right, right_span))]
        if any(r["low"] is None for r in ends):  # no span of a hot key on one side
            return interval_overlap_join(left, right, on, left_span, right_span, **plain)
        clamp = (max(r["low"] for r in ends), max(r["high"] for r in ends))
    cold = interval_overlap_join(left.where(~F.coalesce(is_hot, F.lit(False))), right.where(~F.coalesce(is_hot, F.lit(False))),
                                 on, left_span, right_span, **plain)
    spread = interval_overlap_join_bucketed(left.where(is_hot), right.where(is_hot), on, left_span, right_span, clamp, **plain)
    return cold.unionByName(spread)


def _month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def month_pieces(df: DataFrame, start: str, end: str, low, high, out: str) -> DataFrame:
    """One row for each calendar month that a span shares with ``[low, high]``
    (month index in ``out``); spans that are null, inverted or outside yield none."""
    valid = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    m0 = F.greatest(_month_index(F.col(start)), _month_index(_lit_date(low)))
    m1 = F.least(_month_index(F.col(end)), _month_index(_lit_date(high)))
    return valid.withColumn("__m0", m0).withColumn("__m1", m1).where(F.col("__m0") <= F.col("__m1")) \
                .withColumn(out, F.explode(F.sequence(F.col("__m0"), F.col("__m1")))).drop("__m0", "__m1")


def interval_overlap_join_bucketed(left: DataFrame, right: DataFrame, on: Sequence[str],
                                   left_span: tuple[str, str], right_span: tuple[str, str], clamp: tuple,
                                   how: str = "left", right_prefix: str = "r_",
                                   out_span: tuple[str, str] = ("overlap_start", "overlap_end")) -> DataFrame:
    """Same result as ``interval_overlap_join``, skew-safe.

    Both sides are split into calendar months; the equi-join runs on the keys
    plus the month, so one key with many spans is spread over as many tasks as
    it has months, and only spans sharing a month are compared. Each pair is
    kept once: in the month where the overlap starts.

    ``clamp`` is the ``(low, high)`` date range known to hold every overlap
    (e.g. the observation window the spans were clipped to); spans are split
    within it only, so a sentinel end such as 9999-12-31 does not explode.

    For ``how='left'`` the left rows get an identity of their own in a stage
    table (no column of ``left`` need be unique), and the rows without a pair are
    added back with null partner columns. They are found by a semi join, which ends at a row's
    first partner. No pair is stored: what is written grows with the rows, not with the pairs.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    ls, le = left_span
    cols, right_cols = left.columns, [c for c in right.columns if c not in on]
    rkey = {k: f"__rk{i}" for i, k in enumerate(on)}
    r = right.select(*[F.col(k).alias(rkey[k]) for k in on], *[F.col(c).alias(right_prefix + c) for c in right_cols])
    rs, re_ = right_prefix + right_span[0], right_prefix + right_span[1]
    if how == "left":
        left = materialize(left.withColumn("__row", F.monotonically_increasing_id()), "overlap-left")
        r = materialize(r, "overlap-right")
    lb, rb = month_pieces(left, ls, le, *clamp, "__lm"), month_pieces(r, rs, re_, *clamp, "__rm")
    cond = [F.col(k) == F.col(rkey[k]) for k in on] + [
        F.col("__lm") == F.col("__rm"), F.col(rs) <= F.col(le), F.col(re_) >= F.col(ls)]
    # the overlap may start before the range: it then counts in the range's first month
    starts = F.greatest(_month_index(guarded_greatest(F.col(ls), F.col(rs))), _month_index(_lit_date(clamp[0])))
    pairs = lb.join(rb, cond, "inner").where(starts == F.col("__lm"))
    overlap = _overlap_columns(F.col(ls), F.col(le), F.col(rs), F.col(re_), *out_span)
    partner = [right_prefix + c for c in right_cols]
    if how == "inner":
        return pairs.select(*cols, *partner, *overlap)
    met = lb.join(rb, cond, "left_semi").select("__row")  # two spans that share a month of the grid and overlap are a pair
    lone = left.join(met, "__row", "left_anti")
    pairs = pairs.select(*cols, *partner, *overlap)
    types = dict(pairs.dtypes)
    lone = lone.select(*cols, *[F.lit(None).cast(types[c]).alias(c) for c in [*partner, *out_span]])
    return pairs.unionByName(lone)


def count_copies(df: DataFrame, cols: Sequence[str], out: str = "copies") -> DataFrame:
    """The distinct ``cols`` with the number of rows that agree in them, combined in every task: a join
    meets such a class once, and each of its pairs stands for ``out`` pairs of rows."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def overlap_days(df: DataFrame, start: str, end: str, out: str = "overlap_days") -> DataFrame:
    """Days of an overlap; 0 when there is none (null start)."""
    return df.withColumn(out, F.when(F.col(start).isNull(), F.lit(0)).otherwise(days_inclusive(start, end)))


def event_pieces(events: DataFrame, keys: Sequence[str], event_span: tuple[str, str], clamp: tuple,
                 label: str | None = None, distinct: bool = False) -> DataFrame:
    """The events' share of every calendar month they touch inside ``clamp``: the keys as __k0, __k1, ...,
    __em (month index), __d1 and __d2 (days of the month), __begins (the event's first day, clamped, lies in this month), __label.

    ``distinct``: events that agree in keys, span (before it is clamped) and label count once. They are told apart piece
    by piece, after the pieces are dealt by keys and month (a hot key's to a task a month), so that a fold by these needs no further shuffle."""
    es, ee = event_span
    low, high = _lit_date(clamp[0]), _lit_date(clamp[1])
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    own = events.where((F.col(es) <= F.col(ee)) & (F.col(es) <= high) & (F.col(ee) >= low)).select(
        *names, (F.col(label) if label else F.lit(None).cast("string")).alias("__label"),
        F.col(es).alias("__from"), F.col(ee).alias("__to"))
    first, last = F.greatest(F.col("__from"), low).alias("__es"), F.least(F.col("__to"), high).alias("__ee")
    pieces = month_pieces(own, "__from", "__to", *clamp, "__em")
    if distinct:
        pieces = pieces.repartition(*[f"__k{i}" for i in range(len(keys))], "__em").distinct()
    pieces = pieces.select("*", first, last)
    begins, ends = _month_index(F.col("__es")) == F.col("__em"), _month_index(F.col("__ee")) == F.col("__em")
    return pieces.select(*[f"__k{i}" for i in range(len(keys))], "__em", "__label", begins.alias("__begins"),
                         F.when(begins, F.dayofmonth("__es")).otherwise(1).alias("__d1"),
                         F.when(ends, F.dayofmonth("__ee")).otherwise(31).alias("__d2"))


def _mask(first: str | Column, last: str | Column) -> Column:
    """A long with the bits of the days ``first`` .. ``last`` of a month (day 1 is bit 0)."""
    one, first, last = F.lit(1).cast("long"), as_col(first), as_col(last)
    return F.call_function("shiftleft", F.call_function("shiftleft", one, last - first + 1) - one, first - 1)


def month_masks(events: DataFrame, keys: Sequence[str], event_span: tuple[str, str], clamp: tuple,
                label: str | None = None) -> DataFrame:
    """Per keys (__k0, ...) and month (__em): __any, the covered days as a bit mask, and with ``label``
    __marks, an array of (label, mask).

    An event is one row per month it touches, and days are folded by OR, which
    combines in every task and meets in one shuffle: a hot key sends a task's distinct (label, days) of a month, at most 496 a label."""
    names = [f"__k{i}" for i in range(len(keys))]
    p = event_pieces(events, keys, event_span, clamp, label).withColumn("__mask", _mask("__d1", "__d2"))
    covered = F.bit_or("__mask").alias("__any")
    if not label:
        return p.groupBy(*names, "__em").agg(covered)
    parts = F.collect_set(F.struct(F.col("__label").alias("label"), F.col("__mask").alias("mask")))
    return p.groupBy(*names, "__em").agg(covered, parts.alias("__parts")).select(*names, "__em", "__any", _by_label("__parts").alias("__marks"))


def _by_label(parts: str | Column) -> Column:
    """An array of (label, mask) with one mask for each label, from one with several."""
    zero = F.lit(0).cast("long")

    def union(label: Column) -> Column:
        own = F.filter(parts, lambda x: x["label"].eqNullSafe(label))
        return F.struct(label.alias("label"), F.aggregate(own, zero, lambda acc, x: acc.bitwiseOR(x["mask"])).alias("mask"))

    labels = F.array_distinct(F.transform(parts, lambda x: x["label"]))
    return F.when(F.size(parts) == 1, as_col(parts)).otherwise(F.transform(labels, union))


def _row_pieces(rows: DataFrame, row_span: tuple[str, str]) -> DataFrame:
    """``rows`` once per month of their span (__m; __p1 .. __p2 the piece's dates)."""
    rs, re_ = F.col(row_span[0]), F.col(row_span[1])
    pieces = rows.where(rs <= re_).withColumn("__m", F.explode(F.sequence(_month_index(rs), _month_index(re_))))
    first = F.expr("make_date(int(`__m` div 12), int(`__m` % 12 + 1), 1)")
    return pieces.withColumns({"__p1": F.greatest(rs, first), "__p2": F.least(re_, F.last_day(first))})


def _meet_months(rows: DataFrame, months: DataFrame, keys: Sequence[str], row_span: tuple[str, str], how: str = "left") -> DataFrame:
    """The ``_row_pieces`` of ``rows`` with what ``months`` has for the keys and month."""
    on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)] + [F.col("__m") == F.col("__em")]
    return _row_pieces(rows, row_span).join(months, on, how)


def flagged_days(rows: DataFrame, events: DataFrame, keys: Sequence[str], row_span: tuple[str, str],
                 event_span: tuple[str, str], clamp: tuple, label: str | None = None) -> DataFrame:
    """``rows`` expanded to days: day, flag (1 if an event of the same keys covers the day) and, with
    ``label``, labels (sorted distinct non-blank labels of those events; null without a flag).

    Events are folded per keys and month (``month_masks``) before they meet
    anything. A row meets one folded row a month, in one shuffle of its
    months, and is expanded after it: no pairs, no set per row and day. A key with most of the
    rows is spread over its months. ``clamp`` bounds every event day that counts.
    """
    met = _meet_months(rows, month_masks(events, keys, event_span, clamp, label), keys, row_span)
    return _flag_days(met, rows.columns, bool(label))


def flagged_days_of(rows: DataFrame, months: str, row_span: tuple[str, str]) -> DataFrame:
    """The days of ``flagged_days`` with labels, from rows that hold the months of the events they overlap in the column
    ``months`` (``overlap_day_totals`` with a label; null: none), which is dropped. Nothing is joined or shuffled."""
    here = F.get(F.filter(months, lambda x: x["month"] == F.col("__m")), F.lit(0))
    met = _row_pieces(rows, row_span).withColumn("__here", here)
    met = met.withColumns({"__any": F.col("__here")["any"], "__marks": F.col("__here")["marks"]})
    return _flag_days(met, [c for c in rows.columns if c != months], True)


def _flag_days(met: DataFrame, columns: Sequence[str], label: bool) -> DataFrame:
    """Pieces of rows with __any (and __marks) of their month, expanded to days with flag (and labels)."""
    extra = ["__any", *(["__marks"] if label else [])]
    days = met.select(*columns, *extra, F.explode(F.sequence("__p1", "__p2")).alias("day"))
    bit = F.dayofmonth("day") - 1
    days = days.withColumn("flag", F.coalesce(F.bit_get("__any", bit).cast("int"), F.lit(0)))
    if label:
        here = F.filter("__marks", lambda m: (F.trim(m["label"]) != "") & (F.bit_get(m["mask"], bit) == 1))
        several = F.array_sort(F.transform(here, lambda m: m["label"]))
        only = F.get("__marks", F.lit(0))["label"]  # of a month with one label every flagged day has it
        one = F.when(F.trim(only) != "", F.array(only)).otherwise(F.array().cast("array<string>"))
        days = days.withColumn("labels", F.when(F.col("flag") == 1, F.when(F.size("__marks") == 1, one).otherwise(several)))
    return days.drop(*extra)


def overlap_day_rows(rows: DataFrame, events: DataFrame, row_id: str, keys: Sequence[str],
                     row_span: tuple[str, str], event_span: tuple[str, str], clamp: tuple,
                     label: str | None = None, day: str = "day") -> DataFrame:
    """Distinct (row_id, day[, label]) for the days of a row's span that an
    event of the same keys covers (from the folded months, see ``flagged_days``)."""
    months = month_masks(events, keys, event_span, clamp, label)
    narrow = rows.select(F.col(row_id).alias("__id"), *keys, F.col(row_span[0]).alias("__rs"), F.col(row_span[1]).alias("__re"))
    met = _meet_months(narrow, months, keys, ("__rs", "__re")).where(F.col("__any").isNotNull())
    marks = F.col("__marks") if label else F.array(F.struct(F.lit(None).cast("string").alias("label"), F.col("__any").alias("mask")))
    met = met.select("__id", "__p1", "__p2", F.explode(marks).alias("__mark"))
    days = met.select("__id", "__mark", F.explode(F.sequence("__p1", "__p2")).alias(day))
    days = days.where(F.bit_get("__mark.mask", F.dayofmonth(day) - 1) == 1)
    return days.select(F.col("__id").alias(row_id), day, *([F.col("__mark.label").alias(label)] if label else []))


#: items of a month up to which the days of its labels are found after a join, for the rows that meet it
FEW = 4


def month_changes(events: DataFrame, keys: Sequence[str], event_span: tuple[str, str], clamp: tuple,
                  label: str | None = None, distinct: bool = False, marks: bool = False) -> DataFrame:
    """The events of every keys (__k0, ...) and month (__em): __changes, an array of (first, last, n, begun): n events are
    active on the days first .. last of the month and begun of them begin on day first; and __any, the covered days as a bit mask.
    With ``marks`` the items also name their label, and a month with more than ``FEW`` of them has __marks, as in ``month_masks``
    (else null: ``_marks`` finds them from the items, so that rows stay narrow in a join).

    Equal pieces are counted first, a row each. A month with more than 31 kinds of them holds a day each instead
    (first = last, the events active on it), so it holds 31 items at most, whatever the number of events.
    ``distinct``: see ``event_pieces``; one shuffle, by keys and month, then serves these steps and a join on them."""
    names = [f"__k{i}" for i in range(len(keys))]
    p = event_pieces(events, keys, event_span, clamp, label, distinct)
    p = p.groupBy(*names, "__em", *(["__label"] if marks else []), "__d1", "__d2", "__begins").agg(F.count(F.lit(1)).alias("__n"))
    begun = F.when(F.col("__begins"), F.col("__n")).otherwise(F.lit(0).cast("long"))
    item = F.struct(*([F.col("__label").alias("label")] if marks else []),
                    F.col("__d1").alias("first"), F.col("__d2").alias("last"), F.col("__n").alias("n"), begun.alias("begun"))
    p = p.groupBy(*names, "__em").agg(F.bit_or(_mask("__d1", "__d2")).alias("__any"), F.collect_list(item).alias("__items"))
    none = F.lit(None).cast(events.schema[label].dataType) if marks else None
    changes = F.when(F.size("__items") <= 31, F.col("__items")).otherwise(_by_day("__items", none)).alias("__changes")
    found = [F.when(F.size("__items") > FEW, _marks("__items")).alias("__marks")] if marks else []
    return p.select(*names, "__em", "__any", changes, *found)


def _by_day(items: str | Column, label: Column | None = None) -> Column:
    """The same events as one item for each day that any of them covers (with ``label``, when given)."""
    zero = F.lit(0).cast("long")

    def on(day: Column) -> Column:
        active = F.aggregate(items, zero, lambda acc, x: acc + F.when((x["first"] <= day) & (x["last"] >= day), x["n"]).otherwise(zero))
        begun = F.aggregate(items, zero, lambda acc, x: acc + F.when(x["first"] == day, x["begun"]).otherwise(zero))
        return F.struct(*([label.alias("label")] if label is not None else []),
                        day.alias("first"), day.alias("last"), active.alias("n"), begun.alias("begun"))

    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(31)), on), lambda x: x["n"] > 0)


def _marks(changes: str) -> Column:
    """An array of (label, mask), one mask for each label, from items of ``month_changes`` that name their label."""
    return _by_label(F.transform(changes, lambda x: F.struct(x["label"].alias("label"), _mask(x["first"], x["last"]).alias("mask"))))


def overlap_day_totals(rows: DataFrame, events: DataFrame, row_id: str, keys: Sequence[str],
                       row_span: tuple[str, str], event_span: tuple[str, str], clamp: tuple,
                       total: str = "overlap_days", days: str = "covered_days", events_met: str = "events",
                       label: str | None = None, months: str | None = None, distinct: bool = False) -> DataFrame:
    """Per row that any event of the same keys overlaps: the sum of its overlaps
    in days (``total``, a day under two events counts twice), the number of
    covered days (``days``) and the number of events met (``events_met``).
    ``months``: also an array (month, any, marks) of the months of its span in which it meets
    events: their days, and those of each label, as bit masks, for ``flagged_days_of``.
    ``distinct``: events that agree in keys, span and label count once.

    A sum over each month's ``month_changes`` within the row's piece of the month: no day is expanded
    and no event is compared with a row. Linear in rows, events and the months they touch, also
    for a key with most of the rows. ``clamp`` bounds every overlap.
    """
    low, high = _lit_date(clamp[0]), _lit_date(clamp[1])
    rs, re_ = F.greatest(F.col(row_span[0]), low), F.least(F.col(row_span[1]), high)
    bounded = F.col(row_span[0]).isNotNull() & F.col(row_span[1]).isNotNull() & (F.col(row_span[0]) <= F.col(row_span[1]))
    narrow = rows.where(bounded).select(F.col(row_id).alias("__id"), *keys, rs.alias("__rs"), re_.alias("__re"))
    folded = month_changes(events, keys, event_span, clamp, label, distinct, marks=months is not None)
    met = _meet_months(narrow, folded, keys, ("__rs", "__re"), "inner")
    month = F.struct(F.col("__em").alias("month"), F.col("__any").alias("any"), F.coalesce("__marks", _marks("__changes")).alias("marks")) if months else F.lit(None)
    met = met.select("__id", "__any", "__changes", month.alias("__month"), F.dayofmonth("__p1").alias("__a"), F.dayofmonth("__p2").alias("__b"),
                     (F.col("__p1") == F.col("__rs")).alias("__first"))
    zero, a, b = F.lit(0).cast("long"), F.col("__a"), F.col("__b")
    active = F.aggregate("__changes", zero, lambda acc, c: acc + c["n"] * F.greatest(
        F.lit(0), F.least(b, c["last"]) - F.greatest(a, c["first"]) + 1))
    at_start = F.aggregate("__changes", zero, lambda acc, c: acc + F.when((c["first"] <= a) & (c["last"] >= a), c["n"]).otherwise(zero))
    begun = F.aggregate("__changes", zero, lambda acc, c: acc + F.when(
        (c["first"] > F.when(F.col("__first"), a).otherwise(F.lit(0))) & (c["first"] <= b), c["begun"]).otherwise(zero))
    met = met.select("__id", active.alias("__t"), F.when(F.col("__first"), at_start + begun).otherwise(begun).alias("__n"),
                     F.bit_count(F.col("__any").bitwiseAND(_mask("__a", "__b"))).alias("__c"), "__month").where(F.col("__t") > 0)
    return met.groupBy(F.col("__id").alias(row_id)).agg(F.sum("__t").alias(total), F.sum("__c").alias(days), F.sum("__n").alias(events_met),
                                                        *([F.collect_list("__month").alias(months)] if months else []))


def expand_days(df: DataFrame, start: str, end: str, out: str = "day") -> DataFrame:
    """One row per calendar day of ``[start, end]``.

    Spans with a null bound or with end before start yield no row (a bare
    ``sequence`` would count down). Clip spans before calling: the row count
    is the sum of span lengths.
    """
    s, e = F.col(start), F.col(end)
    return df.where(s.isNotNull() & e.isNotNull() & (s <= e)) \
             .withColumn(out, F.explode(F.sequence(s, e)))


def flag_in_span(df: DataFrame, day: str, start: str, end: str, out: str = "flag") -> DataFrame:
    """1 when ``day`` lies in ``[start, end]``, else 0 (null bounds give 0)."""
    inside = F.col(day).between(F.col(start), F.col(end))
    return df.withColumn(out, F.when(inside, F.lit(1)).otherwise(F.lit(0)))


def fold_days(df: DataFrame, keys: Sequence[str], flag: str, label: str,
              default_label: str = "none", out_flag: str | None = None,
              out_label: str | None = None) -> DataFrame:
    """Fold the rows of one key (a contract-day) into one row.

    flag = max of the flags; label = the sorted distinct labels of the flagged
    rows joined by ','; ``default_label`` when none is flagged. Deterministic,
    unlike a dedupe that keeps an arbitrary row.
    """
    out_flag, out_label = out_flag or flag, out_label or label
    labels = F.array_join(F.array_sort(F.collect_set(
        F.when((F.col(flag) == 1) & (F.trim(F.col(label)) != ""), F.col(label)))), ",")
    return df.groupBy(*keys).agg(F.max(flag).alias(out_flag), labels.alias("__labels")) \
             .withColumn(out_label, F.when(F.col("__labels") == "", F.lit(default_label))
                                     .otherwise(F.col("__labels"))) \
             .drop("__labels")


def day_events(events: DataFrame, keys: Sequence[str], start: str, end: str, label: str,
               day: str = "day") -> DataFrame:
    """Events (absences) folded per key and calendar day.

    Returns ``keys + [day, n_events, labels]`` with labels the sorted distinct
    non-blank labels. The group key includes the day, so a hot key is spread
    over its days, and the partial aggregate combines duplicates map-side.
    """
    days = expand_days(events.select(*keys, start, end, label), start, end, day)
    # one aggregate (partial set per map task, one exchange); splitting it in
    # a per-label hash aggregate plus a set costs a second exchange
    return days.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.array_sort(F.collect_set(F.when(F.trim(F.col(label)) != "", F.col(label)))).alias("labels"))


def event_days(events: DataFrame, keys: Sequence[str], start: str, end: str, day: str = "day") -> DataFrame:
    """Distinct (keys, day) covered by at least one event: the cheap form of
    ``day_events`` when only presence matters (a plain hash aggregate)."""
    days = expand_days(events.select(*keys, start, end), start, end, day)
    return days.select(*keys, day).distinct().withColumn("n_events", F.lit(1)) \
               .withColumn("labels", F.array().cast("array<string>"))


def attach_day_flags(unit_days: DataFrame, event_days: DataFrame, keys: Sequence[str],
                     day: str = "day", flag: str = "flag", label: str = "label",
                     default_label: str = "none", count: str | None = None) -> DataFrame:
    """Flag each unit-day (contract-day) covered by at least one event.

    ``event_days`` comes from ``day_events``. An equi-join on keys + day:
    no range residual, no per-key quadratic work, one row out per unit-day.
    Equivalent to overlap join -> expand -> ``flag_in_span`` -> ``fold_days``.
    """
    j = unit_days.join(event_days, [*keys, day], "left")
    out = j.withColumn(flag, F.when(F.col("n_events").isNotNull(), F.lit(1)).otherwise(F.lit(0))) \
           .withColumn(label, F.when(F.col("n_events").isNull() | (F.size("labels") == 0), F.lit(default_label))
                                .otherwise(F.array_join("labels", ",")))
    if count:
        out = out.withColumn(count, F.coalesce(F.col("n_events"), F.lit(0)))
    return out.drop("n_events", "labels")


def share(df: DataFrame, num: str, den: str, out: str) -> DataFrame:
    """``num / den`` as double, null on a zero denominator."""
    return df.withColumn(out, ratio(num, den))
