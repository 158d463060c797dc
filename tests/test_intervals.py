import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from dayspan.operators import intervals as iv

D = dt.date


def test_clip_span_drops_outside_and_null(spark):
    df = spark.createDataFrame([
        (1, D(1995, 1, 1), D(1996, 1, 10)),   # starts before the window
        (2, D(2001, 12, 1), D(9999, 12, 31)),  # open ended
        (3, D(1990, 1, 1), D(1995, 12, 31)),  # entirely before: dropped
        (4, None, D(1997, 1, 1)),             # unknown start: dropped
        (5, D(1997, 1, 2), D(1997, 1, 1)),    # negative: dropped
    ], "id int, s date, e date")
    out = iv.span_days(iv.clip_span(df, "s", "e", D(1996, 1, 1), D(2001, 12, 31)), "span_start", "span_end")
    assert rows(out, "id", "span_start", "span_end", "span_days") == [
        (1, D(1996, 1, 1), D(1996, 1, 10), 10), (2, D(2001, 12, 1), D(2001, 12, 31), 31)]


def test_expand_days_counts_and_skips_negative(spark):
    df = spark.createDataFrame([(1, D(2000, 2, 27), D(2000, 3, 1)), (2, D(2000, 1, 2), D(2000, 1, 1)),
                                (3, D(2000, 1, 1), D(2000, 1, 1))], "id int, s date, e date")
    out = iv.expand_days(df, "s", "e")
    assert out.count() == 4 + 0 + 1          # leap day included, negative span gives nothing
    assert out.where("id = 2").count() == 0


def test_repair_open_ended(spark):
    df = spark.createDataFrame([(1, D(1999, 1, 1), D(9999, 12, 31), D(1999, 6, 1)),
                                (2, D(1999, 1, 1), D(9999, 12, 31), None),
                                (3, D(1999, 1, 1), D(1999, 2, 1), D(1999, 6, 1))], "id int, s date, e date, p date")
    out = iv.repair_open_ended(df, "s", "e", "p", out="s2")
    assert rows(out, "id", "s2") == [(1, D(1999, 6, 1)), (2, D(1999, 1, 1)), (3, D(1999, 1, 1))]


def _spans(spark):
    left = spark.createDataFrame([
        (1, 7, D(2000, 1, 1), D(2000, 3, 31)),
        (2, 7, D(2000, 5, 1), D(2000, 5, 1)),
        (3, 8, D(2000, 1, 1), D(2000, 12, 31)),   # no absence of worker 8
        (4, 7, D(1999, 12, 1), D(2000, 1, 1)),    # touching end
    ], "cid int, w int, s date, e date")
    right = spark.createDataFrame([
        (7, "A", D(2000, 1, 1), D(2000, 1, 5)),
        (7, "B", D(2000, 1, 3), D(2000, 2, 10)),   # overlaps the first one
        (7, "C", D(2000, 4, 1), D(2000, 4, 30)),   # overlaps nothing
        (7, "D", D(1999, 1, 1), D(2001, 1, 1)),    # covers everything, many months
    ], "w int, cls string, s date, e date")
    return left, right


def test_overlap_join_guards_unmatched(spark):
    left, right = _spans(spark)
    j = iv.overlap_days(iv.interval_overlap_join(left, right, ["w"], ("s", "e"), ("s", "e")),
                        "overlap_start", "overlap_end", "days")
    got = rows(j, "cid", "r_cls", "overlap_start", "overlap_end", "days")
    # worker 8 has no partner: null overlap and 0 days, never its whole span
    assert (3, None, None, None, 0) in got
    assert (4, "A", D(2000, 1, 1), D(2000, 1, 1), 1) in got
    assert sum(1 for g in got if g[0] == 1) == 3      # A, B, D


def test_bucketed_join_equals_plain(spark):
    left, right = _spans(spark)
    cols = ["cid", "r_cls", "overlap_start", "overlap_end"]
    plain = iv.interval_overlap_join(left, right, ["w"], ("s", "e"), ("s", "e"))
    bucketed = iv.interval_overlap_join_bucketed(left, right, ["w"], ("s", "e"), ("s", "e"), (D(1900, 1, 1), D(2100, 1, 1)))
    assert rows(plain, *cols) == rows(bucketed, *cols)
    inner = iv.interval_overlap_join_bucketed(left, right, ["w"], ("s", "e"), ("s", "e"), (D(1900, 1, 1), D(2100, 1, 1)), how="inner")
    assert rows(inner, *cols) == [r for r in rows(plain, *cols) if r[1] is not None]


def test_bucketed_join_hot_key_matches_brute_force(spark):
    # one worker holds most rows: the bucketed plan must still give every pair once
    import random
    rnd = random.Random(3)
    base = D(2000, 1, 1)
    L = [(i, 1 if i % 3 else 2, base + dt.timedelta(rnd.randint(0, 700)), 0) for i in range(300)]
    L = [(i, w, s, s + dt.timedelta(rnd.randint(0, 90))) for i, w, s, _ in L]
    R = [(1 if j % 4 else 2, f"c{j}", base + dt.timedelta(rnd.randint(0, 700))) for j in range(200)]
    R = [(w, c, s, s + dt.timedelta(rnd.randint(0, 20))) for w, c, s in R]
    left = spark.createDataFrame(L, "cid int, w int, s date, e date")
    right = spark.createDataFrame(R, "w int, cls string, s date, e date")
    got = rows(iv.interval_overlap_join_bucketed(left, right, ["w"], ("s", "e"), ("s", "e"), (D(1900, 1, 1), D(2100, 1, 1))),
               "cid", "r_cls")
    expect = []
    for cid, w, s, e in L:
        hits = [c for (w2, c, s2, e2) in R if w2 == w and s2 <= e and e2 >= s]
        expect += [(cid, c) for c in hits] or [(cid, None)]
    assert got == sorted(expect, key=lambda t: (t[0], "" if t[1] is None else t[1])) or \
        sorted(got, key=str) == sorted(expect, key=str)


def test_day_level_join_equals_expand_and_fold(spark):
    left, right = _spans(spark)
    # explicit path: overlap rows -> days -> flag -> fold
    j = iv.interval_overlap_join(left, right, ["w"], ("s", "e"), ("s", "e"))
    d = iv.flag_in_span(iv.expand_days(j, "s", "e"), "day", "overlap_start", "overlap_end", "absent")
    folded = iv.fold_days(d, ["cid", "day"], "absent", "r_cls", "none", out_label="cls")
    # day-level path
    days = iv.expand_days(left, "s", "e")
    ev = iv.day_events(right.withColumnRenamed("s", "a_s").withColumnRenamed("e", "a_e"), ["w"], "a_s", "a_e", "cls")
    flagged = iv.attach_day_flags(days, ev, ["w"], "day", flag="absent", label="cls", default_label="none")
    assert rows(folded, "cid", "day", "absent", "cls") == rows(flagged, "cid", "day", "absent", "cls")
    # two absences on one day give a sorted, comma-joined class list
    assert ("A,B,D",) in rows(flagged.where((F.col("cid") == 1) & (F.col("day") == D(2000, 1, 4))), "cls")


def test_flag_in_span_null_is_zero(spark):
    df = spark.createDataFrame([(D(2000, 1, 1), None, None)], "d date, s date, e date")
    assert iv.flag_in_span(df, "d", "s", "e").first()["flag"] == 0


def test_weekday_lookup_equals_date_format(spark):
    from dayspan.operators.calendar import weekday_name
    df = spark.range(0, 14).select(F.date_add(F.lit(D(2000, 1, 1)), F.col("id").cast("int")).alias("d"))
    out = df.select(weekday_name(F.col("d")).alias("a"), F.date_format("d", "E").alias("b"))
    assert out.where("a != b").count() == 0


def test_skewed_input_three_plans_agree(spark):
    """One worker holds a third of all spans and absences (derived by hash)."""
    from conftest import SF_SMALL
    from dayspan.plans.spans import KEYS, SPAN, clipped_spans, kept_absences
    hot = lambda cols: F.when(F.abs(F.xxhash64(*cols)) % 3 == 0, F.lit(1)).otherwise(F.col("worker_id"))  # noqa
    sp = clipped_spans(spark, SF_SMALL).select("contract_id", *KEYS, *SPAN).withColumn("worker_id", hot(["contract_id"]))
    sp = sp.withColumn("division", F.when(F.col("worker_id") == 1, F.lit(1)).otherwise(F.col("division")))
    ab = kept_absences(spark, SF_SMALL).withColumn("worker_id", hot(["worker_id", "start_date", "absence_class"]))
    ab = ab.withColumn("division", F.when(F.col("worker_id") == 1, F.lit(1)).otherwise(F.col("division")))
    days_of = F.coalesce(F.datediff("overlap_end", "overlap_start") + 1, F.lit(0))
    plain = iv.interval_overlap_join(sp, ab, KEYS, SPAN, ("start_date", "end_date"))
    bucketed = iv.interval_overlap_join_bucketed(sp, ab, KEYS, SPAN, ("start_date", "end_date"), (D(1900, 1, 1), D(2100, 1, 1)))
    cols = ["contract_id", "r_absence_class", "r_start_date", "overlap_start", "overlap_end"]
    assert rows(plain, *cols) == rows(bucketed, *cols)
    ev = iv.day_events(ab, KEYS, "start_date", "end_date", "absence_class")
    flagged = iv.attach_day_flags(iv.expand_days(sp, *SPAN, "day"), ev, KEYS, "day", count="n_abs")
    assert flagged.agg(F.sum("n_abs")).first()[0] == plain.agg(F.sum(days_of)).first()[0]
    narrow = iv.overlap_day_rows(sp, ab, "contract_id", KEYS, SPAN, ("start_date", "end_date"), (D(1900, 1, 1), D(2100, 1, 1)))
    assert rows(narrow, "contract_id", "day") == rows(flagged.where("flag = 1"), "contract_id", "day")
    totals = iv.overlap_day_totals(sp, ab, "contract_id", KEYS, SPAN, ("start_date", "end_date"), (D(1900, 1, 1), D(2100, 1, 1)))
    want = plain.groupBy("contract_id").agg(F.sum(days_of).cast("long").alias("n")).where("n > 0")
    assert rows(totals, "contract_id", "overlap_days") == rows(want, "contract_id", "n")
    met = plain.where("r_start_date is not null").groupBy("contract_id").count()
    assert rows(totals, "contract_id", "events") == rows(met, "contract_id", "count")
    assert rows(totals, "contract_id", "covered_days") == rows(narrow.groupBy("contract_id").count(), "contract_id", "count")


def test_bucketed_join_open_ended_sentinel(spark):
    left = spark.createDataFrame([(1, 7, D(2000, 1, 1), D(9999, 12, 31)), (2, 7, D(2000, 3, 1), D(2000, 3, 2))],
                                 "cid int, w int, s date, e date")
    right = spark.createDataFrame([(7, "A", D(2000, 3, 2), D(2000, 3, 9)), (7, "B", D(1990, 1, 1), D(1990, 1, 2))],
                                  "w int, cls string, s date, e date")
    cols = ["cid", "r_cls", "overlap_start", "overlap_end"]
    plain = iv.interval_overlap_join(left, right, ["w"], ("s", "e"), ("s", "e"))
    fixed = iv.interval_overlap_join_bucketed(left, right, ["w"], ("s", "e"), ("s", "e"), (D(1996, 1, 1), D(2001, 12, 31)))
    assert rows(fixed, *cols) == rows(plain, *cols) == [
        (1, "A", D(2000, 3, 2), D(2000, 3, 9)), (2, "A", D(2000, 3, 2), D(2000, 3, 2))]


def test_bucketed_join_keeps_rows_of_one_id_and_inverted_spans(spark):
    """No column need be unique, and an inverted or unknown span overlaps nothing in either join."""
    left = spark.createDataFrame([
        (1, 7, D(2000, 1, 1), D(2000, 1, 9)), (1, 7, D(2000, 6, 1), D(2000, 6, 2)), (1, 7, D(2000, 6, 1), D(2000, 6, 2)),
        (2, 7, D(2000, 2, 9), D(2000, 1, 2)), (3, 7, None, D(2000, 1, 2)), (None, None, D(2000, 1, 1), D(2000, 1, 2))],
        "cid int, w int, s date, e date")
    right = spark.createDataFrame([(7, "A", D(2000, 1, 2), D(2000, 2, 3)), (7, "B", D(2000, 1, 9), D(2000, 1, 3)), (7, None, None, None)],
                                  "w int, cls string, s date, e date")
    cols = ["cid", "s", "r_cls", "overlap_start", "overlap_end"]
    plain = iv.interval_overlap_join(left, right, ["w"], ("s", "e"), ("s", "e"))
    bucketed = iv.interval_overlap_join_bucketed(left, right, ["w"], ("s", "e"), ("s", "e"), (D(1999, 1, 1), D(2001, 1, 1)))
    assert rows(plain, *cols) == rows(bucketed, *cols)
    assert len(rows(plain, *cols)) == 6 and sum(r[2] == "A" for r in rows(plain, *cols)) == 1


def test_flagged_days_equal_expand_and_fold(spark):
    left, right = _spans(spark)
    window = (D(1999, 1, 1), D(2001, 12, 31))
    j = iv.interval_overlap_join(left, right, ["w"], ("s", "e"), ("s", "e"))
    d = iv.flag_in_span(iv.expand_days(j, "s", "e"), "day", "overlap_start", "overlap_end", "absent")
    folded = iv.fold_days(d, ["cid", "day"], "absent", "r_cls", "none", out_label="cls")
    m = iv.flagged_days(left, right, ["w"], ("s", "e"), ("s", "e"), window, "cls")
    m = m.withColumn("cls", F.when(F.col("flag") == 1, F.array_join("labels", ",")).otherwise("none")).withColumnRenamed("flag", "absent")
    assert rows(folded, "cid", "day", "absent", "cls") == rows(m, "cid", "day", "absent", "cls")
    days = iv.overlap_day_rows(left, right, "cid", ["w"], ("s", "e"), ("s", "e"), window)
    assert rows(days, "cid", "day") == [r[:2] for r in rows(folded, "cid", "day", "absent") if r[2] == 1]


def test_folded_months_equal_brute_force(spark):
    """Long and one-day spans, month borders, leap days, blank and null classes, null keys, dates outside the clamp."""
    import random
    rng = random.Random(11)
    day = lambda: D(1999, 11, 20) + dt.timedelta(rng.randrange(500))
    some = lambda: [(i, rng.choice([1, 2, None]), d := day(), d + dt.timedelta(rng.choice([-3, 0, 1, 30, 31, 200]))) for i in range(60)]
    left = some() + [(60, 1, None, D(2000, 1, 1)), (61, 1, D(2000, 2, 29), D(2000, 2, 29)), (61, 1, D(2000, 2, 1), D(2000, 3, 31))]
    right = [(w, rng.choice(["A", "B", " ", None, "A"]), s, e) for _, w, s, e in some()] + [(1, "Z", D(1900, 1, 1), D(9999, 12, 31)), (2, "N", None, None)]
    low, high = D(2000, 1, 1), D(2000, 12, 31)
    lf = spark.createDataFrame(left, "cid int, w int, s date, e date").withColumn("row", F.monotonically_increasing_id())
    rf = spark.createDataFrame(right, "w int, cls string, s date, e date").repartition(4)
    span = lambda s, e: [s + dt.timedelta(i) for i in range((e - s).days + 1)] if s and e else []
    hit = lambda w, d: [c for rw, c, s, e in right if rw == w and w is not None and s and s <= d <= e and low <= d <= high]
    want = sorted((i, str(d), int(bool(hit(w, d))), ",".join(sorted({c for c in hit(w, d) if c and c.strip()})) if hit(w, d) else "-")
                  for i, w, s, e in left for d in span(s, e))
    got = iv.flagged_days(lf, rf, ["w"], ("s", "e"), ("s", "e"), (low, high), "cls")
    got = sorted((r.cid, str(r.day), r.flag, ",".join(r.labels) if r.labels is not None else "-") for r in got.collect())
    assert got == want
    plain = iv.flagged_days(lf, rf, ["w"], ("s", "e"), ("s", "e"), (low, high))
    assert "labels" not in plain.columns and sorted((r.cid, str(r.day), r.flag) for r in plain.collect()) == [r[:3] for r in want]
    totals = iv.overlap_day_totals(lf, rf, "row", ["w"], ("s", "e"), ("s", "e"), (low, high))
    totals = sorted((r.cid, str(r.s), r.overlap_days, r.covered_days, r.events) for r in lf.join(totals, "row").collect())
    exp = []
    for i, w, s, e in left:
        days = [d for d in span(s, e) if hit(w, d)]
        if days:
            met = sum(rw == w and rs is not None and max(rs, s, low) <= min(re, e, high) for rw, _, rs, re in right)
            exp.append((i, str(s), sum(len(hit(w, d)) for d in days), len(days), met))
    assert totals == sorted(exp)


def test_a_hot_key_is_folded_before_it_meets_rows(spark):
    """20,000 events of one key and month are one row of masks and 31 changes; no join row stands for a pair."""
    ev = spark.range(20_000).select(F.lit(1).alias("w"), F.expr("date_add(date'2000-01-01', int(id % 28))").alias("s"),
                                    F.expr("date_add(date'2000-01-01', int(id % 28) + int(id % 3))").alias("e"))
    window = (D(2000, 1, 1), D(2000, 12, 31))
    assert iv.month_masks(ev, ["w"], ("s", "e"), window).count() == 1
    changes = iv.month_changes(ev, ["w"], ("s", "e"), window).first()
    assert len(changes["__changes"]) <= 32
    rows_ = spark.range(500).select("id", F.lit(1).alias("w"), F.lit(D(2000, 1, 5)).alias("s"), F.lit(D(2000, 1, 20)).alias("e"))
    t = iv.overlap_day_totals(rows_, ev, "id", ["w"], ("s", "e"), ("s", "e"), window).distinct().where("id = 7").first()
    assert (t.covered_days, t.events > 10_000, t.overlap_days > 10_000) == (16, True, True)


def test_hot_keys_take_the_grid_and_no_row_changes(spark):
    """Keys of a third of the rows, of nulls, and of one side only; both join kinds; sentinel ends."""
    import random
    rng = random.Random(21)
    def some(n, key):  # noqa: E306
        return [(key(i), D(2000, 1, 1) + dt.timedelta(rng.randrange(700)), i) for i in range(n)]
    left = [(k, s, s + dt.timedelta(rng.randrange(40)), i) for k, s, i in some(600, lambda i: [7, i, None][i % 3])]
    left += [(7, D(2000, 5, 5), D(9999, 12, 31), 9000), (7, D(2001, 1, 2), D(2001, 1, 1), 9001), (7, None, D(2001, 1, 1), 9002), (8, D(1990, 1, 1), D(2010, 1, 1), 9003)]
    right = [(k, s, s + dt.timedelta(rng.randrange(9)), i) for k, s, i in some(600, lambda i: [7, i, 55][i % 3])] + [(7, D(1980, 1, 1), D(9999, 12, 31), 9100)]
    lf = spark.createDataFrame(left, "w int, s date, e date, id int").repartition(5)
    rf = spark.createDataFrame(right, "w int, s date, e date, id int").repartition(3)
    assert len(iv.hot_keys(lf, ["w"], 0.1)) == 1 and len(iv.hot_keys(rf, ["w"], 0.1)) == 2
    for how in ("left", "inner"):
        plain = iv.interval_overlap_join(lf, rf, ["w"], ("s", "e"), ("s", "e"), how=how)
        for hot in (0.1, 0.9):  # the second finds none
            got = iv.interval_overlap_join(lf, rf, ["w"], ("s", "e"), ("s", "e"), how=how, hot=hot)
            assert got.columns == plain.columns
            assert rows(got) == rows(plain)
    wide = rf.withColumn("w", F.col("w").cast("long"))
    for other in (wide, rf.withColumn("w", F.col("w").cast("double"))):
        got = iv.interval_overlap_join(lf, other, ["w"], ("s", "e"), ("s", "e"), how="inner", hot=0.1)
        assert got.count() == plain.count()
    none = lf.limit(0)
    assert iv.interval_overlap_join(none, rf, ["w"], ("s", "e"), ("s", "e"), hot=0.1).count() == 0
    assert iv.interval_overlap_join(lf, rf.limit(0), ["w"], ("s", "e"), ("s", "e"), hot=0.1).count() == len(left)
    few = spark.createDataFrame([(7, None, None, 1)] * 5, rf.schema)
    assert iv.interval_overlap_join(lf, few, ["w"], ("s", "e"), ("s", "e"), hot=0.1).count() == len(left)


def test_bucketed_join_stores_no_pairs(spark, monkeypatch):
    """300 spans and 300 events of one key are 90,000 pairs; the stage tables hold no more rows than the inputs."""
    stored, write = [], iv.materialize
    def kept(df, name, *rest):  # noqa: E306
        out = write(df, name, *rest)
        stored.append(out.count())
        return out
    monkeypatch.setattr(iv, "materialize", kept)
    day = F.lit(D(2000, 1, 5))
    left = spark.range(300).select("id", F.lit(1).alias("w"), day.alias("s"), F.date_add(day, 9).alias("e"))
    right = left.union(left.selectExpr("id", "2 as w", "s", "e"))
    for hot in (None, 0.1):
        j = (iv.interval_overlap_join(left, right, ["w"], ("s", "e"), ("s", "e"), hot=hot) if hot else
             iv.interval_overlap_join_bucketed(left, right, ["w"], ("s", "e"), ("s", "e"), (D(2000, 1, 1), D(2000, 12, 31))))
        assert j.count() == 90_000 and max(stored) <= 600
    copies = iv.count_copies(right, ["w", "s", "e"])
    assert rows(copies, "w", "copies") == [(1, 300), (2, 300)]


def test_months_fold_in_few_shuffles_and_a_row_per_piece(spark):
    """Masks by label meet in one shuffle (two before); an event is one row and one item a month (two changes before)."""
    ev = spark.createDataFrame([(1, "A", D(2000, 1, 3), D(2000, 1, 6)), (1, "A", D(2000, 1, 9), D(2000, 1, 9)), (1, None, D(2000, 1, 31), D(2000, 2, 2)),
                                (1, None, D(2000, 1, 1), D(2000, 1, 1))], "w int, cls string, s date, e date")
    window = (D(2000, 1, 1), D(2000, 12, 31))
    masks = iv.month_masks(ev, ["w"], ("s", "e"), window, "cls")
    plan = masks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {(r.label, r.mask) for r in masks.where("__em = 24000").selectExpr("inline(__marks)").collect()}
    assert got == {("A", 0b100111100), (None, (1 << 30) + 1)}
    changes = iv.month_changes(ev, ["w"], ("s", "e"), window)
    assert changes._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert {r["__em"]: len(r["__changes"]) for r in changes.collect()} == {24000: 4, 24001: 1}


def test_a_month_of_many_kinds_of_events_is_held_by_day(spark):
    """400 events of over 31 kinds in a month, some begun before it: sums, covered days and events met as compared one by one."""
    import random
    rng = random.Random(5)
    ev = [(s := D(2000, 2, 20) + dt.timedelta(rng.randrange(45)), s + dt.timedelta(rng.randrange(12))) for _ in range(400)]
    spans = [(i, s := D(2000, 2, 10) + dt.timedelta(rng.randrange(60)), s + dt.timedelta(rng.choice([0, 3, 25, 40]))) for i in range(40)]
    window = (D(2000, 2, 1), D(2000, 4, 10))
    ef = spark.createDataFrame([(1, *x) for x in ev], "w int, s date, e date")
    sf = spark.createDataFrame([(i, 1, s, min(e, window[1])) for i, s, e in spans], "id int, w int, s date, e date")
    assert max(len(r["__changes"]) for r in iv.month_changes(ef, ["w"], ("s", "e"), window).collect()) == 31
    got = rows(iv.overlap_day_totals(sf, ef, "id", ["w"], ("s", "e"), ("s", "e"), window), "id", "overlap_days", "covered_days", "events")
    want = []
    for i, s, e in spans:
        met = [(max(s, a), min(e, b, window[1])) for a, b in ev if max(s, a) <= min(e, b, window[1])]
        if met:
            days = {a + dt.timedelta(k) for a, b in met for k in range((b - a).days + 1)}
            want.append((i, sum((b - a).days + 1 for a, b in met), len(days), len(met)))
    assert got == sorted(want)


def _random_spans(rng, n, low, most):
    return [(rng.randrange(4), s := low + dt.timedelta(rng.randrange(200)), s + dt.timedelta(rng.randrange(most))) for _ in range(n)]


def test_months_of_a_row_give_its_flagged_days(spark):
    """Days from the months kept with a row equal those of a second meeting of rows and events, also in months held by day."""
    import random
    rng = random.Random(11)
    window = (D(2000, 1, 10), D(2000, 7, 5))
    ev = [(k, rng.choice(["A", "B", "C", "", None]), s, e) for k, s, e in _random_spans(rng, 60, D(1999, 12, 20), 50)]
    ev += [(7, rng.choice(["A", "B"]), D(2000, 3, 1 + i % 25), D(2000, 3, 1 + i % 25 + i % 6)) for i in range(300)]  # over 31 kinds in March
    ef = spark.createDataFrame(ev, "w int, cls string, s date, e date")
    sp = _random_spans(rng, 40, D(1999, 12, 25), 70) + [(7, D(2000, 2, 27), D(2000, 4, 2)), (9, D(2000, 2, 1), D(2000, 2, 3)), (None, D(2000, 2, 1), D(2000, 2, 2))]
    rf = spark.createDataFrame([(i, *x) for i, x in enumerate(sp)], "id int, w int, s date, e date")
    t = iv.overlap_day_totals(rf, ef, "id", ["w"], ("s", "e"), ("s", "e"), window, label="cls", months="met")
    plain = iv.overlap_day_totals(rf, ef, "id", ["w"], ("s", "e"), ("s", "e"), window)
    assert rows(t.drop("met")) == rows(plain) and plain.count() > 20
    days = iv.flagged_days_of(rf.join(t.select(F.col("id").alias("i"), "met"), F.col("id") == F.col("i"), "left").drop("i"), "met", ("s", "e"))
    want = iv.flagged_days(rf, ef, ["w"], ("s", "e"), ("s", "e"), window, "cls")
    assert days.columns == want.columns
    assert days.exceptAll(want).count() == 0 and want.exceptAll(days).count() == 0 and days.where("flag = 1").count() > 100


def test_repeated_events_count_once_in_one_shuffle(spark):
    """``distinct`` gives what the distinct events give. Events that the window makes equal stay two; the pieces are shuffled once."""
    import random
    rng = random.Random(3)
    window = (D(2000, 1, 10), D(2000, 6, 30))
    ev = [(k, rng.choice(["A", "B"]), s, e) for k, s, e in _random_spans(rng, 50, D(2000, 1, 1), 45)]
    ev += ev[:30] + [(1, "A", D(1999, 1, 1), D(2000, 1, 20)), (1, "A", D(1999, 2, 1), D(2000, 1, 20)), (1, "A", D(1999, 2, 1), D(2000, 1, 20))]
    ef = spark.createDataFrame(ev, "w int, cls string, s date, e date")
    rf = spark.createDataFrame([(i, *x) for i, x in enumerate(_random_spans(rng, 60, D(2000, 1, 1), 60) + [(1, D(2000, 1, 1), D(2000, 1, 31))])], "id int, w int, s date, e date")
    args = ("id", ["w"], ("s", "e"), ("s", "e"), window)
    got = iv.overlap_day_totals(rf, ef, *args, label="cls", months="met", distinct=True)
    want = iv.overlap_day_totals(rf, ef.distinct(), *args)
    assert rows(got.drop("met")) == rows(want)
    assert rows(got.drop("met")) != rows(iv.overlap_day_totals(rf, ef, *args))
    folded = iv.month_changes(ef, ["w"], ("s", "e"), window, "cls", distinct=True, marks=True)
    assert folded._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_busy_month_of_many_labels_holds_31_items(spark):
    """With labels too a month holds 31 items at most, and its masks by label are found once, before rows meet it."""
    ev = spark.range(2_000).select(F.lit(1).alias("w"), F.expr("concat('c', id % 5)").alias("cls"), F.expr("date_add(date'2000-01-01', int(id % 27))").alias("s"),
                                   F.expr("date_add(date'2000-01-01', int(id % 27) + int(id % 4))").alias("e"))
    args = (["w"], ("s", "e"), (D(2000, 1, 1), D(2000, 1, 31)), "cls")
    m = iv.month_changes(ev, *args, distinct=True, marks=True).first()
    assert len(m["__changes"]) <= 31 and sum(c["begun"] for c in m["__changes"]) == ev.distinct().count()
    want = iv.month_masks(ev, *args).first()
    assert m["__any"] == want["__any"] and sorted(m["__marks"]) == sorted(want["__marks"]) and len(m["__marks"]) == 5
