import datetime as dt
import hashlib

from pyspark.sql import functions as F

from conftest import rows
from dayspan.operators import balance, evaluate
from dayspan.operators.bands import range_bands

D = dt.date


def test_range_bands_half_open_and_unknown(spark):
    df = spark.createDataFrame([(0,), (10,), (20,), (59,), (60,), (None,)], "v int")
    out = range_bands(df, "v", [(1, 6), (2, 6), (4, 6)], ["a", "b", "c", "d"], out="band")
    # range 0..60: cuts at 10, 20, 40
    assert sorted(rows(out), key=str) == sorted([(0, "a"), (10, "b"), (20, "c"), (59, "d"), (60, "d"),
                                                 (None, "unknown")], key=str)


def _skewed(spark):
    data = [(i, 1 if i % 10 == 0 else 0) for i in range(1000)]
    return spark.createDataFrame(data, "id int, label int")


def test_class_weights_sum_to_rows(spark):
    w = balance.class_weights(_skewed(spark), "label")
    s = w.groupBy("label").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r["s"] - 500.0) < 1e-6 for r in s)


def test_resample_fixed_rates(spark):
    r = balance.resample(_skewed(spark), "label", ["id"], rates={0: 0.5, 1: 3.0})
    got = dict((x["label"], x["n"]) for x in r.groupBy("label").agg(F.count("*").alias("n")).collect())
    assert got[1] == 300                      # whole rate: exact
    assert 380 < got[0] < 520                 # fractional rate: md5 coin, about 450


def test_balance_exact_matches_brute_force(spark):
    df = _skewed(spark)
    out = balance.balance_exact(df, "label", ["id"], levels=2, width=1)
    got = rows(out, "label", "id")
    expect = []
    for lbl in (0, 1):
        ids = [i for i in range(1000) if (1 if i % 10 == 0 else 0) == lbl]
        ids.sort(key=lambda i: hashlib.md5(f"{len(str(i))}:{i}".encode()).hexdigest())
        expect += [(lbl, i) for i in ids[:100]]
    assert got == sorted(expect)


def test_daily_error_keeps_days_without_positives(spark):
    df = spark.createDataFrame([(D(2000, 1, 1), 1.0, 1.0), (D(2000, 1, 1), 0.0, 1.0), (D(2000, 1, 2), 0.0, 0.0)],
                               "day date, label double, prediction double")
    d = evaluate.daily_error(df, "day", "label", "prediction", 1.0)
    r = {x["day"]: x for x in d.collect()}
    assert r[D(2000, 1, 2)]["error_over_absences"] is None
    assert r[D(2000, 1, 1)]["error_over_total"] == 0.5
    c = evaluate.confusion_matrix(df)
    assert c.agg(F.sum("count")).first()[0] == 3
    g = evaluate.rate_gap(df, positive=1.0).first()
    assert (g["predicted"], g["real"]) == (2, 1)


def test_hash_keys_tell_columns_and_nulls_apart(spark):
    from dayspan.functions.columns import hash_key
    data = [("a", None, "b"), ("a", "b", None), ("a|b", None, None), (None, "a", "b"), ("a", "", "b"), ("1:a", None, "b"), ("", "", ""), (None, None, None)]
    df = spark.createDataFrame(data, "x string, y string, z string").select(hash_key(["x", "y", "z"]).alias("k"), hash_key(["x"]).alias("one"))
    keys = [r.k for r in df.collect()]
    assert len(set(keys)) == len(data) and None not in keys
    assert None not in [r.one for r in df.collect()]


def test_balance_exact_when_many_rows_share_a_key(spark):
    """The key of most rows is the same: exact sizes, the same rows on every run, equal rows counted."""
    data = [(7 if i % 3 else i, i % 40, 0) for i in range(600)] + [(i, i, 1) for i in range(90)] + [(7, 1, 0)] * 50
    df = spark.createDataFrame(data, "id int, v int, label int")
    a = rows(balance.balance_exact(df, "label", ["id"], levels=1, width=1))
    b = rows(balance.balance_exact(df.repartition(7), "label", ["id"], levels=1, width=1))
    assert a == b and [sum(r[2] == c for r in a) for c in (0, 1)] == [90, 90]


def test_histogram_needs_no_single_task_window(spark):
    import contextlib
    import io
    for df in (balance.label_histogram(_skewed(spark), "label"), balance.class_weights(_skewed(spark), "label"),
               balance.resample(_skewed(spark), "label", ["id"])):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        assert "Window" not in out.getvalue()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_balance_exact_stores_rows_without_digests_and_never_shuffles_them(spark, monkeypatch):
    stored, write = {}, balance.materialize
    def kept(df, name, *rest):  # noqa: E306
        stored.setdefault(name, []).append((df.columns, _plan(df)))
        return write(df, name, *rest)
    monkeypatch.setattr(balance, "materialize", kept)
    df = _skewed(spark).withColumn("wide", F.repeat(F.lit("x"), 50))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = balance.balance_exact(df, "label", ["id"], levels=2, width=1)
        assert stored["balance-base"][0][0] == df.columns
        assert all("SortMergeJoin" not in p for _, p in stored["balance-pending"]) and "SortMergeJoin" not in _plan(out)
        assert out.groupBy("label").count().where("count = 100").count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_balance_exact_with_a_null_class(spark):
    data = [(i, None if i % 3 else 1) for i in range(300)]
    got = rows(balance.balance_exact(spark.createDataFrame(data, "id int, label int"), "label", ["id"], levels=1, width=1), "label", "id")
    assert [sum(r[0] == c for r in got) for c in (None, 1)] == [100, 100] and len(set(got)) == 200


def test_class_values_reach_the_rows_without_a_shuffle_of_them(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (balance.class_weights(_skewed(spark), "label"), balance.resample(_skewed(spark), "label", ["id"])):
            assert "SortMergeJoin" not in _plan(df) and "BroadcastHashJoin" in _plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_take_one_digest_a_row(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("y"))
    out = balance.resample(df, "y", ["id"], rates={0: 0.4, 1: 2.5})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1  # two before
    n = out.groupBy("y", "id").agg(F.count(F.lit(1)).alias("n"), F.min("copy").alias("low"), F.max("copy").alias("high"))
    assert {(r.y, r.n) for r in n.collect()} == {(0, 1), (1, 2), (1, 3)}
    assert n.where("low <> 1 or high <> n").count() == 0 and out.schema["copy"].dataType.simpleString() == "int"
