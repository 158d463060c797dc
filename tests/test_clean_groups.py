import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from dayspan.operators import clean, groups
from dayspan.sources.tables import bind_categories, normalize_header

D = dt.date


def test_presence_flag_all_cases(spark):
    df = spark.createDataFrame([(1, "child", None), (2, "", 5), (3, "", None), (4, "", 0), (5, None, 3)],
                               "id int, rel string, obj int")
    out = clean.case_label(clean.presence_flag(df, "rel", "obj", "flag"), "rel", "flag", "some", "none", "label")
    assert rows(out, "id", "flag", "label") == [(1, 1, "child"), (2, 1, "some"), (3, 0, "none"), (4, 0, "none"),
                                                (5, 0, None)]


def test_exclude_keeps_null(spark):
    df = spark.createDataFrame([("NF",), ("RF",), (None,)], "c string")
    assert rows(clean.exclude_values(df, "c", ["NF"])) == [("RF",), (None,)] or \
        sorted(rows(clean.exclude_values(df, "c", ["NF"])), key=str) == sorted([("RF",), (None,)], key=str)
    assert rows(clean.exclude_values(df, "c", ["NF"], keep_null=False)) == [("RF",)]


def test_cast_try_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([("12", "2000-01-31"), ("x", "nope"), ("", "")], "a string, b string")
    out = clean.cast_columns(df, {"a": "int", "b": "date"})
    assert sorted(rows(out), key=str) == sorted([(12, D(2000, 1, 31)), (None, None), (None, None)], key=str)


def test_fill_blank_and_null(spark):
    df = spark.createDataFrame([(" ", None, 7), ("x", D(2000, 1, 1), None)], "t string, d date, code int")
    out = clean.fill_blank(df, {"t": "unknown"})
    out = clean.fill_null(out, {"d": F.lit(D(1999, 1, 1))})
    out = clean.pad_code(out, "code", 5, "00000")
    assert rows(out) == [("unknown", D(1999, 1, 1), "00007"), ("x", D(2000, 1, 1), "00000")]


def test_cap_date_keeps_null(spark):
    df = spark.createDataFrame([(D(2000, 5, 1), D(2000, 1, 1)), (None, D(2000, 1, 1))], "h date, s date")
    assert sorted(rows(clean.cap_date(df, "h", "s"), "h"), key=str) == sorted([(D(2000, 1, 1),), (None,)], key=str)


def test_dedupe_keep_first(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "b"), (1, 1, "a"), (2, 9, "z")], "k int, o int, v string")
    assert rows(clean.dedupe_keep_first(df, ["k"], ["o", "v"])) == [(1, 1, "a"), (2, 9, "z")]


def test_mapping_override_and_recode(spark):
    schema = "category string, raw string, canonical string"
    d = spark.createDataFrame([("sex", "M", "male"), ("kind", "T", "temp")], schema)
    o = spark.createDataFrame([("kind", "P", "permanent")], schema)
    m = clean.build_mapping(d, o)
    assert rows(m) == [("kind", "P", "permanent"), ("sex", "M", "male")]
    df = spark.createDataFrame([("M", "T"), ("F", "P")], "sex string, kind string")
    assert rows(clean.recode(df, m, {"sex": "sex", "kind": "kind"})) == [("F", "permanent"), ("male", "T")]


def test_header_helpers():
    assert normalize_header("Clase de Contrato.") == "clase_de_contrato"
    assert normalize_header("Descripción") == "descripcion"
    import warnings
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        b = bind_categories(["clase_de_contrato", "sexo_x"], ["contrato", "clase_de_contrato", "sexo"])
    assert b == {"clase_de_contrato": "clase_de_contrato", "sexo_x": "sexo"}
    assert w


def test_group_value_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    g = groups.group_size(df, ["k"], "n")
    assert rows(g, "id", "n") == [(1, 2), (2, 2), (3, 1)]
    e = groups.group_size(df, ["k"], "n", null_keys="exclude")
    assert sorted(rows(e, "id", "n"), key=str) == sorted([(1, None), (2, None), (3, 1)], key=str)


def test_previous_end(spark):
    df = spark.createDataFrame([(1, 7, D(2000, 1, 10)), (2, 7, D(2000, 3, 1)), (3, 7, D(2005, 1, 1)),
                                (4, 8, D(2005, 1, 1))], "id int, w int, e date")
    out = groups.previous_end(df, ["w"], "e", D(2001, 1, 1))
    assert rows(out, "id", "prev_end") == [(1, D(2000, 3, 2)), (2, D(2000, 3, 2)), (3, D(2000, 3, 2)), (4, None)]


def test_recode_duplicate_raw_does_not_multiply_rows(spark):
    schema = "category string, raw string, canonical string"
    m = spark.createDataFrame([("sex", "M", "male"), ("sex", "M", "man")], schema)
    df = spark.createDataFrame([("M",), ("F",)], "sex string")
    assert rows(clean.recode(df, m, {"sex": "sex"})) == [("F",), ("male",)]


def test_sketched_profile_against_the_exact_one(spark):
    """Counts agree, estimates stay within their bounds; empty text is a value, nulls and odd names are fine."""
    from dayspan.operators.quality import DISTINCT_ERROR, RANK_ERROR, profile, profile_sketched
    df = spark.range(20_000).select(
        (F.col("id") % 5000).alias("n"), F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), F.col("id") % 3)).alias("a b"),
        F.lit(None).cast("string").alias("gone"), F.expr("date_add(date'2000-01-01', int(id % 700))").alias("d"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("x")).repartition(9)
    exact = {r.column: r for r in profile(df).collect()}
    got = {r.column: r for r in profile_sketched(df).collect()}
    assert got.keys() == exact.keys()
    for c, e in exact.items():
        g = got[c]
        assert (g["rows"], g.nulls, g.blanks) == (e["rows"], e.nulls, e.blanks), c
        assert abs(g.distinct_values - e.distinct_values) <= max(1, 4 * DISTINCT_ERROR * e.distinct_values), c
    assert abs(got["n"].median / 5000 - 0.5) <= RANK_ERROR + 0.001 and abs(got["x"].median / 20_000 - 0.5) <= RANK_ERROR + 0.001
    assert got["gone"].median is None and got["gone"].most_frequent == [] and got["a b"].median is None
    assert {v.value for v in got["a b"].most_frequent} <= {"", "v0", "v1", "v2"} and len(got["a b"].most_frequent) == 3
    assert got["a b"].distinct_values == 4


def test_group_value_with_null_keys_shuffles_the_groups_once(spark):
    """The groups stay where their aggregate put them; ``onto`` names the rows that get the value."""
    df = spark.createDataFrame([(1, None, 1), (1, None, 2), (None, "x", 3), (1, "x", 4)], "a int, b string, id int").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = groups.group_size(df, ["a", "b"], "n")
        plan = g._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the rows and the groups
        assert rows(g, "id", "n") == [(1, 2), (2, 2), (3, 1), (4, 1)]
        some = groups.group_value(df, ["a", "b"], F.max("id"), "most", onto=df.where("id < 3"))
        assert rows(some, "id", "most") == [(1, 2), (2, 2)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
