"""Plan-shape checks: pruned scans, pushed filters, no quadratic joins."""

import contextlib
import io

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_flagship_scans_are_pruned(spark):
    p = _plan(E.entry(spark))
    # only the five line-item columns the absences need reach the scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string," \
           "l_shipdate:timestamp_ntz>" in p
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in p
    assert "PushedFilters: [IsNotNull(o_custkey)" in p
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p


def test_wide_rows_are_expanded_after_the_last_shuffle(spark):
    """In the day matrix no exchange stands above the expansion of the months' pieces to days."""
    p = E.queries()["day_matrix"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    above = p[p.index("BroadcastHashJoin [day#"): p.index("Generate explode(sequence(__p1#")]
    assert "Exchange" not in above


def test_curated_spans_become_days_without_a_shuffle(spark):
    """The day matrix meets no absences again (its spans and folded absences were shuffled by month a second time before)."""
    p = E.queries()["day_matrix"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "absence_months" in p and "hashpartitioning(__k0" not in p and "hashpartitioning(worker_id" not in p


def test_daily_rate_aggregates_before_shuffling_days(spark):
    """Contract-days are pre-aggregated per day in the task that expands them."""
    p = _plan(E.entry(spark))
    assert "hashpartitioning(day#" in p
    assert not any(line.strip().startswith("Arguments: hashpartitioning(worker_id") and "day#" in line for line in p.splitlines())


def _scans(df, table: str) -> int:
    return sum(line.strip().startswith("Location:") and f"/{table}.parquet" in line for line in _plan(df).splitlines())


def test_stage_one_reads_orders_at_most_twice(spark):
    for name in ("curated_spans", "contract_totals"):
        assert _scans(E.queries()[name](spark, SF_SMALL), "orders") <= 2


def test_day_matrix_has_no_quadratic_join(spark):
    p = _plan(E.queries()["day_matrix"](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p


def test_bucketed_overlap_join_adds_month_to_the_key(spark):
    from dayspan.operators.intervals import interval_overlap_join_bucketed
    from dayspan.plans.spans import KEYS, SPAN, clipped_spans, kept_absences
    from dayspan.sources import fixtures as fx
    j = interval_overlap_join_bucketed(clipped_spans(spark, SF_SMALL), kept_absences(spark, SF_SMALL), KEYS, SPAN,
                                       ("start_date", "end_date"), (fx.WINDOW_START, fx.WINDOW_END), how="inner")
    p = _plan(j)
    assert "__lm" in p and "__rm" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_years_of_the_stored_matrix_are_pruned(spark):
    """Train, test and back-test read their own years' files."""
    from dayspan.plans import training as tr
    m = tr.model_frame(spark, SF_SMALL)
    train, test = tr.train_test(m)
    back = m.where("year in (1999, 2000, 2001)")
    for df, years in ((train, "year#"), (test, "(year#"), (back, "year#")):
        p = _plan(df)
        assert "PartitionFilters: [" in p and years in p[p.index("PartitionFilters: ["):].splitlines()[0]
    files = lambda df: {f.split("year=")[1][:4] for f in df.inputFiles()}
    assert files(m) >= {"1997", "1998", "1999"}
    assert {r.year for r in test.select("year").distinct().collect()} == {1999}


def test_stored_matrix_holds_what_is_asked_and_is_written_without_a_sort(spark, monkeypatch):
    from dayspan.plans import training as tr
    from dayspan.sources import tables
    m = tr.model_frame(spark, SF_SMALL, columns=["contract_id", "day"])
    assert set(m.columns) == {"contract_id", "day", "absent", "year", "label"}
    before = spark.conf.get(tables.OPEN_FILES_CONF)
    seen = []
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path: seen.append(spark.conf.get(tables.OPEN_FILES_CONF)))
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path: spark.range(0).selectExpr("id as y"))
    tables.materialize(spark.range(5).selectExpr("id as y"), "t", partition_by=["y"])
    assert int(seen[0]) >= 16 and spark.conf.get(tables.OPEN_FILES_CONF) == before


def test_folded_days_are_not_shuffled(spark):
    """No join or exchange stands above the expansion of the months' pieces to days."""
    p = E.queries()["fold_days"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    above = p[:p.index("Generate explode(sequence(__p1#")]
    assert "Exchange" not in above and "Join" not in above


def test_the_loaded_model_scores_in_the_same_pass(spark):
    p = E.queries()["model_roundtrip"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in p
