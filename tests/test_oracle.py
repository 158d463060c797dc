"""Spark queries against their DuckDB oracles on the smallest data set."""

import pytest

import __spark_entry__ as E
from dayspan.plans import catalog
from conftest import SF_SMALL
from oracle_check import compare, duck_connection

# every oracle of the library itself; the optional operators have tests of their own
NAMES = sorted(n for n in catalog.ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(E.queries()[name](spark, SF_SMALL), con, E.oracle_sql()[name])
    assert r["ok"], r


def test_every_query_has_oracle_or_is_model():
    rows_only = set(catalog.QUERIES) - set(catalog.ORACLE)
    assert rows_only == {"logistic_scored", "logistic_tuned", "forest_scored", "forest_weighted",
                         "forest_lineitem"}


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["day", "contract_days", "absent_days", "absence_rate"]
    assert df.count() == 2192


def test_generic_entry_equals_fixture_plan(spark):
    from dayspan.plans.day_matrix import build_day_matrix, day_matrix
    from dayspan.sources import fixtures as fx
    generic = build_day_matrix(fx.contracts(spark, SF_SMALL), fx.absences(spark, SF_SMALL), fx.holiday_periods(spark),
                               (fx.WINDOW_START, fx.WINDOW_END), fx.AS_OF, fx.EXCLUDED_CLASSES)
    fixed = day_matrix(spark, SF_SMALL)
    cols = sorted(fixed.columns)
    assert generic.select(*cols).exceptAll(fixed.select(*cols)).count() == 0
    assert generic.count() == fixed.count()


def test_curation_on_the_callers_tables(spark):
    """Birth dates pass through, and absences are tied by the caller's keys."""
    import datetime as dt
    from dayspan.plans.curation import curate_spans
    d = dt.date
    keys = ["worker_id", "division", "cost_center", "order_no", "contract_id"]
    contracts = spark.createDataFrame([
        (1, 10, 5, "c1", 77, "k", "t", d(2000, 1, 1), d(2000, 1, 31), None, d(1975, 5, 5)),
        (2, 10, 5, "c2", 77, "k", "t", d(2000, 1, 1), d(2000, 1, 31), d(1999, 1, 1), d(1975, 5, 5)),
        (3, 11, 5, "c1", 78, "k", "t", d(2000, 2, 1), d(9999, 12, 31), None, None)],
        "contract_id long, worker_id long, division int, cost_center string, order_no long, category string, contract_type string, "
        "start_date date, end_date date, hire_date date, birth_date date")
    absences = spark.createDataFrame([
        (10, 5, "c1", 77, 1, "A", d(2000, 1, 5), d(2000, 1, 6)), (10, 5, "c1", 77, 1, "B", d(2000, 1, 6), d(2000, 1, 8)),
        (10, 5, "c1", 77, 2, "A", d(2000, 1, 5), d(2000, 1, 6)), (10, 5, "c2", 76, 2, "A", d(2000, 1, 5), d(2000, 1, 6))],
        "worker_id long, division int, cost_center string, order_no long, contract_id long, absence_class string, start_date date, end_date date")
    window = (d(2000, 1, 1), d(2000, 12, 31))
    out = {r.contract_id: r for r in curate_spans(contracts, absences, window, d(2000, 12, 31), keys).collect()}
    assert [out[i].birth_date for i in (1, 2, 3)] == [d(1975, 5, 5), d(1975, 5, 5), None]
    assert [out[i].total_absence_days for i in (1, 2, 3)] == [5, 0, 0]
    distinct = curate_spans(contracts, absences, window, d(2000, 12, 31), keys, totals="distinct_days")
    assert {r.contract_id: r.total_absence_days for r in distinct.collect()} == {1: 4, 2: 0, 3: 0}
    with pytest.raises(ValueError):
        curate_spans(contracts, absences, None, d(2000, 12, 31))
