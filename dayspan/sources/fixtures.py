"""Stand-in views over the driver's TPC-H-like tables.

Orders play contracts, line items play absences (see FIXTURES.md). The same
definitions are given twice: as DataFrame code for Spark, and as SQL text the
DuckDB oracle prepends to every check.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the stand-in data set (FIXTURES.md).
WINDOW_START = dt.date(1996, 1, 1)
WINDOW_END = dt.date(2001, 12, 31)
AS_OF = dt.date(2001, 12, 31)
EXCLUDED_CLASSES = ("NF", "NO")
OPEN_END = dt.date(9999, 12, 31)
BIRTH_BASE = dt.date(1950, 1, 1)
TRAIN_BEFORE = 1999
TEST_YEAR = 1999
# One holiday period per year of the window (name, first day, last day).
HOLIDAY_PERIODS = [
    ("spring_1996", dt.date(1996, 3, 31), dt.date(1996, 4, 7)),
    ("spring_1997", dt.date(1997, 3, 23), dt.date(1997, 3, 30)),
    ("spring_1998", dt.date(1998, 4, 5), dt.date(1998, 4, 12)),
    ("spring_1999", dt.date(1999, 3, 28), dt.date(1999, 4, 4)),
    ("spring_2000", dt.date(2000, 4, 16), dt.date(2000, 4, 20)),
    ("spring_2001", dt.date(2001, 4, 8), dt.date(2001, 4, 15)),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to customer, the columns both views need."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey, "inner")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contract_id, worker_id, division, cost_center, category, contract_type,
    start_date, end_date (9999-12-31 = open ended), hire_date, birth_date
    (1950 .. 1982, derived from the worker id), amount."""
    oc = order_owner(spark, sf_dir)
    key = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    return oc.select(
        key.alias("contract_id"),
        F.col("o_custkey").alias("worker_id"),
        F.col("c_nationkey").alias("division"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.col("c_mktsegment")).alias("cost_center"),
        F.when(key % 11 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("category"),
        F.col("o_orderstatus").alias("contract_type"),
        start.alias("start_date"),
        F.when(key % 97 == 0, F.lit(OPEN_END))
         .otherwise(F.date_add(start, (key % 30).cast("int"))).alias("end_date"),
        F.when(key % 13 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(start, (key % 400).cast("int") - 390)).alias("hire_date"),
        F.date_add(F.lit(BIRTH_BASE), (F.col("o_custkey") % 12000).cast("int")).alias("birth_date"),
        F.col("o_totalprice").alias("amount"),
    )


def absences(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """worker_id, division, absence_class, start_date, end_date (distinct rows).

    ``distinct=False`` skips the row-level dedupe for consumers that only use
    set semantics downstream (e.g. a distinct per worker and day), saving a
    shuffle of the largest table.
    """
    start = F.to_date("l_shipdate")
    # class and dates are taken before the join, whose rows are narrower then
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("absence_class"),
        start.alias("start_date"),
        F.date_add(start, (F.col("l_quantity") % 10).cast("int")).alias("end_date"),
    )
    owner = order_owner(spark, sf_dir).select("o_orderkey", "o_custkey", "c_nationkey")
    out = li.join(owner, li.l_orderkey == owner.o_orderkey, "inner").select(
        F.col("o_custkey").alias("worker_id"), F.col("c_nationkey").alias("division"),
        "absence_class", "start_date", "end_date")
    return out.distinct() if distinct else out


def holiday_periods(spark: SparkSession) -> DataFrame:
    """The fixed holiday table (a handful of literal rows, a parameter)."""
    return spark.createDataFrame(HOLIDAY_PERIODS, "name string, start_date date, end_date date")


# ---- the same views as SQL text for the DuckDB oracle ----------------------

def _d(x: dt.date) -> str:
    return f"date '{x.isoformat()}'"


CONTRACTS_SQL = f"""
select o_orderkey as contract_id, o_custkey as worker_id, c_nationkey as division,
       case when c_mktsegment = 'BUILDING' then '' else c_mktsegment end as cost_center,
       case when o_orderkey % 11 = 0 then '' else o_orderpriority end as category,
       o_orderstatus as contract_type,
       cast(o_orderdate as date) as start_date,
       case when o_orderkey % 97 = 0 then {_d(OPEN_END)}
            else cast(o_orderdate as date) + cast(o_orderkey % 30 as int) end as end_date,
       case when o_orderkey % 13 = 0 then null
            else cast(o_orderdate as date) + cast(o_orderkey % 400 as int) - 390 end as hire_date,
       {_d(BIRTH_BASE)} + cast(o_custkey % 12000 as int) as birth_date,
       o_totalprice as amount
from orders join customer on o_custkey = c_custkey"""

ABSENCES_SQL = """
select distinct o_custkey as worker_id, c_nationkey as division, l_returnflag || l_linestatus as absence_class,
       cast(l_shipdate as date) as start_date,
       cast(l_shipdate as date) + cast(l_quantity % 10 as int) as end_date
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"""

HOLIDAYS_SQL = " union all ".join(
    f"select '{n}' as name, {_d(s)} as start_date, {_d(e)} as end_date" for n, s, e in HOLIDAY_PERIODS)

EXCLUDED_SQL = ", ".join(f"'{c}'" for c in EXCLUDED_CLASSES)

# Contracts clipped to the window (touching it), absences filtered and clipped.
SPANS_SQL = f"""
select *, cast(datediff('day', span_start, span_end) + 1 as int) as span_days from (
  select *, case when start_date < {_d(WINDOW_START)} then {_d(WINDOW_START)} else start_date end as span_start,
            case when end_date > {_d(WINDOW_END)} then {_d(WINDOW_END)} else end_date end as span_end
  from contracts) s
where span_start <= span_end"""

KEPT_ABSENCES_SQL = f"""
select * from absences where absence_class is null or absence_class not in ({EXCLUDED_SQL})"""


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with the named fixture views as CTEs (DuckDB dialect)."""
    known = {
        "contracts": CONTRACTS_SQL,
        "absences": ABSENCES_SQL,
        "holidays": HOLIDAYS_SQL,
        "spans": SPANS_SQL,
        "kept_absences": KEPT_ABSENCES_SQL,
    }
    order = ["contracts", "absences", "holidays", "spans", "kept_absences"]
    need = set(views)
    if "spans" in need:
        need.add("contracts")
    if "kept_absences" in need:
        need.add("absences")
    ctes = [f"{v} as ({known[v]})" for v in order if v in need]
    return "with " + ",\n".join(ctes) + "\n" + body
