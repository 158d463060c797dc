"""Named queries for sources, cleaning, groups and intervals (stage 1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dayspan.operators import clean, groups, intervals
from dayspan.operators.quality import DISTINCT_ERROR, RANK_ERROR, profile, profile_sketched
from dayspan.plans import curation
from dayspan.plans.catalog import register
from dayspan.plans.spans import KEYS, SPAN, clipped_spans, kept_absences
from dayspan.sources import fixtures as fx
from dayspan.sources import tables
from dayspan.session import scratch_path


def _d(x: dt.date) -> str:
    return f"date '{x.isoformat()}'"


# A1, G1 -- parts with different headers, unioned by name ---------------------
PART_RENAMES = [
    {"c_custkey": "party_key", "c_name": "party_name", "c_nationkey": "nation_key",
     "c_acctbal": "balance", "c_mktsegment": "segment"},
    {"s_suppkey": "party_key", "s_name": "party_name", "s_nationkey": "nation_key", "s_acctbal": "balance"},
]


def q_read_parts_union(spark, sf):
    paths = [f"{sf}/customer.parquet", f"{sf}/supplier.parquet"]
    return tables.read_parts(spark, paths, renames=PART_RENAMES, part_col="part")


register("read_parts_union", q_read_parts_union, """
select c_custkey as party_key, c_name as party_name, c_nationkey as nation_key, c_acctbal as balance,
       c_mktsegment as segment, 0 as part from customer
union all
select s_suppkey, s_name, s_nationkey, s_acctbal, null, 1 from supplier""")


# A3, A6 -- code dictionary with an override, applied by broadcast join -------
MAPPING_DEFAULTS = [
    ("segment", "AUTOMOBILE", "auto"),
    ("segment", "MACHINERY", "machines"),
    ("status", "F", "final"),
]
MAPPING_OVERRIDES = [
    ("status", "F", "finished"),
    ("status", "O", "open"),
]


BINDINGS = {"cost_center": "segment", "contract_type": "status"}


def _mapping(spark):
    schema = "category string, raw string, canonical string"
    return clean.build_mapping(spark.createDataFrame(MAPPING_DEFAULTS, schema),
                               spark.createDataFrame(MAPPING_OVERRIDES, schema))


def q_recode_lookup(spark, sf):
    c = fx.contracts(spark, sf).select("contract_id", "cost_center", "contract_type")
    return clean.recode(c, _mapping(spark), BINDINGS)


register("recode_lookup", q_recode_lookup, """
select contract_id,
       case cost_center when 'AUTOMOBILE' then 'auto' when 'MACHINERY' then 'machines' else cost_center end
         as cost_center,
       case contract_type when 'F' then 'finished' when 'O' then 'open' else contract_type end as contract_type
from contracts""", ("contracts",))


# A4 -- header normalisation ---------------------------------------------------
SHEET_HEADERS = ["Cust Key", "Náme", "Nation.Key", "Acct Bal", "Mkt Segment"]


def q_headers_normalized(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    sheet = c.toDF(*SHEET_HEADERS).withColumn("NAME", F.upper(F.col("Náme")))
    return tables.normalize_headers(sheet)


register("headers_normalized", q_headers_normalized, """
select c_custkey as cust_key, c_name as name, c_nationkey as nationkey, c_acctbal as acct_bal,
       c_mktsegment as mkt_segment, upper(c_name) as name_dup from customer""")


# A13 -- reproducible hash sample ---------------------------------------------
def q_hash_sample(spark, sf):
    return tables.hash_sample(fx.contracts(spark, sf), "contract_id", 0.1) \
                 .select("contract_id", "worker_id", "start_date")


register("hash_sample", q_hash_sample, """
select contract_id, worker_id, start_date from contracts
where cast(('0x' || substr(md5(length(cast(contract_id as varchar)) || ':' || cast(contract_id as varchar)), 1, 8)) as bigint) / 4294967296.0 < 0.1""",
         ("contracts",))


# A15 -- column profile ---------------------------------------------------------
PROFILE_COLS = ["contract_id", "worker_id", "division", "cost_center", "category", "contract_type", "start_date", "end_date",
                "hire_date", "birth_date", "amount"]


def q_profile_columns(spark, sf):
    return profile(fx.contracts(spark, sf), PROFILE_COLS)


def _profile_sql() -> str:
    parts = []
    for c in PROFILE_COLS:
        v = f"cast({c} as varchar)"
        parts.append(f"""select '{c}' as column, count(*) as rows, count(*) filter (where {c} is null) as nulls,
       count(*) filter (where trim({v}) = '') as blanks, count(distinct {v}) as distinct_values from contracts""")
    return "\nunion all\n".join(parts)


register("profile_columns", q_profile_columns, _profile_sql(), ("contracts",))


# A15 by sketches: the counts, and whether the estimates are as near the exact values as their error bounds say
def q_profile_sketched(spark, sf):
    c = fx.contracts(spark, sf)
    p = profile_sketched(c, PROFILE_COLS)
    medians = {r["column"]: r["median"] for r in p.select("column", "median").collect()}  # a number for each column
    own = {k: F.unix_date(k).cast("double") if c.schema[k].dataType.typeName() == "date" else F.col(k).cast("double")
           for k, m in medians.items() if m is not None}
    near = F.lit(0.5 - RANK_ERROR)
    ranks = c.agg(*[F.array(*[F.count_if(f) / F.count(v) >= near for f in (v <= medians[k], v >= medians[k])]).alias(k) for k, v in own.items()])
    ranks = ranks.select(F.explode(F.create_map(*[x for k in own for x in (F.lit(k), F.col(k))])).alias("of", "ok"))
    exact = profile(c, PROFILE_COLS).select(F.col("column").alias("name"), F.col("distinct_values").alias("exact"))
    close = F.abs(F.col("distinct_values") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * DISTINCT_ERROR * F.col("exact"))
    j = p.join(exact, F.col("column") == F.col("name")).join(ranks, F.col("column") == F.col("of"), "left")
    return j.select("column", "rows", "nulls", "blanks", close.alias("distinct_close"), F.forall("ok", lambda x: x).alias("median_close"))


def _profile_sketched_sql() -> str:
    measured = ", ".join(f"'{c}'" for c in PROFILE_COLS if c not in ("cost_center", "category", "contract_type"))
    return f"""
select "column", rows, nulls, blanks, true as distinct_close, case when "column" in ({measured}) then true end as median_close
from ({_profile_sql()}) p"""


register("profile_sketched", q_profile_sketched, _profile_sketched_sql(), ("contracts",))


# B1, E7 -- drop columns then full-row dedupe ----------------------------------
def q_dedupe_rows(spark, sf):
    c = fx.contracts(spark, sf)
    return clean.dedupe(clean.drop_columns(c, ["contract_id", "start_date", "end_date", "hire_date", "birth_date",
                                               "amount", "category", "not_there"]))


register("dedupe_rows", q_dedupe_rows, """
select distinct worker_id, division, cost_center, contract_type from contracts""", ("contracts",))


# B3, B5 -- casts that yield null instead of failing ---------------------------
def q_cast_try(spark, sf):
    p = fx.table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("string").alias("size_txt"), F.col("p_name").alias("name_txt"),
        F.substring("p_brand", 7, 3).alias("brand_txt"), F.col("p_retailprice").cast("string").alias("price_txt"))
    p = p.withColumn("day_txt", F.when(F.col("p_partkey") % 5 == 0, F.lit("not a date"))
                     .otherwise(F.date_format(F.date_add(F.lit(dt.date(1998, 1, 1)), (F.col("p_partkey") % 300)
                                                         .cast("int")), "yyyy-MM-dd")))
    return clean.cast_columns(p, {"size_txt": "int", "name_txt": "int", "brand_txt": "int",
                                  "price_txt": "double", "day_txt": "date"})


register("cast_try", q_cast_try, """
select p_partkey, try_cast(cast(p_size as varchar) as integer) as size_txt, try_cast(p_name as integer) as name_txt,
       try_cast(substr(p_brand, 7, 3) as integer) as brand_txt,
       try_cast(cast(p_retailprice as varchar) as double) as price_txt,
       case when p_partkey % 5 = 0 then null
            else date '1998-01-01' + cast(p_partkey % 300 as integer) end as day_txt
from part""")


# B6 -- cast to double and round ---------------------------------------------
def q_round_numeric(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount",
                                                "l_tax")
    li = li.withColumn("price_k", F.col("l_extendedprice") / 1000) \
           .withColumn("disc_tax", F.col("l_discount") * 10 + F.col("l_tax"))
    return clean.round_columns(li, {"price_k": 2, "disc_tax": 1}) \
                .select("l_orderkey", "l_linenumber", "price_k", "disc_tax")


register("round_numeric", q_round_numeric, """
select l_orderkey, l_linenumber,
       cast(round(cast(l_extendedprice / 1000 as decimal(38, 10)), 2) as double) as price_k,
       cast(round(cast(l_discount * 10 + l_tax as decimal(38, 10)), 1) as double) as disc_tax
from lineitem""")


# B9 -- blank text to a default --------------------------------------------------
def q_fill_blank(spark, sf):
    c = fx.contracts(spark, sf).select("contract_id", "cost_center", "category")
    return clean.fill_blank(c, curation.BLANK_DEFAULTS)


register("fill_blank", q_fill_blank, """
select contract_id, case when trim(cost_center) = '' then 'undefined' else cost_center end as cost_center,
       case when trim(category) = '' then 'undefined' else category end as category
from contracts""", ("contracts",))


# B10, B11 -- null to a constant code or to another column ---------------------
def q_fill_null(spark, sf):
    c = fx.contracts(spark, sf).select("contract_id", "division", "start_date", "hire_date")
    c = c.withColumn("division_code", F.when(F.col("contract_id") % 7 == 0, F.lit(None))
                     .otherwise(F.col("division")))
    c = clean.pad_code(c, "division_code", 5, default="00000")
    return clean.fill_null(c, {"hire_date": F.col("start_date")}).select("contract_id", "division_code", "hire_date")


register("fill_null", q_fill_null, """
select contract_id,
       coalesce(lpad(cast(case when contract_id % 7 = 0 then null else division end as varchar), 5, '0'), '00000')
         as division_code,
       coalesce(hire_date, start_date) as hire_date
from contracts""", ("contracts",))


# B12, B13 -- dependent flag and relation label -----------------------------------
def q_presence_flag(spark, sf):
    return curation.dependent_flags(spark, sf)


DEPENDENTS_SQL = """dependents as (
  select l_orderkey as contract_id, l_linenumber as line,
         case when l_linenumber % 3 = 0 then '' else l_linestatus end as relation,
         case when l_linenumber % 4 = 0 then null else cast(l_partkey % 3 as integer) end as object_id
  from lineitem)"""

register("presence_flag", q_presence_flag, f"""with {DEPENDENTS_SQL},
flags as (select *, case when (relation is not null and trim(relation) <> '')
                           or (trim(relation) = '' and object_id is not null and object_id <> 0)
                    then 1 else 0 end as has_dependent from dependents)
select *, case when trim(relation) = '' and has_dependent = 1 then 'some'
               when trim(relation) = '' and has_dependent = 0 then 'none' else relation end as relation_label
from flags""")


# E1 -- fold dependents per contract -------------------------------------------------
def q_fold_children(spark, sf):
    return groups.fold_children(curation.dependent_flags(spark, sf), ["contract_id"], "has_dependent",
                                "dependents")


register("fold_children", q_fold_children, f"""with {DEPENDENTS_SQL}
select contract_id, cast(sum(case when (relation is not null and trim(relation) <> '')
                           or (trim(relation) = '' and object_id is not null and object_id <> 0)
                    then 1 else 0 end) as bigint) as dependents
from dependents group by contract_id""")


# B15 -- hire date capped at the span start ------------------------------------
def q_cap_hire_date(spark, sf):
    c = clipped_spans(spark, sf).select("contract_id", "span_start", "hire_date")
    return clean.cap_date(c, "hire_date", "span_start", out="hire_capped")


register("cap_hire_date", q_cap_hire_date, """
select contract_id, span_start, hire_date,
       case when hire_date > span_start then span_start else hire_date end as hire_capped
from spans""", ("spans",))


# C1, C3 -- ended on or before the as-of date ------------------------------------
def q_ended_before(spark, sf):
    c = clean.ended_before(fx.contracts(spark, sf), "end_date", fx.AS_OF)
    a = clean.ended_before(fx.absences(spark, sf), "end_date", dt.date(1998, 6, 30), inclusive=False)
    return c.groupBy("contract_type").agg(F.count(F.lit(1)).alias("n"), F.max("end_date").alias("last_end")) \
            .withColumn("source", F.lit("contracts")) \
            .unionByName(a.groupBy(F.col("absence_class").alias("contract_type"))
                          .agg(F.count(F.lit(1)).alias("n"), F.max("end_date").alias("last_end"))
                          .withColumn("source", F.lit("absences")))


register("ended_before", q_ended_before, f"""
select contract_type, count(*) as n, max(end_date) as last_end, 'contracts' as source
from contracts where end_date <= {_d(fx.AS_OF)} group by contract_type
union all
select absence_class, count(*), max(end_date), 'absences' from absences
where end_date < date '1998-06-30' group by absence_class""", ("contracts", "absences"))


# C2 -- exclude classes, keep null ---------------------------------------------------
def q_exclude_classes(spark, sf):
    a = fx.absences(spark, sf).withColumn(
        "absence_class", F.when(F.dayofmonth("start_date") == 1, F.lit(None)).otherwise(F.col("absence_class")))
    a = clean.exclude_values(a, "absence_class", fx.EXCLUDED_CLASSES, keep_null=True)
    return a.groupBy("absence_class").agg(F.count(F.lit(1)).alias("n"))


register("exclude_classes", q_exclude_classes, f"""
select absence_class, count(*) as n from (
  select case when day(start_date) = 1 then null else absence_class end as absence_class from absences) a
where absence_class is null or absence_class not in ({fx.EXCLUDED_SQL})
group by absence_class""", ("absences",))


# D1, E2 -- latest previous end per worker and division, plus one day ------------------
def q_previous_end(spark, sf):
    c = fx.contracts(spark, sf).select("contract_id", *KEYS, "end_date")
    return groups.previous_end(c, KEYS, "end_date", fx.AS_OF, "prev_end").select("contract_id", "prev_end")


register("previous_end", q_previous_end, f"""
select c.contract_id, p.prev_end from contracts c left join (
  select worker_id, division, max(case when end_date <= {_d(fx.AS_OF)} then end_date end) + 1 as prev_end
  from contracts group by worker_id, division) p
on c.worker_id = p.worker_id and c.division = p.division""", ("contracts",))


# D2, E3 -- concurrent assignments: rows sharing worker and span ------------------
def q_concurrent_assignments(spark, sf):
    s = clipped_spans(spark, sf).select("contract_id", "worker_id", "category", *SPAN)
    s = s.withColumn("category", F.when(F.col("category") == "", F.lit(None)).otherwise(F.col("category")))
    s = groups.group_size(s, ["worker_id", "category"], "same_category")
    s = groups.group_size(s, ["worker_id", "category"], "same_category_strict", null_keys="exclude")
    return groups.group_size(s, curation.CONCURRENT_KEYS, "concurrent") \
                 .select("contract_id", "same_category", "same_category_strict", "concurrent")


register("concurrent_assignments", q_concurrent_assignments, """
select contract_id,
       count(*) over (partition by worker_id, category) as same_category,
       case when category is null then null else count(*) over (partition by worker_id, category) end
         as same_category_strict,
       count(*) over (partition by worker_id, span_start, span_end) as concurrent
from (select contract_id, worker_id, span_start, span_end,
             case when category = '' then null else category end as category from spans) s""", ("spans",))


# H2, H4 -- clip to the window and measure -------------------------------------------
def q_clip_span(spark, sf):
    return clipped_spans(spark, sf).select("contract_id", "span_start", "span_end", "span_days")


register("clip_span", q_clip_span, "select contract_id, span_start, span_end, span_days from spans", ("spans",))


# H3 -- open-ended contracts start the day after the last closed one ----------------
def q_repair_open_ended(spark, sf):
    c = curation.prepared_contracts(spark, sf)
    return c.where(F.year("end_date") == 9999).select("contract_id", "start_date", "prev_end", "eff_start")


register("repair_open_ended", q_repair_open_ended, f"""
select c.contract_id, c.start_date, p.prev_end,
       case when p.prev_end is not null then p.prev_end else c.start_date end as eff_start
from contracts c left join (
  select worker_id, division, max(case when end_date <= {_d(fx.AS_OF)} then end_date end) + 1 as prev_end
  from contracts group by worker_id, division) p
on c.worker_id = p.worker_id and c.division = p.division
where year(c.end_date) = 9999""", ("contracts",))


# D3, H5, H6 -- left interval overlap join ------------------------------------------
OVERLAP_COLS = ["contract_id", "worker_id", "division", "span_start", "span_end", "r_absence_class",
                "overlap_start", "overlap_end", "overlap_days"]


def q_overlap_join(spark, sf):
    spans = clipped_spans(spark, sf).select("contract_id", *KEYS, *SPAN, "span_days")
    j = intervals.interval_overlap_join(spans, kept_absences(spark, sf), KEYS, SPAN, ("start_date", "end_date"))
    return intervals.overlap_days(j, "overlap_start", "overlap_end", "overlap_days").select(*OVERLAP_COLS)


def q_overlap_join_bucketed(spark, sf):
    spans = clipped_spans(spark, sf).select("contract_id", *KEYS, *SPAN, "span_days")
    return curation.overlap_rows(spans, kept_absences(spark, sf)).select(*OVERLAP_COLS)


OVERLAP_SQL = """
select s.contract_id, s.worker_id, s.division, s.span_start, s.span_end, a.absence_class as r_absence_class,
       case when a.start_date is null then null
            else greatest(s.span_start, a.start_date) end as overlap_start,
       case when a.end_date is null then null else least(s.span_end, a.end_date) end as overlap_end,
       case when a.start_date is null then 0
            else cast(datediff('day', greatest(s.span_start, a.start_date), least(s.span_end, a.end_date)) + 1
                      as int) end as overlap_days
from spans s left join kept_absences a
  on a.worker_id = s.worker_id and a.division = s.division
 and a.start_date <= s.span_end and a.end_date >= s.span_start"""

register("overlap_join", q_overlap_join, OVERLAP_SQL, ("spans", "kept_absences"))
register("overlap_join_bucketed", q_overlap_join_bucketed, OVERLAP_SQL, ("spans", "kept_absences"))


# D3 with a hot key: a third of the workers are taken for one, and their pairs counted per contract
def one_worker(df):
    third = F.col("worker_id") % 3 == 0
    return df.withColumns({k: F.when(third, F.lit(1)).otherwise(F.col(k)).cast(df.schema[k].dataType) for k in KEYS})


def q_overlap_join_hot(spark, sf):
    """Absences of one worker with equal spans are joined once and counted, so a contract of the hot key
    meets no more rows than there are different spans near it, however many absences the key has."""
    spans = one_worker(clipped_spans(spark, sf).select("contract_id", *KEYS, *SPAN))
    classes = intervals.count_copies(one_worker(kept_absences(spark, sf)), [*KEYS, "start_date", "end_date"])
    j = intervals.interval_overlap_join(spans, classes, KEYS, SPAN, ("start_date", "end_date"), hot=0.01)
    j = intervals.overlap_days(j, "overlap_start", "overlap_end", "overlap_days")
    return j.groupBy("contract_id").agg(F.coalesce(F.sum("r_copies"), F.lit(0)).alias("pairs"),
                                        F.coalesce(F.sum(F.col("overlap_days") * F.col("r_copies")), F.lit(0)).cast("long").alias("overlap_days"))


_ONE_WORKER = "* replace (case when worker_id % 3 = 0 then 1 else worker_id end as worker_id, case when worker_id % 3 = 0 then 1 else division end as division)"
register("overlap_join_hot", q_overlap_join_hot, f"""
select s.contract_id, count(a.start_date) as pairs,
       cast(coalesce(sum(datediff('day', greatest(s.span_start, a.start_date), least(s.span_end, a.end_date)) + 1) filter (where a.start_date is not null), 0) as bigint) as overlap_days
from (select {_ONE_WORKER} from spans) s left join (select {_ONE_WORKER} from kept_absences) a
  on a.worker_id = s.worker_id and a.division = s.division and a.start_date <= s.span_end and a.end_date >= s.span_start
group by s.contract_id""", ("spans", "kept_absences"))


# D4, E4 -- contract totals attached to every overlap row -----------------------------
def q_contract_totals(spark, sf):
    return curation.contract_totals(spark, sf).select(
        "contract_id", "r_absence_class", "overlap_start", "overlap_days", "total_absence_days",
        "total_absence_share")


register("contract_totals", q_contract_totals, f"""
select contract_id, r_absence_class, overlap_start, overlap_days,
       cast(sum(overlap_days) over (partition by contract_id) as bigint) as total_absence_days,
       round(sum(overlap_days) over (partition by contract_id) / span_days, 6) as total_absence_share
from (select o.*, s.span_days from ({OVERLAP_SQL}) o join spans s using (contract_id)) t""",
         ("spans", "kept_absences"))


# E5 -- grand totals -------------------------------------------------------------------
def q_grand_totals(spark, sf):
    spans = clipped_spans(spark, sf).select(F.col("contract_id").alias(curation.ROW), *KEYS, *SPAN, "span_days")
    totals = curation.absence_totals(spans, kept_absences(spark, sf), curation.WINDOW)
    rows = spans.join(totals, curation.ROW, "left")
    return groups.grand_totals(rows, {"absence_days": "total_absence_days", "span_days": "span_days"})


register("grand_totals", q_grand_totals, f"""
select cast(sum(overlap_days) as bigint) as absence_days,
       (select cast(sum(span_days) as bigint) from spans) as span_days
from ({OVERLAP_SQL}) o""", ("spans", "kept_absences"))


# E8 -- keyed dedupe, keep the first row by an order ----------------------------------
def q_dedupe_keep_first(spark, sf):
    a = fx.absences(spark, sf)
    return clean.dedupe_keep_first(a, ["worker_id", "division", "start_date"], ["end_date", "absence_class"])


register("dedupe_keep_first", q_dedupe_keep_first, """
select worker_id, division, absence_class, start_date, end_date from (
  select *, row_number() over (partition by worker_id, division, start_date
                               order by end_date, absence_class) as rn from absences) a
where rn = 1""", ("absences",))


# Stage-1 output: curated spans ------------------------------------------------------
CURATED_COLS = ["contract_id", "worker_id", "division", "cost_center", "category", "contract_type", "eff_start",
                "span_start", "span_end", "span_days", "hire_date", "concurrent", "birth_date",
                "total_absence_days", "total_absence_share"]


def q_curated_spans(spark, sf):
    return curation.curated_spans(spark, sf).select(*CURATED_COLS)


register("curated_spans", q_curated_spans,
         curation.with_curated("select " + ", ".join(CURATED_COLS) + " from curated"))

# D4 by days -- every day under any absence counts once ---------------------------------
def q_contract_distinct_days(spark, sf):
    c = curation.curate_spans(fx.contracts(spark, sf), kept_absences(spark, sf), curation.WINDOW, fx.AS_OF, totals="distinct_days")
    return c.select("contract_id", "span_days", "total_absence_days", "total_absence_share")


register("contract_distinct_days", q_contract_distinct_days, curation.with_curated("""
, covered as (
    select distinct c.contract_id, cast(unnest(generate_series(greatest(c.span_start, a.start_date), least(c.span_end, a.end_date),
                                                               interval 1 day)) as date) as day
    from curated c join kept_absences a on a.worker_id = c.worker_id and a.division = c.division
     and a.start_date <= c.span_end and a.end_date >= c.span_start)
select contract_id, any_value(span_days) as span_days, count(day) as total_absence_days,
       round(count(day) / any_value(span_days), 6) as total_absence_share
from curated left join covered using (contract_id) group by contract_id"""))


# Stage 1 end to end: typed yearly parts, casts, recode, dependents, curation -----------
PART_SCHEMA = ("contract_id long, worker_id string, division string, cost_center string, category string, contract_type string, "
               "start_date string, end_date string, hire_date string, birth_date string, amount string")
PART_CASTS = {"worker_id": "bigint", "division": "int", "start_date": "date", "end_date": "date", "hire_date": "date",
              "birth_date": "date", "amount": "double"}
CHAIN_COLS = [*CURATED_COLS, "dependents"]
# tells null from blank text in the CSV parts
NULL_TEXT = "\\N"


def q_stage_one_chain(spark, sf):
    """Contracts written as two CSV parts of text and read back with a schema,
    then the whole of stage 1 on them."""
    base = scratch_path(spark, "parts")
    whole = fx.contracts(spark, sf)
    for part, rows in (("early", F.year("start_date") < 1998), ("late", F.year("start_date") >= 1998)):
        tables.write_table(whole.where(rows), f"{base}/{part}", fmt="csv", nullValue=NULL_TEXT)
    parts = tables.read_parts(spark, [f"{base}/early", f"{base}/late"], fmt="csv", schemas=PART_SCHEMA, nullValue=NULL_TEXT)
    c = curation.curate_parts(parts, PART_CASTS, _mapping(spark), BINDINGS, curation.dependent_flags(spark, sf), "has_dependent",
                              kept_absences(spark, sf), curation.WINDOW, fx.AS_OF)
    return c.select(*CHAIN_COLS)


def _chain_sql() -> str:
    code = {"cost_center": "case cost_center when 'AUTOMOBILE' then 'auto' when 'MACHINERY' then 'machines' else cost_center end",
            "contract_type": "case contract_type when 'F' then 'finished' when 'O' then 'open' else contract_type end"}
    cols = ", ".join(f"{code[c]} as {c}" if c in code else c for c in CHAIN_COLS if c != "dependents")
    return curation.with_curated(f"""
, deps as (select l_orderkey as contract_id,
                  sum(case when l_linenumber % 3 <> 0 and trim(l_linestatus) <> '' then 1
                           when l_linenumber % 4 <> 0 and l_partkey % 3 <> 0 then 1 else 0 end) as n
           from lineitem group by all)
select {cols}, cast(coalesce(n, 0) as bigint) as dependents from curated left join deps using (contract_id)""")


register("stage_one_chain", q_stage_one_chain, _chain_sql())
