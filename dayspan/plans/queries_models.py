"""Named queries for balancing, features, models and evaluation (stage 3)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.functions.columns import round_half_up
from dayspan.operators import balance, evaluate, models
from dayspan.operators.features import fit_features
from dayspan.plans import training as tr
from dayspan.plans.catalog import register
from dayspan.plans.queries_days import key_sql, with_matrix
from dayspan.session import scratch_path
from dayspan.sources import fixtures as fx
from dayspan.sources.tables import read_table, write_table

UNIT = ["contract_id", "day"]


KEY_SQL = key_sql("contract_id", "day")
COIN_SQL = f"cast(('0x' || substr(md5({KEY_SQL} || 'resample'), 1, 8)) as bigint) / 4294967296.0"


def _sample_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("absent").agg(F.count(F.lit(1)).alias("rows"),
                                    F.sum("contract_id").cast("long").alias("key_sum"),
                                    F.max("copy").alias("max_copy"))


# E13 -- label histogram ----------------------------------------------------------
def q_label_histogram(spark, sf):
    h = balance.label_histogram(tr.model_frame(spark, sf, materialize=False), "absent")
    return h.withColumn("share", F.round("share", 6))


register("label_histogram", q_label_histogram, with_matrix("""
select absent, count(*) as n, cast(sum(count(*)) over () as bigint) as total, count(*) over () as classes,
       round(count(*) / sum(count(*)) over (), 6) as share
from matrix group by absent"""))


# M1 -- balanced class weights (histogram of the training rows) ----------------------
def q_class_weights(spark, sf):
    m = tr.model_frame(spark, sf, columns=[])
    train, _ = tr.train_test(m)
    w = balance.class_weights(m, "absent", "weight", base=train)
    return w.groupBy("absent", F.round("weight", 6).alias("weight")).agg(F.count(F.lit(1)).alias("rows"))


register("class_weights", q_class_weights, with_matrix(f"""
, h as (select absent, count(*) as n from matrix where year < {fx.TRAIN_BEFORE} group by absent)
select m.absent, round((select sum(n) from h) / ((select count(*) from h) * h.n), 6) as weight, count(*) as rows
from matrix m join h using (absent) group by m.absent, h.n"""))


# M2 -- square-root resampling, M3 -- fixed rates ------------------------------------
def q_resample_sqrt(spark, sf):
    return _sample_summary(balance.resample(tr.model_frame(spark, sf, columns=UNIT), "absent", UNIT))


def _replicate_sql(rate_sql: str) -> str:
    return f"""
, r as (select m.*, {rate_sql} as rate, {COIN_SQL} as coin from matrix m {{join}})
, n as (select *, cast(floor(rate) as int) + case when coin < rate - floor(rate) then 1 else 0 end as copies from r)
select absent, cast(sum(copies) as bigint) as rows, cast(sum(contract_id * copies) as bigint) as key_sum,
       max(copies) as max_copy
from n where copies >= 1 group by absent"""


register("resample_sqrt", q_resample_sqrt, with_matrix(_replicate_sql("h.rate").replace("{join}", """join (
  select absent, sqrt(max(count(*)) over () / count(*)) as rate from matrix group by absent) h using (absent)""")))

FIXED_RATES = {0: 0.8, 1: 3.2}


def q_resample_fixed(spark, sf):
    return _sample_summary(balance.resample(tr.model_frame(spark, sf, materialize=False), "absent", UNIT,
                                            rates=FIXED_RATES))


register("resample_fixed", q_resample_fixed, with_matrix(_replicate_sql(
    "case when absent = 1 then 3.2 when absent = 0 then 0.8 else 1.0 end").replace("{join}", "")))


# M4, F5 -- exact undersample to the smallest class ------------------------------------
def q_balance_exact(spark, sf):
    b = balance.balance_exact(tr.model_frame(spark, sf, materialize=False, columns=UNIT), "absent", UNIT)
    return b.groupBy("absent").agg(F.count(F.lit(1)).alias("rows"),
                                   F.sum("contract_id").cast("long").alias("key_sum"),
                                   F.min("day").alias("first_day"), F.max("day").alias("last_day"))


register("balance_exact", q_balance_exact, with_matrix(f"""
, r as (select *, row_number() over (partition by absent order by md5({KEY_SQL}), {KEY_SQL}) as rn from matrix)
select absent, count(*) as rows, cast(sum(contract_id) as bigint) as key_sum, min(day) as first_day,
       max(day) as last_day
from r where rn <= (select min(c) from (select count(*) as c from matrix group by absent) x)
group by absent"""))


# L4 -- scale to unit sample deviation, fitted on the training years ---------------------
def q_scale_numeric(spark, sf):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    m = tr.model_frame(spark, sf, columns=[*UNIT, "age_days", "tenure_days"])
    train, _ = tr.train_test(m)
    va = VectorAssembler(inputCols=["age_d", "tenure_d"], outputCol="num")
    sc = StandardScaler(inputCol="num", outputCol="scaled", withMean=False, withStd=True).fit(va.transform(train))
    out = sc.transform(va.transform(m)).withColumn("arr", vector_to_array("scaled"))
    return out.select(*UNIT, round_half_up(F.col("arr")[0], 6).alias("age_scaled"),
                      round_half_up(F.col("arr")[1], 6).alias("tenure_scaled"))


register("scale_numeric", q_scale_numeric, with_matrix(f"""
, s as (select stddev_samp(age_days) as sa, stddev_samp(tenure_days) as st from matrix
        where year < {fx.TRAIN_BEFORE})
select contract_id, day, round(age_days / s.sa, 6) as age_scaled, round(tenure_days / s.st, 6) as tenure_scaled
from matrix, s"""))

# L5 -- string indexing by descending frequency (ties by value), fitted on train ----------
INDEX_COLS = ["weekday", "age_band", "cost_center"]


def _fitted_indexer(train):
    from pyspark.ml.feature import StringIndexer
    return StringIndexer(inputCols=INDEX_COLS, outputCols=[f"{c}_idx" for c in INDEX_COLS],
                         handleInvalid="keep", stringOrderType="frequencyDesc").fit(train)


def q_index_categories(spark, sf):
    m = tr.model_frame(spark, sf, columns=[*UNIT, *INDEX_COLS])
    train, _ = tr.train_test(m)
    out = _fitted_indexer(train).transform(m)
    return out.select(*UNIT, *[F.col(f"{c}_idx").cast("int").alias(f"{c}_idx") for c in INDEX_COLS])


def _rank_cte(c: str) -> str:
    return f"""
, r_{c} as (select {c}, cast(row_number() over (order by n desc, {c}) - 1 as int) as idx, count(*) over () as k
            from (select {c}, count(*) as n from matrix where year < {fx.TRAIN_BEFORE} group by {c}) x)"""


def _index_sql(body: str) -> str:
    ctes = "".join(_rank_cte(c) for c in INDEX_COLS)
    return with_matrix(ctes + body)


register("index_categories", q_index_categories, _index_sql("""
select m.contract_id, m.day,
       cast(coalesce(a.idx, (select max(k) from r_weekday)) as int) as weekday_idx,
       cast(coalesce(b.idx, (select max(k) from r_age_band)) as int) as age_band_idx,
       cast(coalesce(c.idx, (select max(k) from r_cost_center)) as int) as cost_center_idx
from matrix m left join r_weekday a using (weekday) left join r_age_band b using (age_band)
     left join r_cost_center c using (cost_center)"""))


# L6 -- one-hot with the last level dropped ------------------------------------------------
def q_one_hot(spark, sf):
    from pyspark.ml.feature import OneHotEncoder
    m = tr.model_frame(spark, sf, columns=[*UNIT, *INDEX_COLS])
    train, _ = tr.train_test(m)
    idx = _fitted_indexer(train).transform(m)
    ohe = OneHotEncoder(inputCols=["weekday_idx"], outputCols=["weekday_vec"], dropLast=True,
                        handleInvalid="error").fit(idx)
    arr = vector_to_array(F.col("weekday_vec"))
    pos = F.array_position(arr, 1.0).cast("int")
    return ohe.transform(idx).select(*UNIT, F.size(arr).alias("width"),
                                     F.when(pos == 0, F.lit(None)).otherwise(pos - 1).alias("hot"))


register("one_hot", q_one_hot, _index_sql("""
select m.contract_id, m.day, cast((select max(k) from r_weekday) as int) as width,
       case when a.idx < (select max(k) from r_weekday) then a.idx end as hot
from matrix m left join r_weekday a using (weekday)"""))


# N4, N5 -- naive Bayes sufficient statistics (unweighted and class-weighted) ------------------
def _nb_model(spark, sf, weighted: bool):
    m = tr.model_frame(spark, sf, columns=tr.MODEL_COLUMNS)
    train, _ = tr.train_test(m)
    if weighted:
        train = balance.class_weights(train, tr.LABEL, "weight")
    return m, models.train("naive_bayes", train, tr.SPEC, weight="weight" if weighted else None)


def _nb_frame(spark, sf, weighted: bool):
    _, model = _nb_model(spark, sf, weighted)
    nb = model.stages[-1]
    labels = model.stages[0].stages[0].labelsArray
    names = [f"{c}={v}" for c, values in zip(tr.CATEGORICAL, labels, strict=True) for v in values] + [*tr.NUMERIC, "holiday_d"]
    pi, theta = nb.pi.toArray().tolist(), nb.theta.toArray().tolist()
    rows = [(float(c), names[j], float(pi[c]), float(theta[c][j])) for c in range(len(pi)) for j in range(len(names))]
    df = spark.createDataFrame(rows, "label double, feature string, log_prior double, log_theta double")
    return df.withColumn("log_prior", F.round("log_prior", 6)).withColumn("log_theta", F.round("log_theta", 6))


def _nb_ctes(weighted: bool) -> str:
    """CTEs up to ``nb``: label, feature, log_prior, log_theta of the model on the training years."""
    w = "w" if weighted else "1.0"
    wcte = """
, cw as (select absent, (select count(*) from train) / ((select count(distinct absent) from train) * count(*)) as w
         from train group by absent)""" if weighted else ""
    tw = "train join cw using (absent)" if weighted else "train"
    std = ", ".join(f"stddev_samp({c}) as {d}" for d, c in tr.NUMERIC.items())
    counted = " union all ".join(f"select absent, '{c}=' || {c} as feature, sum({w}) as s from {tw} where {c} is not null group by all"
                                 for c in tr.CATEGORICAL)
    summed = " union all ".join(f"select absent, '{d}', sum({c} * {w}) / nullif((select {d} from std), 0) from {tw} group by all"
                                for d, c in tr.NUMERIC.items())
    return f"""
, train as materialized (select * from matrix where year < {fx.TRAIN_BEFORE}){wcte}
, std as (select {std} from train)
, sums as materialized ({counted} union all {summed}
          union all select absent, 'holiday_d', sum(holiday * {w}) from {tw} group by all)
, cls as (select absent, sum({w}) as n from {tw} group by absent)
, per as (select cls.absent, f.feature, coalesce(sums.s, 0) as s from cls cross join (select distinct feature from sums) f
          left join sums on sums.absent = cls.absent and sums.feature = f.feature)
, nbtot as (select absent, sum(s) as tot, count(*) as d from per group by absent)
, nb as materialized (
    select cast(p.absent as double) as label, p.feature,
           ln(c.n + 1.0) - ln((select sum(n) from cls) + (select count(*) from cls) * 1.0) as log_prior,
           ln(p.s + 1.0) - ln(t.tot + t.d * 1.0) as log_theta
    from per p join nbtot t using (absent) join cls c using (absent))"""


def _nb_sql(weighted: bool) -> str:
    return with_matrix(_nb_ctes(weighted) + """
select label, feature, round(log_prior, 6) as log_prior, round(log_theta, 6) as log_theta from nb""")


register("nb_statistics", lambda spark, sf: _nb_frame(spark, sf, False), _nb_sql(False))
register("nb_statistics_weighted", lambda spark, sf: _nb_frame(spark, sf, True), _nb_sql(True))


# E14, O1, O3, O4, O5 -- evaluation of a deterministic stand-in predictor ------------------------
STAND_IN_SQL = f"""
, scored as (select *, cast(absent as double) as label,
                    cast(case when total_absence_share >= {tr.STAND_IN_CUT} then 1 else 0 end as double)
                      as prediction
             from matrix where year = {fx.TEST_YEAR})"""


def _test_scored(spark, sf):
    s = tr.stand_in_scored(spark, sf)
    return s.where(F.col("year") == fx.TEST_YEAR)


def q_confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_test_scored(spark, sf), "label", "prediction")


register("confusion_matrix", q_confusion_matrix, with_matrix(STAND_IN_SQL + """
select label, prediction, count(*) as count from scored group by label, prediction"""))


def q_accuracy(spark, sf):
    return evaluate.accuracy(_test_scored(spark, sf), "label", "prediction")


register("accuracy", q_accuracy, with_matrix(STAND_IN_SQL + """
select count(*) as rows, round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as accuracy
from scored"""))


def q_rate_gap(spark, sf):
    return evaluate.rate_gap(_test_scored(spark, sf), "label", "prediction", 1.0)


register("rate_gap", q_rate_gap, with_matrix(STAND_IN_SQL + """
select count(*) as total, count(*) filter (where prediction = 1) as predicted,
       count(*) filter (where label = 1) as real,
       round(count(*) filter (where prediction = 1) / count(*), 6) as predicted_rate,
       round(count(*) filter (where label = 1) / count(*), 6) as real_rate,
       round(abs(count(*) filter (where prediction = 1) - count(*) filter (where label = 1)) / count(*), 6) as gap
from scored"""))

DAILY_SQL = """
, daily as (select day, count(*) as count, count(*) filter (where label = 1) as count_label,
                   count(*) filter (where prediction = 1) as count_prediction from scored group by day)
, derr as (select *, round(count_label / count, 6) as real_rate, round(count_prediction / count, 6) as predicted_rate,
                  round(abs(count_prediction - count_label) / count, 6) as error_over_total,
                  round(case when count_label = 0 then null
                             else abs(count_prediction - count_label) / count_label end, 6) as error_over_absences
           from daily)"""


def _daily(spark, sf):
    """The daily report, sorted by day at the sink (one row per day)."""
    return evaluate.daily_error(_test_scored(spark, sf), "day", "label", "prediction", 1.0).orderBy("day")


register("daily_error", _daily, with_matrix(STAND_IN_SQL + DAILY_SQL + " select * from derr"))


def q_error_summary(spark, sf):
    return evaluate.error_summary(_daily(spark, sf))


register("error_summary", q_error_summary, with_matrix(STAND_IN_SQL + DAILY_SQL + """
select count(*) as days,
       round(avg(error_over_total), 6) as error_over_total_mean,
       round(stddev_samp(error_over_total), 6) as error_over_total_std,
       round(avg(error_over_absences), 6) as error_over_absences_mean,
       round(stddev_samp(error_over_absences), 6) as error_over_absences_std,
       round(avg(count_prediction), 6) as count_prediction_mean,
       round(stddev_samp(count_prediction), 6) as count_prediction_std
from derr"""))


# O2 -- AUC of fixed scores, against the rank sum ------------------------------------------------
def q_auc_stand_in(spark, sf):
    s = _test_scored(spark, sf).select("label", F.col("total_absence_share").alias("score"))
    return evaluate.auc(spark, s, "label", "score").select(F.round("auc", 6).alias("auc"))


register("auc_stand_in", q_auc_stand_in, with_matrix(STAND_IN_SQL + """
, ranked as (select label, rank() over (order by total_absence_share)
                    + (count(*) over (partition by total_absence_share) - 1) / 2.0 as r from scored)
select round((sum(r) filter (where label = 1) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0)
             / (count(*) filter (where label = 1)::double * count(*) filter (where label = 0)), 6) as auc from ranked"""))


# L1, L3, L7, L8 -- the fitted feature pipeline: width of the vector, and the scaled and passed-through values
def q_features_pipeline(spark, sf):
    m = tr.model_frame(spark, sf, columns=tr.MODEL_COLUMNS)
    train, _ = tr.train_test(m)
    out = vector_to_array(F.col("features"))
    v = fit_features(tr.SPEC, train).transform(m).select(*UNIT, out.alias("v"))
    last = {name: F.element_at("v", i - len(tr.NUMERIC) - 1) for i, name in enumerate([*tr.NUMERIC, "holiday_d"])}
    # the one-hot part holds ones and zeros
    hot = F.size(F.array_remove(F.slice("v", F.lit(1), F.size("v") - len(last)), 0.0))
    return v.select(*UNIT, F.size("v").cast("long").alias("width"), hot.cast("long").alias("hot"),
                    *[round_half_up(c, 6).alias(n) for n, c in last.items()])


_TRAIN = f"from matrix where year < {fx.TRAIN_BEFORE}"
_SEEN = " + ".join(f"case when {c} in (select {c} {_TRAIN}) then 1 else 0 end" for c in tr.CATEGORICAL)
_WIDTH = " + ".join(f"(select count(distinct {c}) {_TRAIN})" for c in tr.CATEGORICAL)
_SCALED = ", ".join(f"round(coalesce({c} / nullif((select stddev_samp({c}) {_TRAIN}), 0), 0.0), 6) as {d}" for d, c in tr.NUMERIC.items())
register("features_pipeline", q_features_pipeline, with_matrix(f"""
select contract_id, day, {_WIDTH} + {len(tr.NUMERIC) + 1} as width, cast({_SEEN} as bigint) as hot, {_SCALED},
       cast(holiday as double) as holiday_d from matrix"""))


def _scored_summary(scored: DataFrame) -> DataFrame:
    return evaluate.confusion_matrix(scored, tr.LABEL, "prediction")


def q_logistic_scored(spark, sf):
    """Weighted (balanced class weights) and unweighted logistic regression,
    both fitted on the training years and scored on the test year: features
    are fitted once, training and test vectors stored once."""
    m = tr.model_frame(spark, sf, columns=tr.MODEL_COLUMNS)
    train, test = tr.train_test(m)
    train = balance.class_weights(train, tr.LABEL, "weight")
    features = fit_features(tr.SPEC, train)
    table, held = models.vectors(features, train, [tr.LABEL, "weight"]), models.vectors(features, test, [tr.LABEL])
    out = None
    for name, weight in (("weighted", "weight"), ("unweighted", None)):
        model = models.estimator("logistic", tr.LABEL, weight).fit(table)
        part = _scored_summary(models.score(model, held)).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def q_logistic_tuned(spark, sf):
    m = tr.model_frame(spark, sf, columns=tr.MODEL_COLUMNS)
    train, test = tr.train_test(m)
    train = balance.class_weights(train, tr.LABEL, "weight")
    model = models.tune("logistic", train, tr.SPEC, weight="weight", folds=4, parallelism=4, fold_key=UNIT)
    scored = models.score(model, test)
    a = evaluate.auc(spark, scored, tr.LABEL)
    return _scored_summary(scored).unionByName(
        a.select(F.lit(None).cast("double").alias(tr.LABEL), F.lit(None).cast("double").alias("prediction"),
                 F.lit(None).cast("long").alias("count"), "auc"), allowMissingColumns=True)


def q_forest_scored(spark, sf):
    """Forest on index-coded categories, classes resampled at fixed rates."""
    m = tr.model_frame(spark, sf, columns=tr.MODEL_COLUMNS)
    train, test = tr.train_test(m)
    train = balance.resample(train, tr.LABEL, UNIT, rates={0.0: 0.8, 1.0: 3.2})
    model = models.train("forest", train, tr.FOREST_SPEC)
    return _scored_summary(models.score(model, test))


def q_forest_weighted(spark, sf):
    """Forest on index-coded categories, balanced by class weights."""
    m = tr.model_frame(spark, sf, columns=tr.MODEL_COLUMNS)
    train, test = tr.train_test(m)
    train = balance.class_weights(train, tr.LABEL, "weight")
    model = models.train("forest", train, tr.FOREST_SPEC, weight="weight")
    return _scored_summary(models.score(model, test))


def q_model_roundtrip(spark, sf):
    m, model = _nb_model(spark, sf, False)
    _, test = tr.train_test(m)
    path = scratch_path(spark, "model-nb")
    models.save_model(model, path)
    again = models.load_model(path)
    # the loaded model scores the very rows that carry the first prediction, in the same pass
    scored = models.score(model, test).select(*test.columns, F.col("prediction").alias("p1"))
    both = models.score(again, scored)
    return both.groupBy((F.col("p1") == F.col("prediction")).alias("same")).agg(F.count(F.lit(1)).alias("rows"))


register("model_roundtrip", q_model_roundtrip, with_matrix(f"""
select true as same, count(*) as rows from matrix where year = {fx.TEST_YEAR}"""))

BACKTEST_YEARS = [fx.TEST_YEAR, 2000, 2001]


def q_backtest_years(spark, sf):
    m, model = _nb_model(spark, sf, False)
    return models.backtest(model, m, "year", BACKTEST_YEARS, tr.LABEL)


def _nb_backtest_sql() -> str:
    found = " + ".join(f"coalesce(theta['{c}=' || {c}], 0)" for c in tr.CATEGORICAL)
    scaled = " + ".join(f"coalesce({c} / nullif((select {d} from std), 0), 0) * theta['{d}']" for d, c in tr.NUMERIC.items())
    return with_matrix(_nb_ctes(False) + f"""
, byclass as materialized (
    select label as cl, any_value(log_prior) as prior, map(list(feature), list(log_theta)) as theta from nb group by label)
, held as (select *, row_number() over () as r from matrix where year in ({', '.join(map(str, BACKTEST_YEARS))}))
, lp as (select r, year, absent, cl, prior + {found} + {scaled} + holiday * theta['holiday_d'] as v from held, byclass)
, best as (select r, any_value(year) as year, any_value(absent) as absent, arg_max(cl, v) as prediction from lp group by r)
select year, cast(absent as double) as label, prediction, count(*) as count from best group by all""")


register("backtest_years", q_backtest_years, _nb_backtest_sql())


# A9-A11 -- a table written and read back, in two formats, every row ------------------------------
ROUNDTRIP_SCHEMA = "contract_id long, day date, worker_id long, absent int, absence_class string, year int"


def q_table_roundtrip(spark, sf):
    m = tr.model_frame(spark, sf, columns=[*UNIT, "worker_id", "absence_class"]).select(*UNIT, "worker_id", "absent", "absence_class", "year")
    base = scratch_path(spark, "matrix")
    write_table(m, base + "/parquet", partition_by=["year"])
    write_table(m, base + "/csv", fmt="csv")
    back = read_table(spark, base + "/parquet").withColumn("format", F.lit("parquet"))
    csv_back = read_table(spark, base + "/csv", fmt="csv", schema=ROUNDTRIP_SCHEMA).withColumn("format", F.lit("csv"))
    return back.unionByName(csv_back)


register("table_roundtrip", q_table_roundtrip, with_matrix("""
select contract_id, day, worker_id, absent, absence_class, year, format
from matrix, (select unnest(['parquet', 'csv']) as format) f"""))

# Rows-only: iterative fits
for _name, _fn in [("logistic_scored", q_logistic_scored), ("logistic_tuned", q_logistic_tuned),
                   ("forest_scored", q_forest_scored), ("forest_weighted", q_forest_weighted)]:
    register(_name, _fn)


# Model fits on line items (training.line_frame)
def _line_model(kind: str):
    def q(spark, sf):
        train, test = tr.line_frame(spark, sf)
        model = models.train(kind, train, tr.LINE_SPEC)
        scored = models.score(model, test)
        return evaluate.accuracy(scored, "label", "prediction", by=("year",))
    return q


_LINE_COLS = tr.LINE_SPEC.numeric
LINE_NB_SQL = f"""
with li as (select case when l_quantity > 25 then 1 else 0 end as y, l_quantity, l_extendedprice, l_discount, l_tax,
                   year(l_shipdate) as year from lineitem),
train as (select * from li where year < 1997),
std as (select {', '.join(f'stddev_samp({c}) as {c}' for c in _LINE_COLS)} from train),
sums as (select y, count(*) as n, {', '.join(f'sum({c}) / (select {c} from std) as {c}' for c in _LINE_COLS)} from train group by y),
theta as materialized (
    select y, ln(n + 1.0) - ln((select sum(n) from sums) + (select count(*) from sums) * 1.0) as prior,
           {', '.join(f"ln({c} + 1.0) - ln({' + '.join(_LINE_COLS)} + {len(_LINE_COLS)}.0) as t_{c}" for c in _LINE_COLS)} from sums),
held as (select *, row_number() over () as r from li where year in (1997, 1998)),
lp as (select r, h.y as label, year, t.y as cl,
              prior + {' + '.join(f'h.{c} / (select {c} from std) * t_{c}' for c in _LINE_COLS)} as v from held h, theta t),
best as (select r, any_value(label) as label, any_value(year) as year, arg_max(cl, v) as prediction from lp group by r)
select cast(year as int) as year, count(*) as rows, round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as accuracy
from best group by year"""

register("logistic_lineitem", _line_model("logistic"))
register("naive_bayes_lineitem", _line_model("naive_bayes"), LINE_NB_SQL)
register("forest_lineitem", _line_model("forest"))
