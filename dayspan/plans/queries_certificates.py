"""Named queries that check the iterative fits: optimality of logistic
regressions, forests scored as tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.operators import balance, certificates, evaluate, models
from dayspan.operators.features import fit_features
from dayspan.plans import training as tr
from dayspan.plans.catalog import ORACLE, register
from dayspan.plans.queries_days import key_sql, with_matrix
from dayspan.session import scratch_path
from dayspan.sources import fixtures as fx

UNIT = ["contract_id", "day"]
#: the job's two fits, and one with so light a penalty that many coefficients stay
FITS = {"weighted": ("weight", {}), "unweighted": (None, {"maxIter": 10}),
        "light": ("weight", {"regParam": 0.01, "tol": 1e-10, "maxIter": 1000})}
#: farthest that a gradient may be from where it must be at the optimum
NEAR = 1e-5


# N1, N2 -- the logistic fits are optimal ----------------------------------------------
def _training_rows(spark, sf):
    m = tr.model_frame(spark, sf, columns=tr.MODEL_COLUMNS)
    train, test = tr.train_test(m)
    train = balance.class_weights(train, tr.LABEL, "weight")
    return fit_features(tr.SPEC, train), train, test


def _training_vectors(spark, sf):
    features, train, test = _training_rows(spark, sf)
    return features, models.vectors(features, train, [tr.LABEL, "weight"]), test


def q_logistic_certificate(spark, sf) -> DataFrame:
    """Per fit and feature: its weighted deviation and null gradient (statistics of the data), the l1 weight, and
    whether the fitted gradient is where the optimum has it."""
    features, train, _ = _training_rows(spark, sf)
    names = certificates.feature_names(features, tr.SPEC)
    fits = models.fit_all_logistic(features, train, tr.LABEL, "weight", {name: (bool(weight), params) for name, (weight, params) in FITS.items()})
    out = None
    for name, (weight, _) in FITS.items():
        table, model = fits[name]
        c = certificates.logistic_certificate(table, model, names, tr.LABEL, weight)
        part = c.select(F.lit(name).alias("fit"), "feature", F.round("deviation", 6).alias("deviation"),
                        F.round("null_gradient", 6).alias("null_gradient"), F.round("l1", 6).alias("l1"), (F.col("violation") <= NEAR).alias("optimal"))
        out = part if out is None else out.unionByName(part)
    return out


def _moments(weight: str) -> str:
    """Weighted moments of every feature on the training rows: feature, s1, s2 (sums of w x, w x x), sy (of w y x)."""
    counted = " union all ".join(
        f"select '{c}=' || {c} as feature, sum({weight}) as s1, sum({weight}) as s2, sum({weight} * absent) as sy from tw where {c} is not null group by {c}"
        for c in tr.CATEGORICAL)
    numeric = {d: f"coalesce({c} / nullif((select {d} from std), 0), 0)" for d, c in tr.NUMERIC.items()} | {"holiday_d": "holiday"}
    summed = " union all ".join(f"select '{d}', sum({weight} * {x}), sum({weight} * {x} * {x}), sum({weight} * absent * {x}) from tw"
                                for d, x in numeric.items())
    return f"{counted} union all {summed}"


def _null_sql(weight: str, name: str) -> str:
    """CTEs ``m_name`` (totals) and ``g_name``: feature, deviation and gradient of the loss where all coefficients are 0."""
    return f"""
, m_{name} as (select sum({weight}) as w, sum({weight} * {weight}) as ww, sum({weight} * absent) as wy from tw)
, g_{name} as (
    select feature, sqrt(greatest(s2 - s1 * s1 / w, 0) / (w - ww / w)) as deviation,
           (s1 * (wy / w) - sy) / w / nullif(sqrt(greatest(s2 - s1 * s1 / w, 0) / (w - ww / w)), 0) as gradient
    from ({_moments(weight)}), m_{name})"""


_TRAIN_SQL = f"""
, train as materialized (select * from matrix where year < {fx.TRAIN_BEFORE})
, cw as (select absent, (select count(*) from train) / ((select count(distinct absent) from train) * count(*)) as w from train group by absent)
, tw as materialized (select * from train join cw using (absent))
, std as (select {', '.join(f'stddev_samp({c}) as {d}' for d, c in tr.NUMERIC.items())} from train)"""


def _certificate_sql() -> str:
    parts, ctes = [], _TRAIN_SQL
    for name, (weight, params) in FITS.items():
        ctes += _null_sql("w" if weight else "1.0", name)
        l1 = round(params.get("regParam", 0.3) * 0.8, 6)
        parts.append(f"select '{name}' as fit, feature, round(deviation, 6) as deviation, round(coalesce(gradient, 0), 6) as null_gradient, {l1}::double as l1, true as optimal from g_{name}")
        parts.append(f"select '{name}', '{certificates.INTERCEPT}', null, 0.0, {l1}::double, true")
    return with_matrix(ctes + " " + " union all ".join(parts))


register("logistic_certificate", q_logistic_certificate, _certificate_sql())


# N2 -- the unweighted fit with its own iteration limit, scored ---------------------------
def q_logistic_unweighted(spark, sf) -> DataFrame:
    features, table, test = _training_vectors(spark, sf)
    model = models.estimator("logistic", tr.LABEL, maxIter=10).fit(table)
    return evaluate.confusion_matrix(models.score(model, features.transform(test)), tr.LABEL, "prediction")


# The condition of the optimum decides it: while no null gradient exceeds the l1 weight, every coefficient is 0
# and the intercept is the log odds. (A null prediction, and so a failing row, where it does not hold.)
register("logistic_unweighted", q_logistic_unweighted, with_matrix(_TRAIN_SQL + _null_sql("1.0", "u") + f"""
select cast(absent as double) as label,
       case when (select max(abs(gradient)) from g_u) <= 0.24 then case when (select wy / w from m_u) > 0.5 then 1.0 else 0.0 end end::double as prediction,
       count(*) as count
from matrix where year = {fx.TEST_YEAR} group by absent"""))


# The line-item fit, whose optimum is found again by proximal gradient steps on centred, scaled features.
_Z = [f"z{i}" for i in range(len(tr.LINE_SPEC.numeric))]
_AGG = ", ".join(f"avg((1 / (1 + exp(-(b + {' + '.join(f'{z} * b{z}' for z in _Z)}))) - y) * {z}) as g{z}" for z in _Z)
_STEPS = ", ".join(f"sign(b{z} - 0.8 * (g{z} + 0.06 * b{z})) * greatest(abs(b{z} - 0.8 * (g{z} + 0.06 * b{z})) - 0.8 * 0.24, 0) as b{z}" for z in _Z)
_SCALED = ", ".join(f"({c} - a.m{i}) / a.s{i} as z{i}" for i, c in enumerate(tr.LINE_SPEC.numeric))
_MEANS = ", ".join(f"avg({c}) as m{i}, stddev_samp({c}) as s{i}" for i, c in enumerate(tr.LINE_SPEC.numeric))
ORACLE["logistic_lineitem"] = f"""
with recursive li as (
    select case when l_quantity > 25 then 1.0 else 0.0 end as y, {', '.join(tr.LINE_SPEC.numeric)}, year(l_shipdate) as year from lineitem),
a as (select {_MEANS} from li where year < 1997),
x as materialized (select y, {_SCALED} from li, a where year < 1997),
fit as (
    select 0 as k, 0.0::double as b, {', '.join(f'0.0::double as b{z}' for z in _Z)}
    union all
    select k + 1, b - 2 * g, {_STEPS}
    from (select k, any_value(b) as b, {', '.join(f'any_value(b{z}) as b{z}' for z in _Z)},
                 avg(1 / (1 + exp(-(b + {' + '.join(f'{z} * b{z}' for z in _Z)}))) - y) as g, {_AGG}
          from fit, x where k < 80 group by k)),
held as (select y, year, {_SCALED} from li, a where year in (1997, 1998)),
best as (select * from fit where k = 80)
select cast(year as int) as year, count(*) as rows,
       round(avg(case when (b + {' + '.join(f'{z} * b{z}' for z in _Z)} > 0) = (y > 0.5) then 1.0 else 0.0 end), 6) as accuracy
from held, best group by year
"""


# N3 -- folds of the grid search, from the rows' keys -----------------------------------------
FOLDS = 4


def q_tuning_folds(spark, sf) -> DataFrame:
    """Per fold: rows and positives, and whether Spark's own AUC agrees with the rank sums of the fold's model."""
    m = tr.model_frame(spark, sf, columns=tr.MODEL_COLUMNS)
    train, _ = tr.train_test(m)
    features = fit_features(tr.SPEC, train)
    table = models.vectors(features, train.withColumn("fold", models.fold_of(UNIT, FOLDS)), [tr.LABEL, "fold"])
    cv = models.cross_validate("logistic", table, tr.LABEL, FOLDS, {"regParam": [0.3, 0.001]}, fold_col="fold", keep_models=True)
    got = models.fold_metrics(cv, table, tr.LABEL, "fold")
    mean = got.agg(F.avg("auc")).scalar()  # Spark reports the mean over the folds
    agrees = F.abs(mean - F.lit(max(cv.avgMetrics))) < 1e-3
    return got.select("fold", "rows", "positives", agrees.alias("auc_agrees"), (F.col("auc") > 0.5).alias("better_than_chance"))


_FOLD_SQL = f"floor({FOLDS} * cast(('0x' || substr(md5({key_sql('contract_id', 'day')} || 'fold'), 1, 8)) as bigint) / 4294967296.0)"
register("tuning_folds", q_tuning_folds, with_matrix(f"""
select cast({_FOLD_SQL} as int) as fold, count(*) as rows, count(*) filter (where absent = 1) as positives,
       true as auc_agrees, true as better_than_chance
from matrix where year < {fx.TRAIN_BEFORE} group by 1"""))


# N6, N7 -- the forests as node tables, scored by joins --------------------------------------
def _forest_nodes(weighted: bool):
    def q(spark, sf) -> DataFrame:
        """Test rows by whether the node table and the model agree on the prediction and on the shares."""
        m = tr.model_frame(spark, sf, columns=tr.MODEL_COLUMNS)
        train, test = tr.train_test(m)
        train = (balance.class_weights(train, tr.LABEL, "weight") if weighted
                 else balance.resample(train, tr.LABEL, UNIT, rates={0.0: 0.8, 1.0: 3.2}))
        model = models.train("forest", train, tr.FOREST_SPEC, weight="weight" if weighted else None)
        forest, path = model.stages[-1], scratch_path(spark, "forest")
        nodes = certificates.forest_nodes(spark, forest, path)
        held = models.vectors(model.stages[0], test, UNIT)
        mine = certificates.score_by_nodes(held, UNIT, nodes, forest.getNumTrees, forest.getMaxDepth(), forest.totalNumNodes)
        theirs = forest.transform(held).select(*UNIT, F.col("prediction").alias("p"), vector_to_array("probability").alias("s"))
        both = mine.join(theirs, UNIT)
        near = F.array_max(F.zip_with("shares", "s", lambda a, b: F.abs(a - b))) < 1e-9
        return both.groupBy((F.col("prediction") == F.col("p")).alias("same"), near.alias("same_shares")).agg(F.count(F.lit(1)).alias("rows"))
    return q


_ALL_TEST_ROWS = with_matrix(f"""
select true as same, true as same_shares, count(*) as rows from matrix where year = {fx.TEST_YEAR}""")
register("forest_nodes", _forest_nodes(False), _ALL_TEST_ROWS)
register("forest_weighted_nodes", _forest_nodes(True), _ALL_TEST_ROWS)
