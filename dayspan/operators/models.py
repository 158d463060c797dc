"""Classifiers on Spark ML: train, tune, score, persist, back-test."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.functions.columns import hash_unit
from dayspan.operators.certificates import forest_nodes
from dayspan.operators.evaluate import confusion_matrix
from dayspan.operators.features import FeatureSpec, Place, fit_features, places
from dayspan.operators.forest import fit_forest, fit_forest_on, votes
from dayspan.operators.logistic import Rows, areas, columns_of, fit_many
from dayspan.session import scratch_path
from dayspan.sources.tables import materialize

KINDS = ("logistic", "naive_bayes", "forest")
# Fixed values of the job: regularisation 0.3 / 0.8, 200 trees, 90 bins.


def estimator(kind: str, label: str, weight: str | None = None, features: str = "features", **params):
    """The classifier of ``kind`` with the job's defaults, overridable."""
    common = {"labelCol": label, "featuresCol": features}
    if weight:
        common["weightCol"] = weight
    if kind == "logistic":
        return LogisticRegression(**{**common, "regParam": 0.3, "elasticNetParam": 0.8, **params})
    if kind == "naive_bayes":
        return NaiveBayes(**{**common, "smoothing": 1.0, "modelType": "multinomial", **params})
    if kind == "forest":
        return RandomForestClassifier(**{**common, "numTrees": 200, "seed": 0, "maxBins": 90, **params})
    raise ValueError(f"kind must be one of {KINDS}")


def check_cardinality(features: PipelineModel, spec: FeatureSpec, max_bins: int) -> None:
    """Trees on index-coded columns need every categorical column to have at
    most ``max_bins`` values; the sizes are those of the fitted indexer. One-hot
    columns have two values each and need no check."""
    if not spec.categorical or spec.one_hot:
        return
    sizes = {c: len(v) for c, v in zip(spec.categorical, features.stages[0].labelsArray, strict=True)}
    bad = {c: n for c, n in sizes.items() if n + 1 > max_bins}
    if bad:
        raise ValueError(f"categorical columns exceed maxBins={max_bins}: {bad}")


def vectors(features: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The feature vector and the kept columns as a stage table, which the
    iterative fits read instead of a cached copy."""
    return materialize(features.transform(df).select(*keep, "features"), "vectors")


def fit_on(kind: str, table: DataFrame, features: PipelineModel, spec: FeatureSpec, weight: str | None = None,
           **params) -> PipelineModel:
    """Fit a classifier on stored vectors; the model starts from the fitted features."""
    est = estimator(kind, spec.label, weight, **params)
    if kind == "forest":
        check_cardinality(features, spec, est.getMaxBins())
        model = fit_forest(table, est)
        if model is not None:
            return PipelineModel(stages=[features, model])
        table = spread_for_forest(table, est.getNumTrees())
    return PipelineModel(stages=[features, est.fit(table)])


#: bytes of training rows that a task of a forest fit holds, about
FOREST_TASK_BYTES = 400_000_000


def spread_for_forest(table: DataFrame, trees: int) -> DataFrame:
    """``table`` in enough partitions for a forest. The fit keeps each row with a number per tree, many times
    the row's size in the file, so a partition that is one split of the stored vectors would grow far too large."""
    parts = -(-table.count() * (4 * trees + 200) // FOREST_TASK_BYTES)
    return table.repartition(parts) if parts > table.rdd.getNumPartitions() else table


def train(kind: str, train_df: DataFrame, spec: FeatureSpec, weight: str | None = None,
          **params) -> PipelineModel:
    """Fit features and classifier on the training rows only: the features
    once, then the classifier on their stored vectors."""
    features = fit_features(spec, train_df)
    if kind == "forest" and (known := places(features, train_df)):
        est = estimator(kind, spec.label, weight, **params)
        check_cardinality(features, spec, est.getMaxBins())
        model = fit_forest_on(train_df, known, est)
        if model is not None:
            return PipelineModel(stages=[features, model])
    table = vectors(features, train_df, [spec.label, *([weight] if weight else [])])
    return fit_on(kind, table, features, spec, weight, **params)


def fit_all_logistic(features: PipelineModel, train_df: DataFrame, label: str, weight: str,
                     fits: dict[str, tuple[bool, dict]]) -> dict[str, tuple[DataFrame | Rows, LogisticRegressionModel]]:
    """Logistic regressions on the same rows, each with the rows it was fitted on. ``fits``: by name, whether ``weight`` counts, and
    the settings. The rows are stored once, and fits of the same weights share their passes."""
    ests = {name: estimator("logistic", label, weight if weighted else None, **params) for name, (weighted, params) in fits.items()}
    out: dict = {}
    if known := places(features, train_df):
        own = columns_of(train_df, known, label, weight)
        for weighted, rows in ((True, own), (False, own.unweighted())):
            names = [name for name, (w, _) in fits.items() if w == weighted]
            found = fit_many(rows, [(ests[name], None) for name in names]) if names else []
            if found is None:
                break
            out |= {name: (rows, model) for name, model in zip(names, found, strict=True)}
    if len(out) < len(fits):
        table = vectors(features, train_df, [label, weight])
        out = {name: (table, est.fit(table)) for name, est in ests.items()}
    return out


def fold_of(key: Sequence[str], folds: int, salt: str = "fold") -> Column:
    """The fold (0 .. folds - 1) of a row from the md5 of its key: the same for any
    file layout, partitioning or rerun. Rows that repeat a key share a fold."""
    return F.floor(hash_unit(key, salt) * folds).cast("int")


def cross_validate(kind: str, table: DataFrame, label: str, folds: int, grid: dict | None = None, weight: str | None = None,
                   fold_col: str | None = None, parallelism: int = 4, seed: int = 0, keep_models: bool = False) -> CrossValidatorModel:
    """Grid search by AUC on stored vectors. With ``fold_col`` (see ``fold_of``) the folds are
    the rows' own; without it Spark draws them from the rows' order. ``keep_models``: also the model of every fold and setting."""
    est = estimator(kind, label, weight)
    settings = _grid(kind, grid, est)
    if kind == "logistic" and fold_col:
        cv = _search_together(est, settings, table, folds, fold_col, keep_models)
        if cv is not None:
            return cv
    cv = CrossValidator(estimator=est, estimatorParamMaps=settings, evaluator=BinaryClassificationEvaluator(labelCol=label),
                        numFolds=folds, parallelism=parallelism, seed=seed, collectSubModels=keep_models)
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    return cv.fit(table)


def _grid(kind: str, grid: dict | None, est) -> list[dict]:
    if grid is None:
        grid = {"elasticNetParam": [0.4, 0.6, 0.8], "regParam": [0.3, 0.1, 0.01]} if kind == "logistic" else {}
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    return builder.build()


def _search_together(est, grid: list[dict], table: DataFrame | Rows, folds: int, fold_col: str, keep_models: bool = False) -> CrossValidatorModel | None:
    """The grid search with all folds and settings fitted in the same passes and judged in one more, and no fold cached."""
    settings = [est.copy(g) for g in grid]
    rows = table if isinstance(table, Rows) else Rows.of_vectors(table, est, fold_col)
    every = fit_many(rows, [(e, f) for f in range(folds) for e in settings], fold_col) if rows is not None else None
    if every is None:
        return None
    per_fold = [every[f * len(grid): (f + 1) * len(grid)] for f in range(folds)]
    found = areas(rows, [(m, f) for f in range(folds) for m in per_fold[f]], est, fold_col)
    if found is None:
        return None
    per_setting = np.array(found).reshape(folds, -1)
    mean = per_setting.mean(0)
    best = fit_many(rows, [(settings[int(mean.argmax())], None)])[0]
    return CrossValidatorModel(best, mean.tolist(), per_fold if keep_models else None, per_setting.std(0).tolist())


def tune(kind: str, train_df: DataFrame, spec: FeatureSpec, weight: str | None = None,
         grid: dict | None = None, folds: int = 4, parallelism: int = 4, seed: int = 0, fold_key: Sequence[str] | None = None) -> PipelineModel:
    """Cross-validated grid search (AUC) on the estimator being tuned; the
    features are fitted once and their stored vectors shared by all folds. ``fold_key``: columns whose
    hash gives the fold of a row."""
    features = fit_features(spec, train_df)
    if fold_key:
        train_df = train_df.withColumn("__fold", fold_of(fold_key, folds))
        if kind == "logistic" and (known := places(features, train_df)):
            rows = columns_of(train_df, known, spec.label, weight, F.col("__fold"))
            est = estimator(kind, spec.label, weight)
            cv = _search_together(est, _grid(kind, grid, est), rows, folds, "__fold")
            if cv is not None:
                return PipelineModel(stages=[features, cv.bestModel])
    table = vectors(features, train_df, [spec.label, *([weight] if weight else []), *(["__fold"] if fold_key else [])])
    cv = cross_validate(kind, table, spec.label, folds, grid, weight, "__fold" if fold_key else None, parallelism, seed)
    return PipelineModel(stages=[features, cv.bestModel])


def fold_metrics(cv: CrossValidatorModel, table: DataFrame, label: str, fold_col: str) -> DataFrame:
    """Per fold: rows, positives and the AUC on the fold's rows of the best setting's model that was fitted without them
    (areas of the rank sums, ties counted half). ``cv`` must keep its models."""
    best = max(range(len(cv.avgMetrics)), key=lambda i: cv.avgMetrics[i])
    out = None
    for fold, per_setting in enumerate(cv.subModels):
        held = table.where(F.col(fold_col) == fold)
        scored = per_setting[best].transform(held).select(F.col(label).alias("label"), vector_to_array("probability")[1].alias("score"))
        # ranks from counts per score, so that no window holds rows
        per = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
        per = per.withColumn("fold", F.lit(fold))
        out = per if out is None else out.unionByName(per)
    return _areas(materialize(out, "fold-scores"))


def _areas(per: DataFrame) -> DataFrame:
    """(fold, rows, positives, auc) from (fold, score, pos, neg). Scores are cut into
    256 ranges at sampled quantiles; ranks are summed over the ranges first, then inside each."""
    cuts = per.groupBy("fold").agg(F.percentile_approx("score", [i / 256 for i in range(1, 256)], 10_000).alias("cuts")).withColumnRenamed("fold", "f")
    per = per.join(F.broadcast(cuts), F.col("fold") == F.col("f"))  # a row for each fold
    per = per.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts", "f")
    ranges = per.groupBy("fold", "range").agg(F.sum("neg").alias("neg_in"))
    before = Window.partitionBy("fold").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("fold").alias("f"), F.col("range").alias("r"), F.coalesce(F.sum("neg_in").over(before), F.lit(0)).alias("neg_below"))
    inner = Window.partitionBy("fold", "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("neg_inside", F.coalesce(F.sum("neg").over(inner), F.lit(0)))
    per = per.join(F.broadcast(ranges), (F.col("fold") == F.col("f")) & (F.col("range") == F.col("r")))  # 256 rows a fold
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg_inside") + F.col("neg") / 2))
    return per.groupBy("fold").agg(F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.sum("pos").alias("positives"),
                                   F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def score(model, df: DataFrame) -> DataFrame:
    """The model's columns beside those of ``df``. On features known to ``places`` a forest takes its votes from its node table and a
    logistic regression of two classes sums its terms, which gives what their own ``transform`` does without a vector a row."""
    last = model.stages[-1] if isinstance(model, PipelineModel) and len(model.stages) > 1 else None
    if isinstance(last, (RandomForestClassificationModel, LogisticRegressionModel)) and not last.isDefined("thresholds"):
        features = PipelineModel(stages=model.stages[:-1])
        known = places(features, df)
        scored = (_score_forest if isinstance(last, RandomForestClassificationModel) else _score_logistic)(last, features, known, df) if known else None
        if scored is not None:
            return scored
    return model.transform(df)


def _score_forest(forest: RandomForestClassificationModel, features: PipelineModel, known: Sequence[Place], df: DataFrame) -> DataFrame | None:
    spark = df.sparkSession
    if any(p.hot for p in known) or (vote := votes(spark, forest_nodes(spark, forest, scratch_path(spark, "forest")).collect())) is None:
        return None
    raw = [F.get("__votes", F.lit(c)) for c in range(forest.numClasses)]
    # columns that nobody asks for, the vectors among them, are not computed
    voted = features.transform(df).withColumn("__votes", vote(F.array(*[p.column.cast("double") for p in known])))
    return voted.withColumns({
        forest.getRawPredictionCol(): array_to_vector("__votes"),
        forest.getProbabilityCol(): array_to_vector(F.array(*[c / sum(raw[1:], raw[0]) for c in raw])),
        forest.getPredictionCol(): (F.array_position("__votes", F.array_max("__votes")) - 1).cast("double")}).drop("__votes")


def _score_logistic(model: LogisticRegressionModel, features: PipelineModel, known: Sequence[Place], df: DataFrame) -> DataFrame | None:
    if model.numClasses != 2:
        return None
    margin, left = F.lit(0.0), model.coefficients.toArray().tolist()
    for p in known:
        width = p.categories if p.hot else 1
        own, left = left[:width], left[width:]
        if p.hot:
            margin = margin + F.coalesce(F.get(F.array(*[F.lit(v) for v in own]), p.column), F.lit(0.0))
        else:
            margin = margin + p.column.cast("double") * F.lit(own[0])
    scored = features.transform(df).withColumn("__margin", margin + F.lit(model.intercept))
    share = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__margin")))
    t = model.getThreshold()
    cut = -np.inf if t == 0 else np.inf if t == 1 else np.log(t / (1 - t))
    return scored.withColumns({
        model.getRawPredictionCol(): array_to_vector(F.array(-F.col("__margin"), F.col("__margin"))),
        model.getProbabilityCol(): array_to_vector(F.array(F.lit(1.0) - share, share)),
        model.getPredictionCol(): F.when(~F.isnan("__margin") & (F.col("__margin") > float(cut)), 1.0).otherwise(0.0)}).drop("__margin")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def backtest(model, df: DataFrame, year_col: str, years: Sequence[int], label: str,
             prediction: str = "prediction") -> DataFrame:
    """Score several held-out years in one pass; confusion per year."""
    test = df.where(F.col(year_col).isin(*[int(y) for y in years]))
    return confusion_matrix(score(model, test), label, prediction, by=(year_col,))
