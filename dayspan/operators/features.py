"""Feature preparation on Spark ML: specs, temporal split, fitted pipelines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StandardScaler, StandardScalerModel, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType, StringType


def temporal_split(df: DataFrame, year_col: str, train_before: int,
                   test_years: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Train = years before ``train_before``; test = the listed years.

    On a table partitioned by year both sides are pruned scans.
    """
    y = F.col(year_col).cast("int")
    return df.where(y < train_before), df.where(y.isin(*[int(t) for t in test_years]))


def split_label(df: DataFrame, year_col: str, train_before: int, test_years: Sequence[int],
                out: str = "part") -> DataFrame:
    """The same split as a column ('train' / 'test'); other years dropped."""
    y = F.col(year_col).cast("int")
    part = F.when(y < train_before, F.lit("train")).when(y.isin(*[int(t) for t in test_years]), F.lit("test"))
    return df.withColumn(out, part).where(F.col(out).isNotNull())


@dataclass
class FeatureSpec:
    """Which columns feed a model.

    ``categorical`` are indexed (and one-hot encoded when ``one_hot``),
    ``numeric`` are assembled and scaled to unit sample deviation,
    ``passthrough`` numerics are appended unscaled. ``forbidden`` names
    columns that must never be features (label-derived or leaking ones).
    """

    label: str
    categorical: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    passthrough: list[str] = field(default_factory=list)
    forbidden: list[str] = field(default_factory=list)
    one_hot: bool = True

    def check(self) -> None:
        used = set(self.categorical) | set(self.numeric) | set(self.passthrough)
        bad = used & (set(self.forbidden) | {self.label})
        if bad:
            raise ValueError(f"forbidden feature columns: {sorted(bad)}")


def infer_features(df: DataFrame, label: str, exclude: Sequence[str] = (),
                   forbidden: Sequence[str] = ()) -> FeatureSpec:
    """Spec from the schema: text columns categorical, float/double numeric;
    integer columns are ids or flags and are left out unless listed."""
    skip = set(exclude) | set(forbidden) | {label}
    cat, num = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, StringType):
            cat.append(f.name)
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            num.append(f.name)
    return FeatureSpec(label=label, categorical=cat, numeric=num, forbidden=list(forbidden))


def build_features(spec: FeatureSpec, output: str = "features", handle_invalid: str = "keep") -> Pipeline:
    """Index -> (one-hot) -> assemble numerics -> scale -> final assembly.

    Fit it on the training rows only: indexes and scale then carry no
    information from the test years; unseen categories get the extra index
    (``handle_invalid='keep'``).
    """
    spec.check()
    stages = []
    cat_out = []
    if spec.categorical:
        idx = [f"{c}__idx" for c in spec.categorical]
        stages.append(StringIndexer(inputCols=spec.categorical, outputCols=idx, handleInvalid=handle_invalid,
                                    stringOrderType="frequencyDesc"))
        if spec.one_hot:
            ohe = [f"{c}__ohe" for c in spec.categorical]
            # the indexer's extra "unseen" index is the last level: dropLast
            # turns unseen values into the all-zero vector
            stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="error"))
            cat_out = ohe
        else:
            cat_out = idx
    num_out = []
    if spec.numeric:
        stages.append(VectorAssembler(inputCols=spec.numeric, outputCol="__num", handleInvalid=handle_invalid))
        stages.append(StandardScaler(inputCol="__num", outputCol="__num_scaled", withMean=False, withStd=True))
        num_out = ["__num_scaled"]
    stages.append(VectorAssembler(inputCols=cat_out + num_out + list(spec.passthrough), outputCol=output,
                                  handleInvalid=handle_invalid))
    return Pipeline(stages=stages)


def fit_features(spec: FeatureSpec, train: DataFrame, output: str = "features") -> PipelineModel:
    return build_features(spec, output).fit(train)


class Place(NamedTuple):
    """Where a vector's values come from: a column, its categories (0: it holds numbers), and whether the category's
    index is spread over as many places, with a one at its own (none for an index beyond them)."""

    column: Column
    categories: int = 0
    hot: bool = False


def places(features: PipelineModel, df: DataFrame) -> list[Place] | None:
    """The values that the fitted features put into a row's vector, in order: plain expressions on ``df``, cheaper than the
    stages' functions and vectors. None where a stage is not one of those known here."""
    known: dict[str, list[Place]] = {}
    out, stages = None, list(features.stages)
    while stages:
        stage = stages.pop(0)
        if isinstance(stage, PipelineModel):
            stages = [*stage.stages, *stages]
        elif isinstance(stage, StringIndexerModel) and stage.getHandleInvalid() == "keep" and stage.isSet("inputCols"):
            for c, index, labels in zip(stage.getInputCols(), stage.getOutputCols(), stage.labelsArray, strict=True):
                if not isinstance(df.schema[c].dataType, StringType) or not labels:
                    return None
                at = F.create_map(*[F.lit(v) for i, label in enumerate(labels) for v in (label, i)])
                known[index] = [Place(F.coalesce(F.try_element_at(at, F.col(c)), F.lit(len(labels))), len(labels) + 1)]
        elif isinstance(stage, OneHotEncoderModel) and stage.getDropLast() and stage.isSet("inputCols"):
            for c, vector, size in zip(stage.getInputCols(), stage.getOutputCols(), stage.categorySizes, strict=True):
                if c not in known or known[c][0].categories != size:
                    return None
                known[vector] = [Place(known[c][0].column, size - 1, True)]
        elif isinstance(stage, VectorAssembler) and stage.getHandleInvalid() == "keep":
            out = []
            for c in stage.getInputCols():
                if c not in known:
                    if not isinstance(df.schema[c].dataType, (NumericType, BooleanType)):
                        return None
                    known[c] = [Place(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))]
                out += known[c]
            known[stage.getOutputCol()] = out
        elif isinstance(stage, StandardScalerModel) and stage.getWithStd() and not stage.getWithMean() and stage.getInputCol() in known:
            scale = [1.0 / d if d else 0.0 for d in stage.std.toArray().tolist()]
            known[stage.getOutputCol()] = [Place(p.column * F.lit(k)) for p, k in zip(known[stage.getInputCol()], scale, strict=True)]
        else:
            return None
    return out
