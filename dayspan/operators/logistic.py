"""Penalised logistic regression by proximal Newton steps: a few passes over the stored vectors, nothing cached.

A grid search with Spark's own fits caches the rows of a fold and keeps them in memory once more per concurrent
fit. Here a pass over stored vectors, or over the columns they are made of, sums loss, gradient and second derivatives of one or many models, and
the penalised quadratic problem in the coefficients is solved between passes. The objective is that of
``LogisticRegression`` (two classes, intercept, standardised features, l1 and l2 penalty); the result is Spark's model.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.operators.features import Place
from dayspan.operators.forest import reading
from dayspan.sources.tables import materialize

# tasks get this module's functions with their job, so the core needs nothing installed on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rows whose products are formed at once, and bins of scores from which areas under the curve are found
CHUNK, BINS = 2048, 1 << 13
#: farthest that a gradient may be from where the optimum has it, in units of the features' deviations, at most
NEAR = 1e-7
SWEEPS = 20_000


def supported(est: LogisticRegression) -> bool:
    """Whether the settings are those this module knows (others are left to Spark's own fit)."""
    plain = all(est.getOrDefault(k) == v for k, v in {"fitIntercept": True, "standardization": True}.items())
    bounded = any(est.isSet(k) for k in ("lowerBoundsOnCoefficients", "upperBoundsOnCoefficients", "lowerBoundsOnIntercepts", "upperBoundsOnIntercepts"))
    return plain and not bounded and est.getFamily() in ("auto", "binomial") and est.getRegParam() > 0 and est.getMaxIter() > 0


def dense(vectors: pa.StructArray, width: int) -> np.ndarray:
    """Stored vectors, sparse or dense, as rows of an array, after a first column of ones."""
    kinds, values = vectors.field("type").to_numpy(zero_copy_only=False), vectors.field("values")
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    sparse = np.repeat(kinds == 0, sizes)
    at = np.empty(len(sparse), np.int64)
    at[sparse] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
    at[~sparse] = np.tile(np.arange(width), int((kinds == 1).sum()))
    x = np.zeros((len(kinds), width + 1))
    x[:, 0] = 1
    x[np.repeat(np.arange(len(kinds)), sizes), at + 1] = values.flatten().to_numpy(zero_copy_only=False)
    if not np.isfinite(x).all():
        raise ValueError("feature vectors must not hold NaN or infinite values")
    return x


#: rows of a stored block of columns (their places among its values are 16 bits)
BLOCK = 1 << 14


def packed(rows: DataFrame) -> DataFrame:
    """Columns of numbers as blocks: per column its distinct values in the block, and for each row the place of its value among these."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                found = [np.unique(c.to_numpy(zero_copy_only=False), return_inverse=True) for c in part.columns]
                yield pa.record_batch({"n": pa.array([part.num_rows], pa.int32()),
                                       "places": pa.array([b"".join(at.astype(np.uint16).tobytes() for _, at in found)], pa.binary()),
                                       "sizes": pa.array([np.array([len(v) for v, _ in found], np.int32).tobytes()], pa.binary()),
                                       "distinct": pa.array([b"".join(v.astype(np.float64).tobytes() for v, _ in found)], pa.binary())})

    return materialize(rows.mapInArrow(run, "n int, places binary, sizes binary, distinct binary"), "columns")


def unpacked(batch: pa.RecordBatch, layout: Sequence[tuple[int, bool]], width: int, unweighted: bool = False) -> Iterator[tuple]:
    """x (as ``dense`` gives it), y, w and fold of each block. ``layout``: per column of x its categories (0: a number), and
    whether the index stands for as many places, with a one at its own (none for an index beyond them)."""
    for n, at, sizes, distinct in zip(*(batch.column(k).to_pylist() for k in ("n", "places", "sizes", "distinct")), strict=True):
        places = np.frombuffer(at, np.uint16).reshape(-1, n)
        values = np.split(np.frombuffer(distinct, np.float64), np.frombuffer(sizes, np.int32).cumsum()[:-1])
        x = np.zeros((n, width + 1))
        x[:, 0], start, column = 1, np.arange(n) * (width + 1), 1
        for (categories, hot), v, place in zip(layout, values[:-3], places[:-3], strict=True):
            if hot:  # an index beyond the categories sets the first column again
                x.ravel()[start + np.where(v < categories, v + column, 0).astype(np.int64).take(place)] = 1
                column += categories
            else:
                if not np.isfinite(v).all():
                    raise ValueError("feature vectors must not hold NaN or infinite values")
                x[:, column] = v.take(place)
                column += 1
        y, w, fold = (v.take(place) for v, place in zip(values[-3:], places[-3:], strict=True))
        yield x, y, np.ones(n) if unweighted else w, fold


def columns_of(df: DataFrame, known: Sequence[Place], label: str, weight: str | None, fold: Column | None = None) -> Rows:
    """``Rows`` stored as the columns that the vectors of ``df`` would be made of."""
    layout = [(p.categories, p.hot) for p in known]
    width = sum(k if hot else 1 for k, hot in layout)
    rows = df.select(*[p.column.cast("int" if p.categories else "double").alias(f"x{j}") for j, p in enumerate(known)], F.col(label).cast("double").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.lit(0) if fold is None else fold.cast("int")).alias("fold"))
    return Rows(packed(rows), width, fold is not None, layout)


class Rows:
    """Training rows and the width of their vectors: x, y, w and fold, or blocks of columns (with their ``layout``); ``apart``: with folds."""

    def __init__(self, rows: DataFrame, width: int, apart: bool, layout: Sequence[tuple[int, bool]] | None = None, unweighted: bool = False):
        self.rows, self.width, self.apart, self.layout, self.plain, self._moments = rows, width, apart, layout, unweighted, None

    @staticmethod
    def of_vectors(table: DataFrame, est: LogisticRegression, fold_col: str | None) -> Rows | None:
        weight = _weight(est)
        rows = table.select(F.col(est.getFeaturesCol()).alias("x"), F.col(est.getLabelCol()).cast("double").alias("y"),
                            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
                            (F.col(fold_col).cast("int") if fold_col else F.lit(0)).alias("fold"))
        first = rows.first()
        return None if first is None else Rows(rows, first["x"].size, bool(fold_col))

    def unweighted(self) -> Rows:
        """The same rows, all of weight 1."""
        return Rows(self.rows if self.layout else self.rows.withColumn("w", F.lit(1.0)), self.width, self.apart, self.layout, True)

    def parts(self) -> Callable:
        """What makes x, y, w and fold of a batch."""
        width, layout, plain = self.width, self.layout, self.plain
        if layout:
            return lambda batch: unpacked(batch, layout, width, plain)
        return lambda batch: [(dense(batch.column("x"), width), *(batch.column(k).to_numpy(zero_copy_only=False) for k in ("y", "w", "fold")))]

    def moments(self) -> dict[int, np.ndarray]:
        """Per fold: labels and weights that are not of this module, sum of w w, and the sums of w, w x, of w x x and of w y, w y x."""
        if self._moments is None:
            def sums(x, y, w, fold):
                bad = np.count_nonzero(~((y == 0) | (y == 1)) | ~(w >= 0))
                for f in np.unique(fold):
                    b = w * (fold == f)
                    s2 = np.zeros(x.shape[1])
                    for a in range(0, len(y), CHUNK):
                        s2 += (x[a: a + CHUNK] ** 2).T @ b[a: a + CHUNK]
                    yield int(f), np.concatenate([[bad, (b * b).sum()], x.T @ b, s2, x.T @ (b * y)])

            self._moments = _summed(self.rows, self.parts(), sums, 1 << 30)
        return self._moments


def _weight(est: LogisticRegression) -> str | None:
    return est.getWeightCol() if est.isDefined("weightCol") and est.getWeightCol() else None


def _summed(rows: DataFrame, parts: Callable, of: Callable, keys: int) -> dict[int, np.ndarray]:
    """Per key the sum over all rows of the vector that ``of(x, y, w, fold)`` yields with it, for each of the ``parts`` of a batch."""

    def run(batches):
        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in parts(batch):
                for key, v in of(*part):
                    if key in sums:
                        sums[key] += v
                    else:
                        sums[key] = v
        for key, v in sums.items():
            yield pa.record_batch({"key": pa.array([key], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in part.column("v"))
        return pa.table({"key": part.column("key").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    total = rows.mapInArrow(run, "key int, v binary").groupBy("key").applyInArrow(add, "key int, v binary")
    if "places" in rows.columns:
        with reading(rows.sparkSession):
            out = total.collect()  # a row a key
    else:
        out = total.collect()
    return {r.key: np.frombuffer(r.v, np.float64) for r in out if r.key < keys}


def summed(rows: Rows, of: Callable, keys: int) -> dict[int, np.ndarray]:
    """The sums of a function's vectors over all ``rows``, by key (see ``_summed``)."""
    return _summed(rows.rows, rows.parts(), of, keys)


@dataclass
class _Fit:
    """A model under way: its penalties and training rows' moments, coefficients in units of the features' deviations, centred."""

    fold: int
    l1: float
    l2: float
    near: float
    steps: int
    mass: float
    mean: np.ndarray
    std: np.ndarray
    theta: np.ndarray
    done: bool = False
    best: tuple | None = None  # coefficients, objective, step that led on from there

    def raw(self) -> np.ndarray:
        """Intercept and coefficients of the features as they are."""
        b = np.divide(self.theta[1:], self.std, out=np.zeros_like(self.std), where=self.std > 0)
        return np.append(self.theta[0] - b @ self.mean, b)

    def unit(self) -> np.ndarray:
        """Matrix that takes sums over (1, x) to sums over (1, centred and scaled x)."""
        scale = np.divide(1.0, self.std, out=np.zeros_like(self.std), where=self.std > 0)
        m = np.diag(np.append(1.0, scale))
        m[1:, 0] = -self.mean * scale
        return m

    def penalty(self, theta: np.ndarray) -> float:
        return self.l1 * np.abs(theta[1:]).sum() + self.l2 / 2 * (theta[1:] ** 2).sum()

    def violation(self, g: np.ndarray) -> float:
        """The farthest a gradient of the loss is from where the optimum has it."""
        b, whole = self.theta[1:], g[1:] + self.l2 * self.theta[1:]
        off = np.where(b != 0, np.abs(whole + self.l1 * np.sign(b)), np.maximum(np.abs(whole) - self.l1, 0))
        return max(abs(g[0]), off.max(initial=0))

    def step(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        m = self.unit()
        g, h = m @ gradient / self.mass, m @ hessian @ m.T / self.mass
        value = loss / self.mass + self.penalty(self.theta)
        if self.best and value > self.best[1] + 1e-13 * abs(value):  # too far: half the step
            self.best = (*self.best[:2], self.best[2] / 2)
            self.theta = self.best[0] + self.best[2]
            if np.abs(self.best[2]).max() < 1e-12:
                self.theta, self.done = self.best[0], True
            return
        if self.violation(g) <= self.near:
            self.done = True
            return
        moved = quadratic(g, h, self.theta, self.l1, self.l2)
        self.best = (self.theta, value, moved - self.theta)
        self.theta = moved


def quadratic(g: np.ndarray, h: np.ndarray, theta: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Where g (t - theta) + (t - theta) h (t - theta) / 2 + l1 |t| + l2 t t / 2 is least (no penalty on the first): coordinate descent."""
    t, slope = theta.copy(), g.copy()  # slope: of the quadratic at t
    curve = np.diag(h).copy()
    places = [j for j in range(len(t)) if curve[j] > 1e-14]
    for _ in range(SWEEPS):
        most = 0.0
        for j in places:
            if j == 0:
                new = t[0] - slope[0] / curve[0]
            else:
                pull = curve[j] * t[j] - slope[j]
                new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (curve[j] + l2)
            if new != t[j]:
                slope += h[:, j] * (new - t[j])
                most = max(most, abs(new - t[j]) * curve[j])
                t[j] = new
        if most < 1e-12:
            break
    return t


def fit_many(table: DataFrame | Rows, jobs: Sequence[tuple[LogisticRegression, int | None]], fold_col: str | None = None) -> list[LogisticRegressionModel] | None:
    """A model for each (estimator, fold): fitted on the rows of all other folds of ``fold_col``, or on all rows where the fold is
    None. The estimators differ in penalties and limits only. All are fitted in the same passes; a model that has reached its
    optimum leaves them. None where labels or settings are not those of this module."""
    if not all(supported(e) for e, _ in jobs):
        return None
    data = table if isinstance(table, Rows) else Rows.of_vectors(table, jobs[0][0], fold_col)
    if data is None:
        return None
    width, apart = data.width, data.apart
    folds = data.moments()
    whole = sum(folds.values())
    if not folds or whole[0]:
        return None
    fits = []
    for e, f in jobs:
        own = whole - folds[f] if apart and f is not None and f in folds else whole
        squares, s1, s2, sy = own[1], *np.split(own[2:], 3)
        mass = s1[0]
        if not 0 < sy[0] < mass or not mass > squares / mass:
            return None
        mean = s1[1:] / mass
        spread = np.maximum(s2[1:] - s1[1:] * mean, 0) / (mass - squares / mass)
        std = np.where(spread > 1e-14 * np.maximum(s2[1:] / mass, 1e-300), np.sqrt(spread), 0.0)
        l1 = e.getRegParam() * e.getElasticNetParam()
        fit = _Fit(-1 if f is None else f, l1, e.getRegParam() - l1, min(e.getTol(), NEAR), e.getMaxIter(), mass, mean, std,
                   np.append(np.log(sy[0] / (mass - sy[0])), np.zeros(width)))
        # without coefficients every row has the same share, so the moments give the gradient
        fit.done = fit.violation(fit.unit() @ (s1 * (sy[0] / mass) - sy) / mass) <= fit.near
        fits.append(fit)

    taken = 0
    while going := [i for i, f in enumerate(fits) if not f.done and taken < f.steps]:
        now = np.stack([fits[i].raw() for i in going], 1)
        left_out = [fits[i].fold for i in going]

        def derivatives(x, y, w, fold, now=now, left_out=left_out):
            size, own = x.shape[1], np.stack([w * (fold != f) if apart and f >= 0 else w for f in left_out], 1)
            out = np.zeros((len(left_out), 1 + size + size * size))
            for a in range(0, len(y), CHUNK):
                part, weight = x[a: a + CHUNK], own[a: a + CHUNK]
                margin, label = part @ now, y[a: a + CHUNK, None]
                small = np.exp(-np.abs(margin))
                p = np.where(margin >= 0, 1, small) / (1 + small)
                out[:, 0] += (weight * (np.log1p(small) + np.maximum(margin, 0) - label * margin)).sum(0)
                out[:, 1: 1 + size] += (weight * (p - label)).T @ part
                curve = weight * p * (1 - p)
                # second derivatives only point the way: single precision, and half of the symmetric product
                root, single = np.sqrt(curve).astype(np.float32), part.astype(np.float32)
                for k in range(len(left_out)):
                    z = single * root[:, k: k + 1]
                    out[k, 1 + size:] += (z.T @ z).ravel()
            yield from enumerate(out)

        found = _summed(data.rows, data.parts(), derivatives, len(going))
        for k, i in enumerate(going):
            v = found[k]
            fits[i].step(v[0], v[1: width + 2], v[width + 2:].reshape(width + 1, width + 1))
        taken += 1
    return [_as_model(data.rows, e, f.raw()) for (e, _), f in zip(jobs, fits, strict=True)]


def areas(table: DataFrame | Rows, models: Sequence[tuple[LogisticRegressionModel, int]], est: LogisticRegression, fold_col: str) -> list[float] | None:
    """Area under the ROC curve of each (model, fold) on the rows of the fold, from one pass for all: counts of both classes in bins of
    the score, in which scores count as ties. Bins are narrow near the mean score, equal scores share a bin.
    None where a fold lacks a class."""
    data = table if isinstance(table, Rows) else Rows.of_vectors(table, est, fold_col)
    whole = sum(data.moments().values())
    s1, s2, _ = np.split(whole[2:], 3)
    mean = s1 / s1[0]
    std = np.sqrt(np.maximum(s2 / s1[0] - mean ** 2, 0))
    std[0] = 0
    coefficients = np.stack([np.append(m.intercept, m.coefficients.toArray()) for m, _ in models], 1)
    middle, wide = mean @ coefficients, std @ np.abs(coefficients)
    per_fold: dict[int, list[int]] = {}
    for i, (_, f) in enumerate(models):
        per_fold.setdefault(f, []).append(i)

    def counts(x, y, w, fold):
        for f, own in per_fold.items():
            rows = np.flatnonzero(fold == f)
            if not rows.size:
                continue
            label = y.take(rows).astype(np.int64)
            margin = x[rows] @ coefficients[:, own]
            for k, i in enumerate(own):
                z = (margin[:, k] - middle[i]) / wide[i] if wide[i] > 0 else np.zeros(len(rows))
                place = ((z / (1 + np.abs(z)) + 1) * (BINS / 2)).astype(np.int64).clip(0, BINS - 1)
                yield i, np.bincount(place * 2 + label, minlength=2 * BINS).astype(np.float64)

    found = _summed(data.rows, data.parts(), counts, len(models))
    out = []
    for i in range(len(models)):
        if i not in found:
            return None
        negative, positive = found[i].reshape(-1, 2).T
        if not negative.sum() or not positive.sum():
            return None
        below = np.cumsum(negative) - negative
        out.append(float((positive * (below + negative / 2)).sum() / (positive.sum() * negative.sum())))
    return out


def _as_model(table: DataFrame, est: LogisticRegression, b: np.ndarray) -> LogisticRegressionModel:
    sc = table.sparkSession.sparkContext
    java = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(est.uid, _py2java(sc, Vectors.dense(b[1:])), float(b[0]))
    return est._copyValues(LogisticRegressionModel(java))
