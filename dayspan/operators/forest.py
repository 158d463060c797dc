"""Random forests on stored blocks of binned rows: one pass a level for all trees, nothing cached.

Spark's forest keeps every row in memory with a number per tree and reads from disk, at every level, what does
not fit. Here the feature values are binned once and stored as blocks of bytes, a byte a value. A level is a
pass over the blocks: each task draws its rows again (seeded by tree and block, so every level
sees the same bootstrap sample), parts them by the splits found so far and counts classes per node, drawn feature and
bin, two features of few bins at once; the counts are added up per tree, where the best splits are found. A task holds one block and the counts.

The method is that of ``RandomForestClassifier`` with two classes: bins at quantiles, bootstrap by Poisson(1) counts, a
square root of the features per node, splits by Gini gain, categories ordered by their rate, leaves that agree merged.
The result is Spark's own model, loaded from a folder in Spark's format.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from dayspan.operators.features import Place
from dayspan.session import scratch_path
from dayspan.sources.tables import materialize

# tasks get this module's functions with their job, so the core needs nothing installed on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: rows of a block, blocks that a task reads at least where there are many, bytes of counts that a task holds
BLOCK, BLOCKS, COUNT_BYTES = 1 << 16, 32, 128 << 20
#: pairs of bins up to which two features of a node are counted together
PAIR = 1 << 10
#: quantiles from which bins are chosen, and their accuracy
QUANTILES, ACCURACY = 1000, 10_000
#: while blocks are read: a file is a task, and a batch holds a few blocks
READ_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.files.maxPartitionBytes": "64m",
             "spark.sql.files.openCostInBytes": "64m"}


def supported(est: RandomForestClassifier) -> bool:
    """Whether the settings are those this module knows (others are left to Spark's own fit)."""
    want = {"impurity": "gini", "featureSubsetStrategy": "auto", "subsamplingRate": 1.0, "bootstrap": True, "minWeightFractionPerNode": 0.0}
    return all(est.getOrDefault(k) == v for k, v in want.items()) and est.getMaxBins() <= 256 and est.getNumTrees() > 1 and est.getMaxDepth() >= 1


def _arities(table: DataFrame, features: str) -> dict[int, int]:
    """Places of the vector that hold category indexes, with the number of categories."""
    attrs = table.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    out = {a["idx"]: len(a["vals"]) if "vals" in a else a.get("num_vals") for a in attrs.get("nominal", [])}
    return {k: v for k, v in out.items() if v} | {a["idx"]: 2 for a in attrs.get("binary", [])}


def _thresholds(values: list[float], bins: int) -> np.ndarray:
    """Bounds between bins, halfway between neighbouring quantiles; a value belongs to the first bound not below it."""
    v = np.unique(np.array([x for x in values if x == x], np.float64))
    mid = v[:-1] + (v[1:] - v[:-1]) / 2
    mid = mid[np.isfinite(mid)]
    if len(mid) < bins:
        return mid
    own = np.unique(np.array([x for x in values if x == x])[np.linspace(0, len(values) - 1, bins + 1).astype(int)[1:-1].clip(max=len(values) - 1)])
    return own[:-1] if own[-1] == v[-1] else own


@contextmanager
def reading(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in READ_CONF}
    try:
        for k, v in READ_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def binned_blocks(rows: DataFrame, bounds: list[np.ndarray | int], parts: int, weighted: bool) -> DataFrame:
    """``rows`` (x0, x1 ...: values, y, w) as blocks: block (id), n, and bytes x (a byte a value, feature by feature), y and w."""

    def run(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(pieces):
            x, y, w = (np.concatenate(p, axis=-1) for p in zip(*pieces, strict=True))
            return pa.record_batch({"block": pa.array([part << 32 | seq], pa.int64()), "n": pa.array([len(y)], pa.int32()),
                                    "x": pa.array([x.tobytes()], pa.binary()),
                                    "y": pa.array([y.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary())})

        for batch in batches:
            n = batch.num_rows
            x = np.empty((len(bounds), n), np.uint8)
            for j, b in enumerate(bounds):
                values = batch.column(f"x{j}").to_numpy(zero_copy_only=False)
                if not np.isfinite(values).all():
                    raise ValueError("feature vectors must not hold NaN or infinite values")
                x[j] = values.clip(0, b - 1) if isinstance(b, int) else np.searchsorted(b, values)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.uint8)
            w = batch.column("w").to_numpy(zero_copy_only=False).astype(np.float64) if weighted else np.empty(n, "V0")
            for a in range(0, n, BLOCK):
                held.append((x[:, a: a + BLOCK], y[a: a + BLOCK], w[a: a + BLOCK]))
                size += len(held[-1][1])
                if size >= BLOCK:
                    yield block(held)
                    held, size, seq = [], 0, seq + 1
        if size:
            yield block(held)

    blocks = rows.mapInArrow(run, "block long, n int, x binary, y binary, w binary")
    return materialize(blocks.repartition(parts), "forest-blocks")


class _Tree:
    """A growing tree: per node its class weights, rows, split (feature, bins that go left, gain) and children."""

    def __init__(self):
        self.stats, self.rows, self.split, self.child, self.open = [None], [0], [None], [None], [0]

    def add(self, stats: np.ndarray, rows: int) -> int:
        for of, v in ((self.stats, stats), (self.rows, rows), (self.split, None), (self.child, None)):
            of.append(v)
        return len(self.stats) - 1


def _gini(stats: np.ndarray, axis: int = -1) -> np.ndarray:
    total = stats.sum(axis)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, 1 - (stats ** 2).sum(axis) / total ** 2, 0.0)


def best_splits(h: np.ndarray, c: np.ndarray, drawn: np.ndarray, sizes: np.ndarray, listed: np.ndarray, least: int, gain_least: float):
    """Per node (of class weights ``h`` and rows ``c`` by node, drawn feature, bin and class): gain (-1 without a valid
    split), feature, bins that go left, and class weights and rows on both sides."""
    nodes, m, bins, _ = h.shape
    total = h.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = np.where(total > 0, h[..., 1] / total, np.inf)
    place = np.broadcast_to(np.arange(bins), total.shape)
    key = np.where(listed[drawn][..., None], rate, place)
    key = np.where(place < sizes[drawn][..., None], key, np.inf)
    order = np.argsort(key, axis=-1, kind="stable")
    left = np.take_along_axis(h, order[..., None], 2).cumsum(2)
    left_rows = np.take_along_axis(c.sum(-1), order, 2).cumsum(2)
    whole, rows = left[:, :, -1:], left_rows[:, :, -1:]
    right = whole - left
    wl, wr = left.sum(-1), right.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _gini(whole) - (wl * _gini(left) + wr * _gini(right)) / (wl + wr)
    valid = (left_rows >= least) & (rows - left_rows >= least) & (gain >= gain_least)
    gain = np.where(valid, gain, -1.0).reshape(nodes, -1)
    at = gain.argmax(1)
    which = np.arange(nodes), at // bins, at % bins
    goes = np.zeros((nodes, bins), bool)
    for i in range(nodes):
        goes[i, order[i, at[i] // bins, : at[i] % bins + 1]] = True
    return gain[np.arange(nodes), at], drawn[np.arange(nodes), at // bins], goes, left[which], right[which], left_rows[which], (rows - left_rows)[which]


def _poisson_table() -> tuple[np.ndarray, np.ndarray]:
    """Poisson(1) counts by 16 random bits, UNSURE where the bits leave two or more open; and the distribution."""
    terms = [np.exp(-1.0)]
    for k in range(1, 25):
        terms.append(terms[-1] / k)
    below = np.cumsum(terms)
    low, high = (np.searchsorted(below, np.arange(65536) / 65536 + d, side="right") for d in (0, 1 / 65536))
    return np.where(low == high, low, UNSURE).astype(np.uint8), below


UNSURE = 255
POISSON, POISSON_BELOW = _poisson_table()


def drawn_times(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in the tree's bootstrap sample: Poisson(1) counts, the same at every level."""
    source = np.random.SFC64([seed, tree, block])
    bits = source.random_raw(-(-n // 4)).view(np.uint16)[:n]
    times = POISSON.take(bits)
    open_ = np.flatnonzero(times == UNSURE)
    if open_.size:
        times[open_] = np.searchsorted(POISSON_BELOW, (bits[open_] + np.random.Generator(source).random(open_.size)) / 65536, side="right")
    return times


def _plan(tree: _Tree, picks: np.ndarray, sizes: np.ndarray, listed: np.ndarray) -> tuple:
    """What a task needs to count the open nodes of a tree: the splits above them as nested tuples (feature, bins that go left, left,
    right) down to the nodes' places in ``picks``, None where a leaf is; per node the features counted together as (place of one of
    them or -1, its feature, place of the other, its feature, where their counts begin, how many); and the number of counts."""
    place = {k: i for i, k in enumerate(tree.open)}

    def below(i):
        if tree.split[i] is None:
            return place.get(i)
        feature, goes, _ = tree.split[i]
        left, right = (below(k) for k in tree.child[i])
        last = np.flatnonzero(goes)[-1]
        return None if left is None and right is None else (feature, goes if listed[feature] else int(last), left, right)

    groups, at = [], 0
    for own in picks:
        order = sorted(range(len(own)), key=lambda j: -sizes[own[j]])
        groups.append([])
        while order:
            j, i = order.pop(0), -1
            if order and sizes[own[j]] * sizes[own[order[-1]]] <= PAIR:
                i = order.pop()
            many = int(sizes[own[j]] * (sizes[own[i]] if i >= 0 else 1) * 2)
            groups[-1].append((i, int(own[i]), j, int(own[j]), at, many))
            at += many
    return below(0), groups, at, picks


def _reached(node, rows: np.ndarray, columns: list[np.ndarray]):
    """The open nodes (places in the plan) below a split, with those of ``rows`` that get there."""
    if node is None or not rows.size:
        return
    if isinstance(node, int):
        yield node, rows
        return
    feature, goes, left, right = node
    value = columns[feature].take(rows)
    left_side = value <= goes if isinstance(goes, int) else goes.take(value)
    if left is not None:
        yield from _reached(left, rows.compress(left_side), columns)
    if right is not None:
        yield from _reached(right, rows.compress(~left_side), columns)


def _apart(plan: tuple, counts: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """Counts by node, drawn feature, bin and class, of those counted together."""
    _, groups, _, picks = plan
    out = np.zeros((*picks.shape, bins, 2))
    for k, own in enumerate(groups):
        for i, f, j, g, at, many in own:
            both = counts[at: at + many].reshape(-1, sizes[g], 2)
            out[k, j, : sizes[g]] = both.sum(0)
            if i >= 0:
                out[k, i, : sizes[f]] = both.sum(1)
    return out


def _level(blocks: DataFrame, plans: dict[int, tuple], bins: int, weighted: bool, mass_of: np.ndarray | None, sizes: np.ndarray, listed: np.ndarray,
           est: RandomForestClassifier) -> list:
    """The best splits of the open nodes of the trees in ``plans``. ``mass_of``: weight of a row of each class, None where rows of a
    class differ in theirs (``weighted``: weights are counted too)."""
    spark = blocks.sparkSession
    sent, seed = spark.sparkContext.broadcast(plans), est.getSeed() & (2**63 - 1)
    least, gain_least = est.getMinInstancesPerNode(), est.getMinInfoGain()

    def count(batches):
        sums = {}
        for batch in batches:
            for block, n, xs, ys, ws in zip(*(batch.column(k).to_pylist() for k in ("block", "n", "x", "y", "w")), strict=True):
                x, y = np.frombuffer(xs, np.uint8).reshape(-1, n), np.frombuffer(ys, np.uint8)
                w = np.frombuffer(ws, np.float64) if weighted else None
                classed = list(x.astype(np.uint8 if bins <= 128 else np.uint16) * 2 + y)
                x = list(x)
                for t, (top, groups, many, _) in sent.value.items():
                    times = drawn_times(seed, t, block, n)
                    if t not in sums:
                        sums[t] = np.zeros(many), np.zeros(many) if weighted else None
                    rows_of, mass = sums[t]
                    for k, rows in _reached(top, np.flatnonzero(times != 0), x):
                        often = times.take(rows).astype(np.float64)
                        heavy = often * w.take(rows) if weighted else None
                        for i, f, _, g, at, size in groups[k]:
                            code = classed[g].take(rows)
                            if i >= 0:
                                code = x[f].take(rows) * np.int64(2 * sizes[g]) + code
                            rows_of[at: at + size] += np.bincount(code, often, size)
                            if weighted:
                                mass[at: at + size] += np.bincount(code, heavy, size)
        for t, (rows_of, mass) in sums.items():
            plan = sent.value[t]
            yield pa.record_batch({"tree": pa.array([t], pa.int32()), "rows": pa.array([_apart(plan, rows_of, sizes, bins).tobytes()], pa.binary()),
                                   "mass": pa.array([_apart(plan, mass, sizes, bins).tobytes() if weighted else None], pa.binary())})

    def choose(part: pa.Table) -> pa.Table:
        t = part.column("tree")[0].as_py()
        picks = sent.value[t][3]
        shape = (*picks.shape, bins, 2)

        def added(name):
            total = np.zeros(shape)
            for v in part.column(name):
                total += np.frombuffer(v.as_buffer(), np.float64).reshape(shape)
            return total

        c = added("rows")
        h = added("mass") if weighted else c if mass_of is None else c * mass_of
        gain, feature, goes, left, right, left_rows, right_rows = best_splits(h, c, picks, sizes, listed, least, gain_least)
        return pa.table({"tree": pa.array([t] * len(gain), pa.int32()), "slot": pa.array(np.arange(len(gain)), pa.int32()), "gain": gain,
                         "feature": pa.array(feature, pa.int32()), "goes": pa.array([g.tobytes() for g in goes], pa.binary()),
                         "left": pa.array(left.tolist(), pa.list_(pa.float64())), "right": pa.array(right.tolist(), pa.list_(pa.float64())),
                         "left_rows": pa.array(left_rows.astype(np.int64)), "right_rows": pa.array(right_rows.astype(np.int64)),
                         "own": pa.array((h[:, 0].sum(1)).tolist(), pa.list_(pa.float64())), "own_rows": pa.array(c[:, 0].sum((1, 2)).astype(np.int64))})

    counted = blocks.mapInArrow(count, "tree int, rows binary, mass binary")
    out = counted.groupBy("tree").applyInArrow(choose, "tree int, slot int, gain double, feature int, goes binary, left array<double>, right array<double>, "
                                                       "left_rows long, right_rows long, own array<double>, own_rows long")
    with reading(spark):
        found = out.collect()  # a row a node
    sent.unpersist()
    return found


def fit_forest(table: DataFrame, est: RandomForestClassifier) -> RandomForestClassificationModel | None:
    """The forest of ``est`` fitted on stored vectors; None where labels or settings are not those of this module."""
    if not supported(est):
        return None
    x = table.select(F.size(vector_to_array(est.getFeaturesCol()))).first()
    if x is None:
        return None
    arity = _arities(table, est.getFeaturesCol())
    rows = table.withColumn("__x", vector_to_array(est.getFeaturesCol()))
    return _fit(_rows(rows, [F.get("__x", F.lit(j)) for j in range(x[0])], arity, est), x[0], arity, est)


def fit_forest_on(df: DataFrame, known: Sequence[Place], est: RandomForestClassifier) -> RandomForestClassificationModel | None:
    """``fit_forest`` without vectors, on the values that make them."""
    if not supported(est) or any(p.hot for p in known):
        return None
    arity = {j: p.categories for j, p in enumerate(known) if p.categories}
    return _fit(materialize(_rows(df, [p.column for p in known], arity, est), "forest-rows"), len(known), arity, est)


def _weight(est: RandomForestClassifier) -> str | None:
    return est.getWeightCol() if est.isDefined("weightCol") and est.getWeightCol() else None


def _rows(df: DataFrame, values: list[Column], arity: dict[int, int], est: RandomForestClassifier) -> DataFrame:
    weight = _weight(est)
    return df.select(*[c.cast("int" if j in arity else "double").alias(f"x{j}") for j, c in enumerate(values)], F.col(est.getLabelCol()).cast("double").alias("y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))


def _fit(rows: DataFrame, width: int, arity: dict[int, int], est: RandomForestClassifier) -> RandomForestClassificationModel | None:
    if width < 2:
        return None
    spark, weight = rows.sparkSession, _weight(est)
    grid = [i / QUANTILES for i in range(QUANTILES + 1)]
    plain = [j for j in range(width) if j not in arity]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("most"), F.count_if(~F.col("y").isin(0.0, 1.0) | F.col("y").isNull()).alias("other"),
                    F.min("w").alias("lightest"), *[of(F.when(F.col("y") == c, F.col("w"))).alias(f"{name}{c}") for c in (0, 1) for name, of in (("light", F.min), ("heavy", F.max))], *[F.percentile_approx(f"x{j}", grid, ACCURACY).alias(f"q{j}") for j in plain]).first()
    limit = min(est.getMaxBins(), seen["n"])
    if seen["other"] or seen["most"] != 1.0 or not seen["lightest"] >= 0 or any(a > limit for a in arity.values()):
        return None
    bounds = [arity[j] if j in arity else _thresholds(seen[f"q{j}"] or [], limit) for j in range(width)]
    sizes = np.array([b if isinstance(b, int) else len(b) + 1 for b in bounds])
    listed = np.array([j in arity for j in range(width)])
    # rows of a class that have one weight are counted, and the counts are weighed
    mass_of = np.array([0.0 if seen[f"light{c}"] is None else seen[f"light{c}"] for c in (0, 1)])
    differ = bool(weight) and any(seen[f"light{c}"] != seen[f"heavy{c}"] for c in (0, 1))
    slots = spark.sparkContext.defaultParallelism
    blocks = -(-seen["n"] // BLOCK)
    stored = binned_blocks(rows, bounds, max(min(blocks, 4 * slots), blocks // BLOCKS), differ)

    n_trees, bins, m = est.getNumTrees(), int(sizes.max()), int(np.ceil(np.sqrt(width)))
    trees = [_Tree() for _ in range(n_trees)]
    rng = np.random.default_rng(est.getSeed() & (2**63 - 1))
    for depth in range(est.getMaxDepth()):
        growing = [t for t in range(n_trees) if trees[t].open]
        drawn = {t: np.array([rng.choice(width, m, replace=False) for _ in trees[t].open]) for t in growing}
        plans = {t: _plan(trees[t], drawn[t], sizes, listed) for t in growing}
        most = max((max(p[2] * (2 if differ else 1), p[3].size * bins * 4) for p in plans.values()), default=1) * 8
        step = max(1, COUNT_BYTES // most)
        for a in range(0, len(growing), step):
            group = growing[a: a + step]
            found: dict[int, list] = {t: [] for t in group}
            for r in _level(stored, {t: plans[t] for t in group}, bins, differ, None if differ else mass_of, sizes, listed, est):
                found[r.tree].append(r)
            for t in group:
                tree, below = trees[t], []
                for r in found[t]:
                    i = tree.open[r.slot]
                    if depth == 0:
                        tree.stats[i], tree.rows[i] = np.array(r.own), r.own_rows
                    if r.gain <= 0:
                        continue
                    tree.split[i] = (r.feature, np.frombuffer(r.goes, bool), r.gain)
                    sides = [(np.array(r.left), r.left_rows), (np.array(r.right), r.right_rows)]
                    tree.child[i] = tuple(tree.add(*s) for s in sides)
                    if depth + 1 < est.getMaxDepth():
                        below += [k for k, s in zip(tree.child[i], sides, strict=True) if _gini(s[0]) > 0]
                tree.open = below
    return _as_model(spark, est, trees, bounds, width)


def _as_model(spark: SparkSession, est: RandomForestClassifier, trees: list[_Tree], bounds: list, width: int) -> RandomForestClassificationModel:
    """Spark's model of the trees, by way of a folder in the format that Spark's models are saved in."""
    rows = []

    def put(t: int, tree: _Tree, i: int) -> None:
        at = len(out)
        stats = tree.stats[i] if tree.stats[i] is not None else np.zeros(2)
        node = [at, float(stats.argmax()), float(_gini(stats)), stats.tolist(), int(tree.rows[i]), -1.0, -1, -1, (-1, [], -1)]
        out.append(node)
        if tree.split[i] is None:
            return
        left, right = tree.child[i]
        put(t, tree, left)
        node[6], second = at + 1, len(out)
        put(t, tree, right)
        if len(out) == at + 3 and out[at + 1][1] == out[at + 2][1]:  # two leaves that agree are one
            node[1] = out[at + 1][1]
            del out[at + 1:]
            node[6] = -1
            return
        feature, goes, gain = tree.split[i]
        b, node[7], node[5] = bounds[feature], second, gain
        node[8] = ((feature, [float(k) for k in np.flatnonzero(goes[:b])], b) if isinstance(b, int)
                   else (feature, [float(b[np.flatnonzero(goes)[-1]])], -1))

    for t, tree in enumerate(trees):
        out: list = []
        put(t, tree, 0)
        rows += [(t, tuple(n)) for n in out]
    kind = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
            "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")
    base = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    params = {"paramMap": {p.name: v for p, v in est._paramMap.items()}, "defaultParamMap": {p.name: v for p, v in est._defaultParamMap.items()}}
    names = "org.apache.spark.ml.classification."
    of_tree = {k: {n: v for n, v in of.items() if n not in ("numTrees", "subsamplingRate", "featureSubsetStrategy", "bootstrap")} for k, of in params.items()}
    path = scratch_path(spark, "forest-model")
    spark.createDataFrame(rows, kind).repartition(1).sortWithinPartitions("treeID", "nodeData.id").write.parquet(f"{path}/data")
    per_tree = [(t, json.dumps({"class": names + "DecisionTreeClassificationModel", **base, "uid": f"{est.uid}_{t}", **of_tree}), 1.0) for t in range(len(trees))]
    spark.createDataFrame(per_tree, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = {"class": names + "RandomForestClassificationModel", **base, "uid": est.uid, **params, "numFeatures": width, "numClasses": 2, "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)


#: bytes that the node tables of a forest may take in a task that walks them
WALK_BYTES = 64 << 20


def votes(spark: SparkSession, nodes: list[Row]) -> Callable[[Column], Column] | None:
    """What takes an array of feature values to the sum over all trees of the class shares of its leaf, tree by tree. ``nodes`` (see
    ``certificates.forest_nodes``) are walked with values replaced by their places among the forest's thresholds or categories. None
    where the tables would be too large."""
    cuts: dict[int, set] = {}
    kinds: dict[int, set] = {}
    for r in nodes:
        if r.left is not None:
            (cuts if r.left_values is None else kinds).setdefault(r.feature, set()).update([r.threshold] if r.left_values is None else r.left_values)
    bins = max([len(v) + 1 for v in [*cuts.values(), *kinds.values()]], default=1)
    if cuts.keys() & kinds.keys() or len(nodes) * bins * 4 > WALK_BYTES:
        return None
    known = {f: (np.array(sorted(v)), f in kinds) for f, v in [*cuts.items(), *kinds.items()]}
    column = {f: i for i, f in enumerate(known)}
    by_tree: dict[int, list[Row]] = {}
    for r in nodes:
        by_tree.setdefault(r.tree, []).append(r)
    trees = []
    for t in sorted(by_tree):
        own = sorted(by_tree[t], key=lambda r: r.node)
        place, depth = {r.node: i for i, r in enumerate(own)}, {}
        feature, after = np.zeros(len(own), np.int64), np.repeat(np.arange(len(own), dtype=np.int32)[:, None], bins, 1)
        for i, r in enumerate(own):  # a child's number is above its parent's
            if r.left is None:
                continue
            values, listed = known[r.feature]
            goes = np.zeros(bins, bool)
            goes[1 + np.searchsorted(values, r.left_values) if listed else np.arange(np.searchsorted(values, r.threshold) + 1)] = True
            feature[i], after[i] = column[r.feature], np.where(goes, place[r.left], place[r.right])
            depth[r.left] = depth[r.right] = depth.get(r.node, 0) + 1
        counts = np.array([r.counts for r in own])
        total = counts.sum(1, keepdims=True)
        trees.append((feature, after.ravel(), np.divide(counts, total, out=np.zeros_like(counts), where=total > 0), max(depth.values(), default=0)))
    sent, code = spark.sparkContext.broadcast((known, trees)), np.uint8 if bins <= 256 else np.uint16 if bins <= 65536 else np.int32

    @F.arrow_udf("array<double>")
    def vote(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, trees = sent.value
        trees = [(feature, after.astype(np.int64), np.ascontiguousarray(own.T), steps) for feature, after, own, steps in trees]
        for a in arrays:
            n, classes = len(a), len(trees[0][2])
            values = a.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 1 + max(known, default=0)))
            x = np.zeros((max(len(known), 1), n), code)
            for i, (f, (of, listed)) in enumerate(known.items()):
                v = values[:, f]
                x[i] = np.searchsorted(of, v)
                if listed:
                    x[i] = np.where(of.take(x[i], mode="clip") == v, x[i] + 1, 0)
            x, row, out = x.ravel(), np.arange(n), np.zeros((classes, n))
            for feature, after, own, steps in trees:
                at, start = np.zeros(n, np.int64), feature * n
                for _ in range(steps):
                    at = after.take(at * bins + x.take(start.take(at) + row))
                for c in range(classes):
                    out[c] += own[c].take(at)
            yield pa.ListArray.from_arrays(np.arange(0, n * classes + 1, classes, dtype=np.int32), out.T.ravel())

    return vote
