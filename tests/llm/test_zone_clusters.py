"""Centroid clustering against plain integer rounds, and the parts of the zone map."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayspan.llm import zone_clusters as zc
from dayspan.llm.common import saved


def plain(rows, k, rounds, dims, scale, seed="3"):
    """{row number: (cluster, distance)} and the centroids, in Python integers."""
    kept = [(i, vid, [int(np.floor(float(x) * scale)) for x in v]) for i, (vid, v) in enumerate(rows)
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[1] is None, hashlib.sha256(f"{seed}:{r[1]}".encode()).hexdigest(), np.array(r[2], "<i4").tobytes()))
    cent = [r[2] for r in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cent))

    for _ in range(rounds):
        own = {}
        for _, _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        cent = [[sum(col) // len(own[n]) for col in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(cent)]
    return sorted(((vid is None, vid or 0), near(v)[1], near(v)[0]) for _, vid, v in kept), cent


def run(spark, rows, k=4, rounds=3, dims=4, scale=16, block=8):
    df = spark.createDataFrame([(vid, v, "x", 1) for vid, v in rows], "vec_id long, embedding array<float>, v string, cluster int").repartition(5)
    out, cent = zc.cluster(df, k=k, rounds=rounds, dims=dims, scale=scale, block=block)
    assert out.columns == ["vec_id", "cluster", "distance"]
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in out.collect()), cent.tolist()


def near_points(rng, n, dims=4):
    heads = [[rng.uniform(-3, 3) for _ in range(dims)] for _ in range(5)]
    return [(i, [h + rng.gauss(0, .3) for h in rng.choice(heads)]) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_plain_rounds(spark, seed):
    rng = random.Random(seed)
    rows = near_points(rng, 300)
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # one vector of a third of the rows
    rows += [(2000, [1.0, None, 1.0, 1.0]), (2001, None), (2002, [1.0] * 3), (2003, [float("nan")] * 4), (2004, [float("inf")] * 4),
             (2005, []), (None, [0.5] * 4), (7, rows[7][1]), (8, [9.0, -9.0, 9.0, -9.0])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == plain(rows, 4, 3, 4, 16)


def test_ties_and_empty_clusters(spark):
    """Equal starting centroids: the smaller number takes all, the other stays where it is."""
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(99, [0.0] * 4)]
    got, cent = run(spark, rows, k=5, rounds=4)
    assert (got, cent) == plain(rows, 5, 4, 4, 16)
    assert len(cent) == 5


def test_fewer_vectors_than_centroids_and_no_vectors(spark):
    rows = [(1, [1.0] * 4), (2, [-1.0] * 4)]
    assert run(spark, rows) == plain(rows, 4, 3, 4, 16)
    assert run(spark, []) == ([], [])
    assert run(spark, [(1, None), (2, [1.0])]) == ([], [])


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (2, 1), (4, 2), (6, 1)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = [int("".join(map(str, r)), 2) for r in zc.hilbert(cells, bits)]
    assert sorted(place) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_boxes_keep_every_nearest_centroid():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(-20, 20, (rng.integers(1, 9), 3)) + rng.integers(-30, 30, 3)
        c = rng.integers(-40, 40, (6, 3))
        fit = zc.candidates(x.min(0)[None], x.max(0)[None], c)[0]
        d = ((x[:, None] - c) ** 2).sum(2)
        assert fit[d.argmin(1)].all() and fit[(d == d.min(1, keepdims=True)).any(0)].all()


def test_distances_are_exact_on_both_paths():
    rng = np.random.default_rng(2)
    for most in (1000, zc.EXACT, zc.LIMIT - 1):
        x, c = rng.integers(-most, most + 1, (50, 64)), rng.integers(-most, most + 1, (5, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
        assert zc.distances(x, c).tolist() == want


def test_blocks_prune_and_hold_every_vector(spark):
    rng = random.Random(4)
    df = spark.createDataFrame(near_points(rng, 4000), "vec_id long, embedding array<float>")
    kept = saved(zc.integers(df, 4, 1024, "vec_id", "embedding"), "test-vectors")
    zones = saved(zc.in_blocks(kept, 4, 32), "test-zones")
    assert sorted(r.id for r in zones.select(F.explode("ids").alias("id")).collect()) == list(range(4000))
    cent = zc.first_centroids(kept, 8, 4, "3")
    low, high = (np.stack([np.frombuffer(bytes(r[c]), "<i4") for r in zones.collect()]).astype(np.int64) for c in ("low", "high"))
    assert zc.candidates(low, high, cent).mean() < 0.7
