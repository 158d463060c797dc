"""Operator 11: centroid clustering over zone maps in Hilbert order.

1. Vectors become integers, floor(scale * x), and are written once. Their place
   on a Hilbert curve comes from two bits a component (cut at the component's
   mean and one deviation to either side).
2. A range sort by that place (rows of one place are told apart by their
   row number in the written file, so a vector that very many rows share is dealt
   over many tasks) puts near vectors side by side; every ``block`` of them is
   one row: ids, packed components, and the box of least and greatest components.
3. A round reads the blocks. The distance from a box to a centroid is at least
   that of the box's nearest point and at most that of its farthest corner, so only
   centroids whose least distance is within the smallest greatest one can be the nearest of
   any vector in the block. With one such centroid the block is assigned as
   a whole; else its vectors are compared with these centroids, exactly.
4. Tasks return a sum and count for each cluster; Spark adds them up, and the driver
   gets k x dims integers a round, whatever the number of vectors.

All arithmetic is on integers (in doubles only while every sum is below 2^53), so
reruns agree. Ties go to the smaller centroid number; an empty centroid stays.

Not kept: null vectors, other lengths, null or non-finite components, and components
of 2^27 / scale and more (their squared distances would not fit a long). A null
vec_id is kept as any other row, but cannot be a first centroid unless there are too few others. Repeated
rows count each. Fewer vectors than k give as many centroids; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import in_arrow, saved

BLOCK = 128
LIMIT = 1 << 27
#: components up to which products summed over dims stay exact in doubles (dims up to 64)
EXACT = 1 << 21


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (numbers below 2^bits), as
    the bit planes of the index: (rows, bits * dims) of 0 and 1, high bits first."""
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    for level in range(bits - 1, 0, -1):  # undo the turns of the levels above
        low = (1 << level) - 1
        for axis in x:
            turned = (axis >> level) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)  # from Gray code
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    planes = [(x >> level) & 1 for level in range(bits - 1, -1, -1)]
    return np.concatenate(planes).T.astype(np.uint8)


def integers(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the kept vectors, packed as little-endian 32-bit integers."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LIMIT / scale)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            packed = np.floor(flat * scale).astype("<i4").tobytes()
            yield pa.record_batch({"id": batch.column("id"), "v": pa.array([packed[at: at + 4 * dims] for at in range(0, len(packed), 4 * dims)], pa.binary())})

    kept = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where((F.size("v") == dims) & fine)
    return kept.transform(in_arrow, run, f"id {vectors.schema[id_col].dataType.simpleString()}, v binary")


def matrix(packed: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<i4").reshape(-1, dims)


def moments(kept: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each component (they place the cuts, nothing else)."""

    def run(batches):
        total = np.zeros((3, dims))
        for batch in batches:
            x = matrix(batch.column("v"), dims).astype(float)
            total += [np.full(dims, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.record_batch({"at": pa.array(np.arange(dims), pa.int32()), **{c: pa.array(t) for c, t in zip("nst", total, strict=True)}})

    rows = (kept.select("v").transform(in_arrow, run, "at int, n double, s double, t double")
            .groupBy("at").agg(*[F.sum(c).alias(c) for c in "nst"]).orderBy("at").collect())
    n, s, t = (np.array([r[c] for r in rows] or [0.0] * dims) for c in "nst")
    mean = s / np.maximum(n, 1)
    return mean, np.sqrt(np.maximum(t / np.maximum(n, 1) - mean * mean, 0))


BLOCK_ROW = "ids array<{}>, data binary, low binary, high binary"


def in_blocks(kept: DataFrame, dims: int, block: int = BLOCK) -> DataFrame:
    """The zone map: kept vectors in Hilbert order, ``block`` to a row, with their boxes.
    ``kept`` must be read from files (its row numbers there spread rows of one place)."""
    mean, deviation = moments(kept, dims)
    kind = kept.schema["id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            x = matrix(batch.column("v"), dims)
            cells = sum((x >= mean + d * deviation).astype(np.int64) for d in (-1, 0, 1))
            curve = np.packbits(hilbert(cells, 2), axis=1)
            yield pa.record_batch([batch.column("id"), batch.column("v"), pa.array([r.tobytes() for r in curve], pa.binary()), batch.column("row")],
                                  names=["id", "v", "curve", "row"])

    def cut(batches):
        held: list[pa.RecordBatch] = []

        def rows(table: pa.Table):
            ids, data = pa.concat_arrays(table.column("id").chunks), matrix(table.column("v"), dims)
            edges = np.append(np.arange(0, table.num_rows, block), table.num_rows)
            parts = [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            return pa.record_batch({
                "ids": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids),
                **{c: pa.array([f(p).tobytes() for p in parts], pa.binary())
                   for c, f in (("data", np.asarray), ("low", lambda p: p.min(0)), ("high", lambda p: p.max(0)))}})

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            whole = table.num_rows // block * block
            if whole:
                yield rows(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held and sum(map(len, held)):
            yield rows(pa.Table.from_batches(held))

    placed = (kept.select("id", "v", F.col("_metadata.row_index").alias("row"))
              .transform(in_arrow, place, f"id {kind}, v binary, curve binary, row long"))
    ordered = placed.repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")
    return ordered.select("id", "v").transform(in_arrow, cut, BLOCK_ROW.format(kind))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(blocks, centroids): whether the centroid can be the nearest of a vector in the block's box."""
    out = np.empty((len(low), len(centroids)), bool)
    for part in range(0, len(low), 256):
        a, b = low[part: part + 256, None], high[part: part + 256, None]
        least = (np.maximum(np.maximum(a - centroids, centroids - b), 0) ** 2).sum(2)
        most = (np.maximum(np.abs(centroids - a), np.abs(b - centroids)) ** 2).sum(2)
        out[part: part + 256] = least <= most.min(1, keepdims=True)
    return out


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors, centroids) of integers, as longs."""
    if x.shape[1] <= 64 and max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        y, c = x.astype(float), centroids.astype(float)
        return ((y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each block in a batch: vectors, cluster and squared distance of each, number of candidates compared."""
    dims = centroids.shape[1]
    low, high = (matrix(batch.column(c), dims).astype(np.int64) for c in ("low", "high"))
    fit = candidates(low, high, centroids)
    for i, packed in enumerate(batch.column("data")):
        x = np.frombuffer(packed.as_buffer(), "<i4").reshape(-1, dims)
        own = np.flatnonzero(fit[i])
        d = distances(x, centroids[own])
        best = d.argmin(1)  # the first of equals
        yield x, own[best], d[np.arange(len(x)), best], len(own)


def first_centroids(kept: DataFrame, k: int, dims: int, seed: str) -> np.ndarray:
    """The k kept vectors whose id has the least hash (k rows to the driver)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    return np.array([np.frombuffer(bytes(r.v), "<i4") for r in rows], np.int64).reshape(-1, dims)


def moved(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def run(batches):
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for x, own, _, _ in nearest(batch, centroids):
                for c in np.unique(own):
                    mine = x[own == c]
                    total[c, :dims] += mine.sum(0, dtype=np.int64)
                    total[c, dims] += len(mine)
        some = np.flatnonzero(total[:, dims])
        yield pa.record_batch({"cluster": pa.array(some, pa.int32()), "sums": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    sums = (zones.select("data", "low", "high").transform(in_arrow, run, "cluster int, sums array<long>")
            .select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")))
    got = {(r.cluster, r.pos): int(r.total) for r in sums.collect()}
    return np.array([[got[c, i] // got[c, dims] for i in range(dims)] if (c, dims) in got else centroids[c].tolist() for c in range(k)], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3",
            block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id_col, cluster, distance) of every kept vector after ``rounds`` rounds, as a
    written table, and the final centroids."""
    kept = saved(integers(vectors, dims, scale, id_col, vector_col), "vectors")
    centroids = first_centroids(kept, k, dims, seed)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long"), centroids
    zones = saved(in_blocks(kept, dims, block), "zones")
    for _ in range(rounds):
        centroids = moved(zones, centroids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own, distance = (np.concatenate(x) for x in zip(*((own, d) for _, own, d, _ in nearest(batch, centroids)), strict=True))
                yield pa.record_batch({"id": batch.column("ids").flatten(), "cluster": pa.array(own, pa.int32()), "distance": pa.array(distance, pa.int64())})

    out = zones.transform(in_arrow, run, f"id {kind}, cluster int, distance long")
    return saved(out.withColumnRenamed("id", id_col), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; what is joined has a row for each centroid."""
    totals = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    rows = [(c, totals.get(c, 0), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    facts = assigned.sparkSession.createDataFrame(rows, "of int, cluster_inertia long, centroid_sha256 string")
    facts = facts.withColumn("inertia", F.lit(sum(totals.values())).cast("long"))
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col("of")).drop("of")
