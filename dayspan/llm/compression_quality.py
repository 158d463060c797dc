"""Operator 7: quality classifier by compression against trained dictionaries.

Two zstandard dictionaries are trained, one on good and one on bad labelled
text. A text's two compressed sizes, their difference normalised by the text's
size and by the compressed size, become a probability by a logistic
calibration on labelled rows that no dictionary has seen.

The fit takes a bounded sample, documented by parameters: ``per_class`` texts
of each label for the dictionaries (``piece_chars`` characters of each, from a
hashed offset) and as many again, whole, for the calibration; the true class
shares over all learnable labels set the intercept. Scoring covers every whole
text in one pass without a shuffle.

Nulls and empty texts: scored by the learned share of label 1. Rows without a
label, with a null label or with clashing labels (more than one value for a
doc_id) teach nothing. With labels of fewer than two values every text scores
the learned share (0.5 without labels). Repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import in_arrow, row_key

LEVEL = 3
DICT_BYTES = 1 << 17


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % n).cast("int")


def sizes_of(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """The features: difference by text size, by compressed size, and the compressed share (logarithm)."""
    n, g, b = max(1, len(text)), len(good.compress(text)), len(bad.compress(text))
    return 10 * (g - b) / n, 10 * (g - b) / max(g, b), float(np.log(max(g, b) / n))


def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d))
    return out


def train_dictionary(texts: list[str]) -> bytes:
    """A dictionary of at most DICT_BYTES. Too few samples to train on: their text itself."""
    pieces = [e[i: i + 1000] for e in (t.encode() for t in texts) for i in range(0, len(e), 1000)]
    pieces = [p for p in pieces if len(p) >= 8]
    if len(pieces) >= 100:
        try:
            return zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # samples too alike for the trainer
    return (b"\n".join(pieces) or b"\x00" * 8)[-DICT_BYTES:]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, piece_chars: int = 4000,
        seed: str = "quality") -> dict:
    """The model: two dictionaries, calibration weights, share of label 1."""
    marks = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.min(label).alias("y"), F.max(label).alias("y2")).where(F.col("y") == F.col("y2")).select("doc_id", "y"))
    shares = {r["y"]: r["n"] for r in marks.where(F.col("y").isin(0, 1)).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    model = {"share": (shares.get(1, 0) + 1) / (total + 2) if total else 0.5, "good": b"", "bad": b"", "weights": None}
    if len(shares) < 2:
        return model
    coin = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    picked = [marks.where(F.col("y") == y).orderBy(coin, "doc_id").limit(2 * per_class) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).withColumn("coin", F.conv(F.substring(coin, -6, 6), 16, 10).cast("long"))
    # half of the picked teach the dictionaries, half calibrate; of rows that repeat an id the text of
    # least hash counts, so at most 4 x per_class texts are used, however often ids repeat
    texts = (docs.select("doc_id", "text").where(F.length(F.trim("text")) > 0).join(F.broadcast(picked), "doc_id")  # at most 4 x per_class ids
             .groupBy("doc_id", "y", "coin").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")))
    span = F.greatest(F.length("text") - piece_chars, F.lit(0)) + 1
    taught = texts.where(F.col("coin") % 2 == 0).select("y", F.substr("text", (F.col("coin") % span + 1).cast("int"), F.lit(piece_chars)).alias("t"))
    by = {0: [], 1: []}
    for r in taught.orderBy("coin", "t").collect():
        by[r["y"]].append(r["t"])
    model["good"], model["bad"] = train_dictionary(by[1]), train_dictionary(by[0])
    rest = _features(texts.where(F.col("coin") % 2 == 1).select("y", "text"), model).toPandas()
    n = rest["y"].value_counts().to_dict()
    if len(n) < 2:
        return model
    weight = rest["y"].map({y: shares[y] / total / n[y] * len(rest) for y in n}).to_numpy(float)
    model["weights"] = fit_logistic(rest[["a", "b", "c"]].to_numpy(float), rest["y"].to_numpy(float), weight)
    return model


def _features(frame: DataFrame, model: dict) -> DataFrame:
    good, bad = model["good"], model["bad"]
    keep = [f for f in frame.schema if f.name != "text"]

    def run(batches):
        tools = compressors(good, bad)
        for batch in batches:
            x = [(None,) * 3 if not t else sizes_of(t.encode(), *tools) for t in batch.column("text").to_pylist()]
            cols = {f.name: batch.column(f.name) for f in keep}
            for i, name in enumerate("abc"):
                cols[name] = pa.array([v[i] for v in x], pa.float64())
            yield pa.record_batch(cols)

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return frame.transform(in_arrow, run, kinds + "a double, b double, c double")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, key (row identity) and the calibrated probability of label 1."""
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    share = F.lit(float(model["share"]))
    if model["weights"] is None:
        return rows.select("doc_id", "key", share.alias("score"))
    w = [float(x) for x in model["weights"]]
    x = _features(rows, model)
    logit = F.col("a") * w[0] + F.col("b") * w[1] + F.col("c") * w[2] + w[3]
    return x.select("doc_id", "key", F.coalesce(1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0)))), share).alias("score"))


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows whose crc32(doc_id) mod 5 is not 0; the others are held out."""
    return labels.where(crc_mod("doc_id", 5) != 0)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents (all columns) whose score reaches the threshold; one pass, no shuffle."""
    model = fit(docs, learnable(labels), **options)
    if model["weights"] is None:
        return docs if model["share"] >= threshold else docs.limit(0)
    good, bad, w, share = model["good"], model["bad"], model["weights"], model["share"]
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        tools = compressors(good, bad)
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                p = share if not t else 1 / (1 + np.exp(-np.clip(np.dot(w[:3], sizes_of(t.encode(), *tools)) + w[3], -30, 30)))
                keep.append(bool(p >= threshold))
            yield batch.filter(pa.array(keep))

    return docs.transform(in_arrow, run, docs.schema)
