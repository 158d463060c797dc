"""Operator 6: language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1/-1; the vector of the n-gram abc is
rot2(a) * rot1(b) * c (binding permuted letter vectors), a text's vector is the
sum (bundle) of its n-grams' vectors, a language's prototype the bundle of its
training texts, and a text gets the language of the greatest cosine.

The bundle is linear, so a text's dot product with a prototype is the sum over
its n-grams of (n-gram vector . prototype). Those products are computed once
per learned n-gram from the real vectors; scoring then is one table lookup per
character, exact up to rounding. Letters are folded to lower case and mapped to
``SLOTS`` slots (a-z each their own, others by code point), everything else is
one boundary slot, runs of it count once. n-gram counts cover all training
texts and are pre-aggregated in each task.

Nulls, empty texts and texts without a letter: ``und``, score 0. Rows with a
null lang teach nothing. Without any training row every text is ``und``. Ties
go to the smaller language name. Repeated rows predict alike.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import blocks, in_arrow

SLOTS, DIM, N = 64, 2048, 3
_slots: np.ndarray | None = None


def slots() -> np.ndarray:
    """Slot of every code point: 0 for what is no letter, 1-26 for a-z, 27-63 for other letters."""
    global _slots
    if _slots is None:
        out = np.zeros(0x110000, np.uint8)
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            if unicodedata.category(ch)[0] == "L":
                low = ord(ch.lower()[0])
                out[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 7 + low // 37) % (SLOTS - 27)
        _slots = out
    return _slots


def gram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 3-grams of all texts, and the text of each. Grams of the
    boundary alone are left out, so a text has grams if it has a letter."""
    joined = "\n\n".join(t or "" for t in texts) + "\n\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t or "") + 2 for t in texts])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    s = slots()[points]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    first = np.zeros(len(s), bool)
    first[np.cumsum(lengths) - lengths] = True  # the boundary before a text's first letter
    keep |= first
    s, doc = s[keep].astype(np.int32), doc[keep]
    codes = (s[:-2] << 12) | (s[1:-1] << 6) | s[2:]
    ok = (doc[:-2] == doc[2:]) & (codes != 0)
    return codes[ok], doc[:-2][ok]


def letter_vectors(seed: int = 6) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SLOTS, DIM))


def gram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    a, b, c = codes >> 12, (codes >> 6) & 63, codes & 63
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def fit(train: DataFrame) -> dict:
    """Model from rows (text, lang): languages, prototypes, and per 3-gram code
    its product with each unit prototype (at most SLOTS^3 rows)."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in blocks(batch, size=1 << 22):
                langs = np.array(block.column("lang").to_pylist(), object)
                codes, doc = gram_codes(block.column("text").to_pylist())
                for lang in set(langs.tolist()):
                    have = total.setdefault(lang, np.zeros(SLOTS**3, np.int64))
                    have += np.bincount(codes[(langs == lang)[doc]], minlength=SLOTS**3)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "code": pa.array(at, pa.int64()),
                                   "n": pa.array(n[at], pa.int64())})

    counts = (train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
              .transform(in_arrow, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    table = counts.toPandas()  # bounded: languages x SLOTS^3
    langs = sorted(table["lang"].unique())
    codes = np.sort(table["code"].unique()).astype(np.int64)
    weights = np.zeros((len(codes), len(langs)))
    for j, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        weights[np.searchsorted(codes, own["code"].to_numpy()), j] = own["n"].to_numpy(float)
    letters = letter_vectors()
    prototypes = np.zeros((DIM, len(langs)))
    scores = np.zeros((SLOTS**3, len(langs)), np.float32)
    for i in range(0, len(codes), 4096):
        prototypes += gram_vectors(codes[i: i + 4096], letters).astype(np.float32).T @ weights[i: i + 4096]
    norms = np.linalg.norm(prototypes, axis=0)
    unit = prototypes / np.where(norms > 0, norms, 1)
    for i in range(0, len(codes), 4096):
        scores[codes[i: i + 4096]] = gram_vectors(codes[i: i + 4096], letters).astype(np.float32) @ unit
    return {"langs": langs, "scores": scores, "prototypes": prototypes}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score: the best cosine's margin over the second, as a
    share of the best (the text's own norm cancels), 0 to 1; reads text alone."""
    langs, spark = model["langs"], docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model["scores"])  # SLOTS^3 x languages floats

    def run(batches):
        table = shared.value
        for batch in batches:
            for block in blocks(batch, size=1 << 22):
                texts = block.column("text").to_pylist()
                codes, doc = gram_codes(texts)
                has = np.bincount(doc, minlength=len(texts)) > 0
                if langs:
                    dots = np.column_stack([np.bincount(doc, table[codes, j], len(texts)) for j in range(len(langs))])
                    best = dots.argmax(axis=1)
                    ordered = np.sort(dots, axis=1)
                    top = ordered[:, -1]
                    second = np.maximum(ordered[:, -2], 0) if len(langs) > 1 else np.zeros(len(texts))
                    with np.errstate(all="ignore"):
                        score = np.where(has & (top > 0), 1 - second / top, 0)
                    pred = [langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
                else:
                    pred, score = ["und"] * len(texts), np.zeros(len(texts))
                yield pa.record_batch({"doc_id": block.column("doc_id"), "lang_pred": pa.array(pred, pa.string()),
                                       "score": pa.array(np.clip(np.nan_to_num(score), 0, 1), pa.float64())})

    return docs.select("doc_id", "text").transform(in_arrow, run, f"doc_id {kind}, lang_pred string, score double")
