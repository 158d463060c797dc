"""Operator 8: exact dedup by content-defined chunk recipes.

A normalised text is cut where a rolling hash of its last ``GRAM`` bytes hits a
pattern, so equal passages give equal chunks wherever they stand. Equal chunks
get one verified identifier: chunks are compared by content, and only then is
their 128-bit fingerprint the identifier. A document becomes its recipe, the
ordered list of identifiers; documents are equal when their recipes are equal.
Only distinct chunks move as text (pre-aggregated before the shuffle); the
document comparison moves recipes, 16 bytes a chunk.

Nulls and empty texts: the empty recipe, all equal to each other. A null doc_id
sorts before every number, so it is kept. Repeated rows of one doc_id: the id
stays and each row is reported. Very long texts are cut like others; a run
without a cut point ends at ``MAX_CHUNK`` bytes. Empty tables and extra columns
are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import SPACES, blocks, in_arrow, saved

GRAM = 16
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 256, 2048, 16384
_TABLE = np.random.default_rng(8).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64)


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text the ends of its chunks. The rolling hash covers the whole block
    at once; cuts closer than MIN_CHUNK to the last one are passed over."""
    n = len(data)
    values = _TABLE[data]
    rolling = np.zeros(n, np.uint64)
    for i in range(GRAM if n >= GRAM else 0):  # gear hash: older bytes are shifted further
        rolling[GRAM - 1:] += values[GRAM - 1 - i: n - i] << np.uint64(i)
    mask = np.uint64((MEAN_CHUNK - 1) << (GRAM - 11))
    hits = np.flatnonzero((rolling & mask) == 0) + 1  # ends of the grams; the first GRAM - 1 bytes have none
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = hits[np.searchsorted(hits, a + GRAM): np.searchsorted(hits, b)]
        ends, last = [], a
        for h in own.tolist():
            if h - last >= MIN_CHUNK:
                while h - last > MAX_CHUNK:
                    last += MAX_CHUNK
                    ends.append(last - a)
                if h > last:
                    ends.append(h - a)
                last = h
        while b - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last - a)
        if b > last:
            ends.append(b - a)
        out.append(np.array(ends, np.int64))
    return out


def fingerprint(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        for block in blocks(batch, "normal"):
            texts = block.column("normal").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            whole = raw.to_pybytes()[offsets[0]: offsets[-1]] if raw is not None else b""
            offsets = offsets - offsets[0]
            ends = cut_points(np.frombuffer(whole, np.uint8), offsets)
            yield block, [[whole[a + x: a + y] for x, y in pairwise([0, *e.tolist()])]
                          for a, e in zip(offsets[:-1].tolist(), ends, strict=True)]


def normalised(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.regexp_replace(text, SPACES, " ").alias("normal"))


def chunk_table(normal: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """Distinct chunks (mark, chunk): repeats go within each task first, then globally."""

    def run(batches):
        for _, pieces in _pieces(batches):
            own = {c for p in pieces for c in p}
            yield pa.record_batch({"mark": pa.array([fingerprint(c, digest_bytes) for c in own], pa.binary()),
                                   "chunk": pa.array(list(own), pa.binary())})

    return normal.transform(in_arrow, run, "mark binary, chunk binary").groupBy("mark", "chunk").agg(F.count(F.lit(1)).alias("seen"))


def recipes(normal: DataFrame, digest_bytes: int = 16, chunks: bool = False) -> DataFrame:
    """Per row its recipe of fingerprints (with ``chunks``, the chunk texts themselves) and the text's sha256."""

    def run(batches):
        for block, pieces in _pieces(batches):
            sha = [hashlib.sha256(b"".join(p)).hexdigest() for p in pieces]
            lists = [p if chunks else [fingerprint(c, digest_bytes) for c in p] for p in pieces]
            yield pa.record_batch({"doc_id": block.column("doc_id"), "recipe": pa.array(lists, pa.list_(pa.binary())),
                                   "text_sha256": pa.array(sha, pa.string())})

    kind = normal.schema["doc_id"].dataType.simpleString()
    return normal.transform(in_arrow, run, f"doc_id {kind}, recipe array<binary>, text_sha256 string")


def exact_dedup(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Chunk fingerprints are verified against the contents of all chunks. Should
    two different chunks share one, their identifiers become the contents
    themselves, so equal recipes always mean equal texts.
    """
    normal = normalised(docs)
    marks = chunk_table(normal, digest_bytes).groupBy("mark").agg(F.count(F.lit(1)).alias("contents"))
    clash = not marks.where(F.col("contents") > 1).isEmpty()
    rows = saved(recipes(normal, digest_bytes, chunks=clash), "recipes")
    groups = saved(rows.groupBy("recipe").agg(F.min("doc_id").alias("least"), F.count("doc_id").alias("ids"),
                                              F.count(F.lit(1)).alias("group_size"))
                   .where(F.col("group_size") > 1)
                   .select(F.col("recipe").alias("r"), "group_size",
                           F.when(F.col("ids") == F.col("group_size"), F.col("least")).alias("keep")), "copy-groups")
    out = rows.join(groups, F.col("recipe") == F.col("r"), "left")
    keep = F.when(F.col("r").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
