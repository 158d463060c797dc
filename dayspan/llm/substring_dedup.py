"""Operator 3: substring dedup by seed and extend.

Every window of ``length`` words has one anchor: the seed (``SEED`` words) of
least hash in it, leftmost on ties. The anchor depends on the window's words
alone, so equal windows have equal anchors, and windows whose anchor occurs
once cannot repeat. Consecutive windows with one anchor are a run: the seed
with everything to its left and right that its windows reach.

1. Seeds: anchors are counted; those that occur once are dropped (an exact
   count, handed to the next scan as a Bloom filter of at most 2^28 bits).
2. Extend: runs of repeated seeds are compared as a whole. Runs equal to
   another one are repeats from end to end.
3. Where a seed has runs that differ (at the ends of a repeat), their windows
   are compared one by one.
4. Maximal repeats are the unions of the covered words; they are removed.

No pairs are formed and no group is gathered: counts are pre-aggregated, and
the answers come back by joins whose hot keys Spark can split. Runs that a task
has already sent are not sent again.

Nulls and empty texts have no words; texts below ``length`` words stay whole.
Rows that repeat id and text are two occurrences and lose all windows. Texts of
any length are one document; empty tables and extra columns are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import MOST_SEEN, Bloom, U, Words, blocks, deal_bits, in_arrow, key_of, mix, repeated_keys, row_key, saved, window_sums

LENGTH, SEED = 35, 8
_AT = U((1 << 30) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have:]) if width > have else x


class Runs:
    """The runs of a block: text, seed hash, digest, first window and number of windows (word positions in the text)."""

    def __init__(self, words: Words, length: int, seed: int):
        n = len(words.hash)
        self.window = window_sums(words.hash, length)
        seeds = window_sums(words.hash, seed)
        at = np.arange(len(self.window))
        doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[: len(at)]
        at = at[at + length <= words.first[doc + 1]] if n >= length else at
        if not len(at):
            self.doc = self.first = self.count = self.start = np.empty(0, np.int64)
            self.seed = self.digest = np.empty(0, U)
            return
        least = sliding_min((seeds & ~_AT) | np.arange(len(seeds), dtype=U), length - seed + 1)
        anchor = (least[at] & _AT).astype(np.int64)
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
        self.start = at[new]  # in the block
        last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
        self.count = last - self.start + 1
        self.doc = doc[self.start]
        self.first = self.start - words.first[self.doc]
        self.seed = seeds[anchor[new]]
        self.digest = mix(self.window[self.start] * U(0x9FB21C651E98DF25) + self.window[last] * U(0xD1342543DE82EF95) + self.count.astype(U))


def _runs(batches, length: int, seed: int) -> Iterator[tuple[pa.RecordBatch, Runs]]:
    for batch in batches:
        for block in blocks(batch):
            yield block, Runs(Words(block.column("text"), lower=False), length, seed)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """key (row identity) and ``spans``: the removed word ranges [from, to), not merged."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(row_key().alias("key"), "text")

    bits = deal_bits(docs.sparkSession)

    def seeds(block):
        return Runs(Words(block.column("text"), lower=False), length, seed).seed

    known = sc.broadcast(Bloom(saved(repeated_keys(docs, seeds), "repeated-seeds").select("key")))

    def found(batches):
        for block, runs in _runs(batches, length, seed):
            at = np.flatnonzero(known.value.has(key_of(runs.seed, bits)))
            key = block.column("key").to_numpy(zero_copy_only=False)
            yield pa.record_batch({"key": _longs(key[runs.doc[at]]), "seed": _longs(runs.seed[at]), "digest": _longs(runs.digest[at]),
                                   "first": _longs(runs.first[at]), "windows": _longs(runs.count[at])})

    seen = saved(texts.transform(in_arrow, found, "key long, seed long, digest long, first long, windows long"), "seed-runs")
    known.destroy()  # the workers need not keep it
    equal = saved(seen.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d")), "equal-runs")
    whole = (seen.join(equal, F.col("digest") == F.col("d"))
             .select("key", F.col("first").alias("from"), (F.col("first") + F.col("windows") + (length - 1)).alias("to")))

    mixed = (seen.groupBy("seed").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where(F.col("lo") < F.col("hi")).select("seed"))
    open_seeds = sc.broadcast(Bloom(saved(mixed, "open-seeds")))

    def windows(batches):
        sent: set[int] = set()
        for block, runs in _runs(batches, length, seed):
            at = np.flatnonzero(open_seeds.value.has(runs.seed))
            digests = runs.digest[at].tolist()
            fresh = []
            for i, d in enumerate(digests):
                if d not in sent:
                    fresh.append(i)
                    if len(sent) < MOST_SEEN:
                        sent.add(d)
            at = at[fresh]
            offsets = np.append(0, np.cumsum(runs.count[at]))
            places = np.repeat(runs.start[at] - offsets[:-1], runs.count[at]) + np.arange(offsets[-1])
            key = block.column("key").to_numpy(zero_copy_only=False)
            own = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _longs(runs.window[places]))
            yield pa.record_batch({"key": _longs(key[runs.doc[at]]), "first": _longs(runs.first[at]), "hashes": own})

    single = saved(texts.transform(in_arrow, windows, "key long, first long, hashes array<long>"), "open-runs")
    open_seeds.destroy()
    twice = (single.select(F.explode("hashes").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w"))
    twice = saved(twice, "equal-windows")
    parts = (single.select("key", "first", F.posexplode("hashes").alias("i", "hash")).join(twice, F.col("hash") == F.col("w"))
             .select("key", (F.col("first") + F.col("i")).alias("from"), (F.col("first") + F.col("i") + length).alias("to")))
    spans = whole.unionByName(parts).distinct()
    return spans.groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def cover(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n words lie in a span."""
    change = np.zeros(n + 1, np.int64)
    for s in spans or ():
        change[s["from"]] += 1
        change[s["to"]] -= 1
    return np.cumsum(change)[:n] > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    marks = saved(repeats(docs, length, seed), "repeat-spans").withColumnRenamed("key", "marked")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for block in blocks(batch):
                n_words, n_removed, kept = [], [], []
                spans = block.column("spans")
                for i, text in enumerate(block.column("text").to_pylist()):
                    words = (text or "").encode().split()
                    out = cover(len(words), spans[i].as_py()) if spans[i].is_valid else None
                    n_words.append(len(words))
                    n_removed.append(0 if out is None else int(out.sum()))
                    kept.append(b" ".join(words if out is None else compress(words, ~out)).decode())
                yield pa.record_batch({"doc_id": block.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                                       "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    rows = docs.select("doc_id", row_key().alias("key"), "text").join(marks, F.col("key") == F.col("marked"), "left")
    return rows.select("doc_id", "text", "spans").transform(in_arrow, run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) by counting every window, for tests."""
    from collections import Counter
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i: i + length]) for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[tuple(d[i: i + length])] > 1:
                gone[i: i + length] = [True] * length
        out.append((len(d), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out
