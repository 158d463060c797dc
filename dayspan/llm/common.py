"""Shared helpers of the training-data operators: tables, stage boundaries, word and shingle hashes.

Word hashing works on whole Arrow blocks with numpy: a polynomial hash over the
UTF-8 bytes (mod 2^64, byte values replaced by random 64-bit numbers), cut at
``[\\x20\\x09-\\x0D]`` and finished with a 64-bit mixer. Blocks hold about 256 KB
of text, so that their arrays stay in the cache (a longer document is a block of
its own); memory is bounded by the block or the longest document, never by a
partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.sources.tables import materialize

BLOCK_BYTES = 1 << 18
BATCH_ROWS = 1000
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTES = _rng.integers(1, 2**64, 256, dtype=U) | U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: odd bases of the two polynomial hashes, and their inverses modulo 2^64
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows, so that a task holds
    a few MB of text at a time (for ``DataFrame.transform``)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def trimmed(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(trimmed, schema)


def saved(df: DataFrame, name: str) -> DataFrame:
    """A stage boundary: written as Parquet to the shared checkpoint folder and read back."""
    return materialize(df, f"llm-{name}")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a row by content. Rows that repeat both id and text share it, and share every result."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; tables up to 2^22 entries are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def window_sums(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every ``width`` consecutive values (positions 0 .. n - width)."""
    n = len(values)
    if n < width:
        return np.empty(0, U)
    total = np.concatenate([np.zeros(1, U), np.cumsum(values * powers(_Q, n))])
    return mix((total[width:] - total[:-width]) * powers(pow(_Q, -1, 2**64), n)[: n - width + 1])


class Words:
    """Words of a block of texts: ``hash`` per word, ``start``/``end`` byte
    offsets into ``data``, and ``first[d] .. first[d + 1]`` the words of text d.
    With ``cut_marks`` a final '.' or ',' after a plain letter is a word of its own."""

    def __init__(self, texts: pa.Array, lower: bool, cut_marks: bool = False):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]: offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data, n = data, len(data)
        inside = (data != 32) & ((data < 9) | (data > 13))
        # a document border cuts words too
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        border = offsets[:-1][offsets[:-1] < n]
        before[border] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        if cut_marks and len(self.end):
            mark = data[self.end - 1]
            cut = np.flatnonzero(((mark == 46) | (mark == 44)) & (self.end - self.start > 1))
            cut = cut[plain_letters(data)[self.end[cut] - 2]]
            ends = self.end[cut]
            self.end[cut] -= 1
            self.start, self.end = np.insert(self.start, cut + 1, ends - 1), np.insert(self.end, cut + 1, ends)
        table = _BYTES[_LOWER] if lower else _BYTES
        total = np.concatenate([np.zeros(1, U), np.cumsum(table.take(data) * powers(_P, n))]) if n else np.zeros(1, U)
        inverse = powers(pow(_P, -1, 2**64), max(n, 1))
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start]) if n else np.empty(0, U)
        self.first = np.searchsorted(self.start, offsets)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and word position of every shingle; a text of 1 to width - 1
        words has one shingle, its whole word sequence."""
        counts = np.diff(self.first)
        all_at = window_sums(self.hash, width)
        at = np.arange(len(all_at))
        doc = np.searchsorted(self.first, at, side="right") - 1
        keep = at + width <= self.first[doc + 1]
        hashes, at = all_at[keep], at[keep]
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            extra = np.array([whole_hash(self.hash[self.first[d]: self.first[d + 1]]) for d in short], U)
            at = np.concatenate([at, self.first[short]])
            hashes = np.concatenate([hashes, extra])
            order = np.argsort(at, kind="stable")
            at, hashes = at[order], hashes[order]
        return hashes, at


def plain_letters(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to an ASCII letter or to a letter from U+00C0 to U+00FF."""
    low = data | 32
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # two signs are among them
    return ((low >= 97) & (low <= 122)) | (data == 0xC3) | second


def whole_hash(words: np.ndarray) -> np.uint64:
    """Hash of a word sequence shorter than a shingle; its length counts too."""
    n = len(words)
    with np.errstate(over="ignore"):
        return mix(np.array([np.sum(words * powers(_Q, n)) + U(n) * U(0xD6E8FEB86659FD93)], U))[0]


def blocks(batch: pa.RecordBatch, column: str | int = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` (``BLOCK_BYTES``) bytes of text each."""
    size = size or BLOCK_BYTES
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def repeated_keys(docs: DataFrame, tokens: Callable[[pa.RecordBatch], np.ndarray], columns: Sequence[str] = ("text",)) -> DataFrame:
    """(key, n): keys (``key_of``) of the 64-bit tokens that ``tokens(block)``
    yields more than once over all blocks, with their number.

    Tokens are dealt out by their high bits as packed arrays of four bytes a
    token, so the shuffle moves a few large rows. A task sends a token once for
    each ``HELD`` tokens it has seen, with a count, however often it occurs.
    """
    buckets = deal_bits(docs.sparkSession)

    def send(batches):
        held: list[np.ndarray] = []

        def flush():
            keys, n = np.unique(key_of(np.concatenate(held), buckets), return_counts=True)
            more = n > 1
            edges = np.arange((1 << buckets) + 1, dtype=U) << U(32)
            cut, cut2 = np.searchsorted(keys, edges), np.searchsorted(keys[more], edges)
            at = np.flatnonzero(np.diff(cut)).tolist()
            low, low2, extra = keys.astype(np.uint32), keys[more].astype(np.uint32), (n[more] - 1).astype(np.uint32)
            return pa.record_batch({"bucket": pa.array(at, pa.int32()), "low": pa.array([low[cut[b]: cut[b + 1]].tobytes() for b in at], pa.binary()),
                                    "again": pa.array([low2[cut2[b]: cut2[b + 1]].tobytes() for b in at], pa.binary()),
                                    "extra": pa.array([extra[cut2[b]: cut2[b + 1]].tobytes() for b in at], pa.binary())})

        for batch in batches:
            for block in blocks(batch):
                held.append(tokens(block))
                if sum(map(len, held)) >= HELD:
                    yield flush()
                    held = []
        if held and sum(map(len, held)):
            yield flush()

    def meet(batches):
        got: dict[int, list[list[bytes]]] = {}
        for batch in batches:
            for bucket, *parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for have, x in zip(got.setdefault(bucket, [[], [], []]), parts, strict=True):
                    have.append(x)
        for bucket in list(got):
            low, again, extra = (np.frombuffer(b"".join(x), np.uint32) for x in got.pop(bucket))
            low = np.sort(low)
            first = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.empty(0, np.int64)
            keys, n = low[first], np.diff(np.append(first, len(low)))
            np.add.at(n, np.searchsorted(keys, again), extra.astype(np.int64))
            more = n > 1
            yield pa.record_batch({"key": pa.array(keys[more].astype(np.int64) | (bucket << 32)), "n": pa.array(n[more].astype(np.int64))})

    dealt = docs.select(*columns).transform(in_arrow, send, "bucket int, low binary, again binary, extra binary")
    return dealt.repartition("bucket").transform(in_arrow, meet, "key long, n long")


HELD = 1 << 20
#: hashes that a task remembers having sent, only to save repeats
MOST_SEEN = 100_000


def deal_bits(spark: SparkSession) -> int:
    """Bits of the bucket number: eight buckets, or more, for each shuffle partition."""
    return min(24, (8 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def key_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bucket (high bits) and four low bytes of a token; tokens that share them count as one."""
    return ((tokens >> U(64 - bits)) << U(32)) | (tokens & U(0xFFFFFFFF))


class Bloom:
    """Bloom filter, two bits a key, of a column of longs: an OR per 64-bit
    word, formed in Spark, so at most 2^most_bits bits reach the driver."""

    def __init__(self, keys: DataFrame, most_bits: int = 28):
        n = max(1, keys.count())
        bits = self.bits = min(most_bits, max(16, (16 * n - 1).bit_length()))

        def run(batches):
            for batch in batches:
                at = np.concatenate(bit_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U), bits))
                at.sort()
                word, first = np.unique(at >> U(6), return_index=True)
                values = np.bitwise_or.reduceat(U(1) << (at & U(63)), first) if len(at) else at
                yield pa.record_batch({"word": pa.array(word.astype(np.int64)), "bits": pa.array(values.view(np.int64))})

        rows = keys.transform(in_arrow, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.words = np.zeros(1 << (bits - 6), U)
        if rows.num_rows:
            self.words[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(U)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in bit_places(keys, self.bits):
            found &= (self.words[at >> U(6)] >> (at & U(63)) & U(1)).astype(bool)
        return found


def bit_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(keys)
    return [h >> U(64 - bits), h & U((1 << bits) - 1)]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (not yet created)."""
    import uuid

    from dayspan.session import scratch_path
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
