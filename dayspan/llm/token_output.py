"""Operator 1: token-ID output as wavelet matrix shards.

Documents are range-sorted by doc_id; each task encodes its rows and writes
shards of about ``SHARD_TOKENS`` tokens (whole documents; memory is bounded by
a shard and the longest document) to the shared checkpoint folder. The shards
that count are those in the manifest, which is written once all tasks are
done; files of failed attempts have names of their own and are not in it.

Where white space is a hard border for the tokenizer (its normaliser and
pre-tokenizer drop it), the ids of a text are those of its words in order.
Words are then encoded by the tokenizers library, and a bounded table per
Python worker, keyed by a 64-bit word hash, keeps the ids of words already
encoded; letter case and a final '.' or ',' are taken off the key if the
tokenizer treats them apart. Other tokenizers encode whole texts.

Nulls: a null text is empty and has only the end id; a null doc_id sorts first.
Repeated rows are documents of their own, ordered by doc_id, then a hash of the
text. Empty tables give no shards; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dayspan.llm.common import U, Words, blocks, in_arrow, plain_letters, saved, shared_folder
from dayspan.llm.wavelet import WaveletFile, build, write

SHARD_TOKENS = 1 << 21
SLOT_BITS, MOST_KEPT, JOINED = 22, 3 << 23, 512


class Encoder:
    """Token ids of blocks of texts; direct-mapped table from word hash to ids."""

    def __init__(self, tokenizer_path: str, end_id: int):
        from tokenizers import Tokenizer
        self.tool = Tokenizer.from_file(tokenizer_path)
        self.levels = max(1, int(max(self.tool.get_vocab_size() - 1, end_id)).bit_length())
        self.kind = np.uint16 if self.levels <= 16 else np.uint32
        self.end_id = end_id
        added = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        # what may be taken apart before encoding, by trial
        self.by_word = (self._same("abc  def\n\tü\x0b", "abc", "def", "ü") and self._same(" 1 'x", "1", "'x")
                        and not any(c.isspace() for t in added for c in t))
        self.fold = self.by_word and self._same("ABC Abc", "abc", "abc")
        self.cut_marks = self.by_word and self._same("abc. d,", "abc", ".", "d", ",") and not any(t[-1:] in ".," for t in added)
        # a word of letters alone is one piece, and the last token of a piece shows by its suffix
        suffix = getattr(self.tool.model, "end_of_word_suffix", None) if self.by_word else None
        self.last = np.zeros(1 << self.levels, bool)
        self.last[[i for t, i in self.tool.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.guard = sorted({t.encode()[0] for t in added})  # words with such a byte may hold a special token
        self.clear()

    def _same(self, text: str, *parts: str) -> bool:
        ids = [self.tool.encode(t, add_special_tokens=False).ids for t in (text, *parts)]
        return ids[0] == list(chain.from_iterable(ids[1:]))

    def clear(self) -> None:
        self.mark = np.zeros(1 << SLOT_BITS, U)
        self.place = np.zeros(1 << SLOT_BITS, np.int32)
        self.length = np.zeros(1 << SLOT_BITS, np.int32)
        self.flat = np.zeros(1 << 16, self.kind)
        self.flat[0], self.used = self.end_id, 1

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids of each."""
        ids = [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.kind, int(lengths.sum())), lengths

    def _encode(self, words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of new words' ids, which are appended to ``flat``.

        Words of letters alone are encoded many to a string and told apart by
        their last tokens; should that not give one for each word, they go singly.
        """
        plain = np.flatnonzero(letters) if self.last.any() else np.empty(0, np.int64)
        new, ends = self._ids([" ".join([words[i] for i in plain[a: a + JOINED].tolist()]) for a in range(0, len(plain), JOINED)])
        ends = np.flatnonzero(self.last[new]) + 1
        if len(ends) != len(plain) or (len(ends) and ends[-1] != len(new)):
            plain, new, ends = plain[:0], new[:0], ends[:0]
        single = np.setdiff1d(np.arange(len(words)), plain, assume_unique=True)
        more, lengths = self._ids([words[i] for i in single.tolist()])
        new = np.concatenate([new, more])
        count = np.zeros(len(words), np.int64)
        count[plain], count[single] = np.diff(ends, prepend=0), lengths
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used: self.used + len(new)] = new
        order = np.concatenate([plain, single])
        places = np.empty(len(words), np.int64)
        places[order] = self.used + np.cumsum(count[order]) - count[order]
        self.used += len(new)
        return places, count

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), the end id after each text."""
        if not self.by_word:
            ids = [[*e.ids, self.end_id] for e in self.tool.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), self.kind), np.array([len(x) for x in ids], np.int64)
        if self.used > MOST_KEPT:
            self.clear()
        w = Words(texts, lower=self.fold, cut_marks=self.cut_marks)
        key = w.hash
        if self.fold and len(key):  # the case of a special token counts
            exact = np.unique(np.searchsorted(w.start, np.flatnonzero(np.isin(w.data, self.guard) if len(self.guard) != 1 else w.data == self.guard[0]), side="right") - 1)
            key[exact] = [xxh64_intdigest(w.data[a:b].tobytes()) for a, b in zip(w.start[exact], w.end[exact], strict=True)]
        slot = (key & U((1 << SLOT_BITS) - 1)).astype(np.int64)
        place, length = self.place[slot].astype(np.int64), self.length[slot]
        missed = np.flatnonzero((self.mark[slot] != key) | (length == 0))
        if len(missed):
            hashes, first, which = np.unique(key[missed], return_index=True, return_inverse=True)
            raw, at = w.data.tobytes(), missed[first]
            other = np.append(0, np.cumsum(~plain_letters(w.data)))
            places, lengths = self._encode([raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)],
                                           other[w.end[at]] == other[w.start[at]])
            place[missed], length[missed] = places[which], lengths[which]
            slots = (hashes & U((1 << SLOT_BITS) - 1)).astype(np.int64)
            self.mark[slots], self.place[slots], self.length[slots] = hashes, places, lengths
            # of words that met in a slot the last one stays
            lost = self.place[slots] != places
            self.mark[slots[lost]] = 0
            self.length[slots[lost]] = 0
        ends = w.first[1:]
        place, length = np.insert(place, ends, 0), np.insert(length, ends, 1)  # flat[0] is the end id
        upto = np.cumsum(length, dtype=np.int64)
        ids = self.flat.take(np.repeat(place - (upto - length), length) + np.arange(upto[-1] if len(upto) else 0))
        last = ends + np.arange(len(ends))  # place of each end id among the words
        return ids, np.diff(upto[last], prepend=0)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def drop_encoders() -> None:
    """Give back the encoders of this Python worker (a table of words takes over 100 MB), which serves later stages too."""
    _encoders.clear()


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None,
                 shard_tokens: int = SHARD_TOKENS, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Encode and write in the order of the given columns; returns the manifest:
    path, part, seq, n_docs, n_tokens, start (tokens before the shard)."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    by = [F.col(c) for c in order]
    rows = docs.select("doc_id", "text", F.struct(*by).alias("place")).repartitionByRange("place")
    rows = rows.sortWithinPartitions("place", F.xxhash64("text")).select("doc_id", "text")

    def run(batches):
        tool, part, seq = encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        ids, counts, names, held = [], [], [], 0

        def shard():
            sizes = np.concatenate(counts)
            path = f"{folder}/shard-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.wvm"
            write(path, build(np.concatenate(ids), tool.levels, np.cumsum(sizes) - sizes, names))
            return pa.record_batch({"path": [path], "part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()),
                                    "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([int(sizes.sum())], pa.int64())})

        for batch in batches:
            for block in blocks(batch):
                x, n = tool.block(block.column("text"))
                ids.append(x)
                counts.append(n)
                names.extend(block.column("doc_id").to_pylist())
                held += len(x)
                if held >= shard_tokens:
                    yield shard()
                    ids, counts, names, held, seq = [], [], [], 0, seq + 1
        if names:
            yield shard()

    manifest = saved(rows.transform(in_arrow, run, "path string, part long, seq long, n_docs long, n_tokens long"), "token-manifest")
    # tokens before a shard: totals of the parts before (a row for each task), then within the part
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (manifest.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
             .select("part", F.coalesce(F.sum("in_part").over(ahead), F.lit(0)).alias("ahead")))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))
    return saved(manifest.join(parts, "part").withColumn("start", start).drop("ahead"), "token-shards")


def read_back(manifest: DataFrame, doc_type: str = "bigint") -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32, shard path."""

    def run(batches):
        drop_encoders()
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = WaveletFile(path)
                ids = shard.decode().astype("<u4")
                ends = np.append(shard.starts[1:], shard.n)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a: 4 * b]) for a, b in zip(shard.starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": pa.array(shard.doc_ids(), kind), "start": pa.array(start + shard.starts, pa.int64()),
                                       "n_tokens": pa.array(ends - shard.starts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                                       "path": pa.array([path] * len(crc), pa.string())})

    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[doc_type]
    shards = manifest.select("path", "start")
    return (shards.repartition(max(1, min(10_000, shards.count())))
            .transform(in_arrow, run, f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long, path string"))


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, **options) -> DataFrame:
    """Write the shards and report every document as it is read back from them."""
    manifest = write_shards(docs, tokenizer_path, end_id, **options)
    return read_back(manifest, docs.schema["doc_id"].dataType.simpleString())
