"""Wavelet matrix files of token ids: one compressed file answers access, count and occurrence queries.

Layout of a file: 8 magic bytes, little-endian uint64 length of the JSON header,
the header, then the sections it names (offset and length from the section
start): ``docs`` (zstd: first token of each document, int64), ``ids`` (zstd:
JSON list of the document ids), and per plane its ``BLOCK_BITS``-bit blocks, each
zstd-compressed, with block offsets and ranks (ones before the block) in the
section ``index`` (zstd: int64). Plane 0 holds the most significant bit; below it the
tokens are stably ordered zeros first, as in a wavelet matrix.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import zstandard
from pyarrow import fs as pafs

MAGIC = b"WAVEMAT1"
BLOCK_BITS = 1 << 16


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def build(tokens: np.ndarray, levels: int, doc_starts: np.ndarray, doc_ids: list) -> bytes:
    """The file's bytes for one shard of tokens (below 2^levels)."""
    pack = zstandard.ZstdCompressor(level=1).compress
    sections, index, zeros = [], [], []
    at = 0
    x = tokens.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels):
        ones = (x & (1 << (levels - 1 - level))) != 0
        bits = np.packbits(ones, bitorder="little")
        low, high = np.compress(~ones, x), np.compress(ones, x)
        zeros.append(len(low))
        before = 0
        for i in range(0, len(bits), BLOCK_BITS // 8):
            raw = bits[i: i + BLOCK_BITS // 8]
            data = pack(raw.tobytes())
            index.append((at, len(data), before))
            before += int(np.count_nonzero(ones[i * 8: i * 8 + BLOCK_BITS]))
            sections.append(data)
            at += len(data)
        x = np.concatenate([low, high])
    places = {}
    for name, raw in (("index", np.array(index, np.int64).tobytes()), ("docs", doc_starts.astype(np.int64).tobytes()),
                      ("ids", json.dumps(doc_ids).encode())):
        data = pack(raw)
        places[name] = (at, len(data))
        sections.append(data)
        at += len(data)
    header = json.dumps({"tokens": len(tokens), "levels": levels, "zeros": zeros, "block_bits": BLOCK_BITS, **places}).encode()
    return MAGIC + struct.pack("<Q", len(header)) + header + b"".join(sections)


def write(path: str, data: bytes) -> None:
    system, name = _filesystem(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name) as out:
        out.write(data)


class WaveletFile:
    """Random access to one shard file; only the blocks a query touches are read."""

    def __init__(self, path: str):
        system, name = _filesystem(path)
        self.file = system.open_input_file(name)
        head = self.file.read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"no wavelet file: {path}")
        size = struct.unpack("<Q", head[8:])[0]
        self.meta = json.loads(self.file.read_at(size, 16))
        self.base = 16 + size
        self.n, self.levels, self.zeros = self.meta["tokens"], self.meta["levels"], self.meta["zeros"]
        self.index = np.frombuffer(self._section("index"), np.int64).reshape(self.levels, -1, 3) if self.n else None
        self.starts = np.frombuffer(self._section("docs"), np.int64)
        self._block = lru_cache(256)(self._load)

    def _section(self, name: str) -> bytes:
        at, size = self.meta[name]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(size, self.base + at))

    def doc_ids(self) -> list:
        return json.loads(self._section("ids"))

    def _load(self, level: int, block: int) -> np.ndarray:
        at, size, _ = self.index[level, block]
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(size), self.base + int(at)))
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")

    def rank1(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        if i <= 0:
            return 0
        block, inner = divmod(i, BLOCK_BITS)
        if block == self.index.shape[1]:
            block, inner = block - 1, BLOCK_BITS
        return int(self.index[level, block, 2]) + int(np.count_nonzero(self._block(level, block)[:inner]))

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane."""
        blocks = self.index.shape[1]
        ones = self.index[level, :, 2]
        before = ones if bit else np.arange(blocks) * BLOCK_BITS - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        at = np.flatnonzero(self._block(level, block) == bit)[k - int(before[block])]
        return block * BLOCK_BITS + int(at)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = int(self._block(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self.rank1(level, i)
            value = value * 2 + bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self.rank1(level, i), self.rank1(level, j)
            if token >> (self.levels - 1 - level) & 1:
                i, j = self.zeros[level] + a, self.zeros[level] + b
            else:
                i, j = i - a, j - b
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """Occurrences of a token in [i, j)."""
        j = self.n if j is None else j
        a, b = self._range(token, i, j) if self.n and i < j else (0, 0)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All tokens: planes are merged from the last one up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            ones = np.concatenate([self._load(level, b) for b in range(self.index.shape[1])])[: self.n].view(bool) if self.n else out.view(bool)[:0]
            merged, z = np.empty(self.n, kind), self.zeros[level]
            merged[np.flatnonzero(~ones)] = out[:z]  # by places: faster than by mask
            merged[np.flatnonzero(ones)] = out[z:] | kind(1 << (self.levels - 1 - level))
            out = merged
        return out
