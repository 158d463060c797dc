"""Operator 12: periodic runs of words, by a dictionary of basic factors.

A run is a maximal stretch of words with smallest period q, at least ``least``
words and two periods long. For each power of two L the dictionary names the
factors of L words (a factor's name is the rank of the names of its halves);
factors that occur once in their document are left out, since no longer factor
around them can recur.

Two occurrences of a factor less than 2 L apart propose their distance as a
period. A run of period q with L <= q < 2 L holds such a pair at distance q,
and for L = 4 so does every run of period 1 to 7, because runs have twelve words
or more; so the levels from 4 up propose every run. Occurrences at most L / 2
apart form an arithmetic progression whose step is the factor's own period; inside it
only that step can be the smallest period of a run. Pairs of different
progressions propose arithmetic progressions of distances. Proposals are extended word by
word to both sides, and stretches found more than once keep their smallest
period.

Words are compared by 64-bit hashes first; in the stretches found, the words a
period apart are compared byte by byte, and a document with a clash is named
anew by the words themselves. Every document is a row of its own, so nothing
is shuffled, and memory is bounded by a block of about 256 KB of text or the
longest document.

Null and empty texts have no words and no runs. Repeated rows and ids each get their
result; a null doc_id is passed through; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dayspan.llm.common import Words, blocks, in_arrow

LEAST = 12
#: the first level whose factors propose periods; it covers all periods below 2 * FIRST
FIRST = 4
#: cells that an extension step compares at once
CELLS = 1 << 18


def names_of(first: np.ndarray, second: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions sorted by factor, then place; rank of each one's factor) from the names of both halves."""
    width = int(max(second.max(initial=0) + 1, 1))
    bits = int(at.max(initial=0)).bit_length()
    if (int(first.max(initial=0)) + 1) * width < 1 << (62 - bits):  # one sort of packed numbers
        packed = np.sort(((first * width + second) << bits) | at)
        key, at = packed >> bits, packed & ((1 << bits) - 1)
    else:
        order = np.lexsort((at, second, first))
        key, at = first[order] * width + second[order], at[order]
    return at, np.append(0, np.cumsum(key[1:] != key[:-1])) if len(key) else key


def reach(x: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """For each pair the number of steps (1 or -1) over which x[i], x[j] stay equal, at most ``limit``."""
    done = np.zeros(len(i), np.int64)
    active, width = np.flatnonzero(limit > 0), 16
    while len(active):
        still = []
        for part in np.array_split(active, -(-len(active) * width // CELLS)):
            t = done[part, None] + np.arange(width)
            inside = t < limit[part, None]
            t = np.where(inside, t, 0) * step
            same = inside & (x[i[part, None] + t] == x[j[part, None] + t])
            stop = np.where(same.all(1), width, same.argmin(1))
            done[part] += stop
            still.append(part[stop == width])
        active, width = np.concatenate(still), min(width * 2, CELLS)
    return done


def pairs(at: np.ndarray, name: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) proposed by the occurrences of factors of ``size`` words."""
    if len(at) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gap = np.diff(at)
    same = (name[1:] == name[:-1]) & (doc[at[1:]] == doc[at[:-1]])
    # progressions: first and last occurrence, step
    cut = np.flatnonzero(~(same & (gap <= size // 2)))
    begin, end = np.append(0, cut + 1), np.append(cut, len(at) - 1)
    first, last, count = at[begin], at[end], end - begin + 1
    step = np.where(count > 1, gap[np.minimum(begin, len(gap) - 1)], 0)
    least, most = (1, 2 * size) if size == FIRST else (size, 2 * size)
    places, periods = [at[:0]], [at[:0]]
    if size == FIRST:
        many = count > 1
        places.append(first[many])
        periods.append(step[many])
    one = np.flatnonzero((name[begin[1:]] == name[begin[:-1]]) & (doc[first[1:]] == doc[first[:-1]]) & (first[1:] - last[:-1] < most))
    ahead = 1
    while len(one):
        other = one + ahead
        d = np.maximum(step[one], step[other])
        n = count[one] + count[other] - 1
        n = np.where(d > 0, np.minimum(n, (most - 1 - (first[other] - last[one])) // np.maximum(d, 1) + 1), 1)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        d, forward = np.repeat(d, n), np.repeat(count[other], n) - 1
        period = np.repeat(first[other] - last[one], n) + k * d
        place = np.repeat(last[one], n) - np.maximum(k - forward, 0) * d
        keep = period >= least
        places.append(place[keep])
        periods.append(period[keep])
        ahead += 1
        one = one[one + ahead < len(begin)]
        other = one + ahead
        one = one[(name[begin[other]] == name[begin[one]]) & (doc[first[other]] == doc[first[one]]) & (first[other] - last[one] < most)]
    return np.concatenate(places), np.concatenate(periods)


def stretches(x: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, period) of every run of the documents ``first[d] .. first[d + 1]`` of word names ``x``,
    by begin, then period."""
    n = len(x)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, stop = first[:-1][doc] if n else x, first[1:][doc] if n else x
    name = np.full(n, -1, np.int64)
    at, rank = names_of(np.zeros(n, np.int64), x, np.arange(n))
    found, size = [], 1
    while len(at):
        # factors that occur again in their document
        again = (rank[1:] == rank[:-1]) & (doc[at[1:]] == doc[at[:-1]])
        again = np.append(again, False) | np.append(False, again)
        at, rank = at[again], rank[again]
        if size >= FIRST:
            place, period = pairs(at, rank, doc, size)
            if len(place):
                # neighbours with one period extend to the same stretch
                key = np.unique(period * n + place)
                key = key[np.append(True, key[1:] != key[:-1] + 1)]
                period, place = key // n, key % n
                left = reach(x, place - 1, place - 1 + period, place - begin[place], -1)
                right = reach(x, place + size, place + size + period, stop[place] - place - size - period, 1)
                a, b = place - left, place + size + right + period
                long = b - a >= np.maximum(least, 2 * period)
                found.append(np.stack([a[long], b[long], period[long]]))
        name[:] = -1
        name[at] = rank
        at = np.sort(at)
        at = at[at + 2 * size <= stop[at]]
        at = at[name[at + size] >= 0]
        at, rank = names_of(name[at], name[at + size], at)
        size *= 2
    a, b, q = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((q, b, a))
    a, b, q = a[order], b[order], q[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, bool)
    a, b, q = a[new], b[new], q[new]
    order = np.lexsort((q, a))
    return a[order], b[order], q[order]


def clashes(words: Words, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bool:
    """Whether words of equal hash, a period apart in some run, differ in their bytes."""
    for a, b, q in zip(*(r.tolist() for r in runs), strict=True):
        for at in range(a, b - q, CELLS):
            one = np.arange(at, min(at + CELLS, b - q))
            size = words.end[one] - words.start[one]
            if (size != words.end[one + q] - words.start[one + q]).any():
                return True
            move = np.repeat(words.start[one + q] - words.start[one], size)
            byte = np.repeat(words.start[one] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            if (words.data[byte] != words.data[byte + move]).any():
                return True
    return False


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    kept = np.flatnonzero(keep)
    first = np.searchsorted(kept, words.first)
    size = words.end[kept] - words.start[kept] + 1
    filled = np.flatnonzero(np.diff(first))
    size[first[1:][filled] - 1] -= 1  # no space after the last word
    upto = np.append(0, np.cumsum(size))
    at = np.repeat(words.start[kept] - upto[:-1], size) + np.arange(upto[-1])
    out = words.data.take(at, mode="clip") if upto[-1] else np.empty(0, np.uint8)
    inner = np.ones(len(kept), bool)
    inner[first[1:][filled] - 1] = False
    out[upto[1:][inner] - 1] = 32
    offsets = upto[first]
    return pa.LargeStringArray.from_buffers(len(words.first) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def runs_of(texts: pa.Array, least: int = LEAST) -> tuple[Words, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    words = Words(texts, lower=False)
    x = np.unique(words.hash, return_inverse=True)[1].astype(np.int64)
    runs = stretches(x, words.first, least)
    if clashes(words, runs):
        raw = words.data.tobytes()
        ids: dict[bytes, int] = {}
        x = np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)], np.int64)
        runs = stretches(x, words.first, least)
    return words, runs


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, least: int = LEAST, prepare: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (array of start, length, period; words
    from 0; by start, then period) and collapsed (the words that no run holds
    after its first period, joined by one space). ``prepare`` may change a batch (doc_id, text) before it is read."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for block in blocks(prepare(batch) if prepare else batch):
                words, (a, b, q) = runs_of(block.column("text"), least)
                change = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(change, a + q, 1)
                np.add.at(change, b, -1)
                cuts = np.searchsorted(a, words.first)
                start = a - np.repeat(words.first[:-1], np.diff(cuts))
                rows = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, b - a, q)], fields=list(RUN))
                yield pa.record_batch({
                    "doc_id": block.column("doc_id"), "n_words": pa.array(np.diff(words.first), pa.int64()),
                    "runs": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows),
                    "collapsed": joined(words, np.cumsum(change)[:-1] == 0)})

    return docs.select("doc_id", "text").transform(
        in_arrow, run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
