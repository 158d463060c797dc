"""Periodic runs against a plain search of every period, on small random and built texts."""

import random
import re

import pyarrow as pa
import pytest

from cases import by_row, as_sorted, edge_texts, frame
from dayspan.llm import periodic_runs as pr


def brute(w, least=12):
    """(start, length, period) by comparing every word with the one q ahead, for every q."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - a >= max(least, 2 * q):
                found.setdefault((a, i + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapse(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    for _ in range(n):
        a, b = b, b + a
    return list(b)


def made(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(0, 120))]
    if kind == 1:
        return fibonacci(rng.randrange(3, 10))
    if kind == 2:  # the periods of one centre form a progression
        u = [rng.choice("ab") for _ in range(rng.randrange(1, 6))]
        a, b = u * rng.randrange(2, 15) + u[:1], u * rng.randrange(2, 15)
        return rng.choice([a + a, a + b + a, a + ["c"] + a + ["c"] + b + ["c"] + a, b + a + a + b])
    if kind == 3:
        w = [rng.choice("abcdefghij") for _ in range(rng.randrange(5, 60))]
        return (w * rng.randrange(1, 5))[:rng.randrange(1, 200)]
    if kind == 4:
        return (["x"] * rng.randrange(0, 40) + ["y"]) * rng.randrange(1, 4)
    w = [rng.choice("ab") for _ in range(rng.randrange(5, 40))]
    for _ in range(3):
        w = w + w if rng.random() < .5 else w + [rng.choice("abc")] + w
    return w[:300]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        docs = [made(rng) for _ in range(15)]
        words, (a, b, q) = pr.runs_of(pa.array([" ".join(d) for d in docs]))
        for d, w in enumerate(docs):
            first, end = words.first[d], words.first[d + 1]
            mine = (a >= first) & (a < end)
            got = list(zip((a[mine] - first).tolist(), (b - a)[mine].tolist(), q[mine].tolist(), strict=True))
            assert got == brute(w), w


def test_least_length_is_a_parameter():
    w = "p q r s p q r s p q r s p q r s tail".split()
    for least in (12, 16, 17):
        _, (a, b, q) = pr.runs_of(pa.array([" ".join(w)]), least)
        assert list(zip(a, b - a, q, strict=True)) == brute(w, least)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    """With a hash that sees the length only, the bytes decide."""
    rng = random.Random(5)
    docs = [made(rng) for _ in range(20)]

    class Weak(pr.Words):
        def __init__(self, *args, **kw):
            super().__init__(*args, **kw)
            self.hash = (self.end - self.start).astype(self.hash.dtype)

    monkeypatch.setattr(pr, "Words", Weak)
    words, (a, b, q) = pr.runs_of(pa.array([" ".join(d) for d in docs]))
    want = [(words.first[d] + s, n, p) for d, w in enumerate(docs) for s, n, p in brute(w)]
    assert sorted(zip(a.tolist(), (b - a).tolist(), q.tolist(), strict=True)) == sorted(want)


def test_edge_rows(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(50)}" for _ in range(40_000)]
    rows = edge_texts()
    rows += [(500, "one two three " * 400, "en", "s1"), (501, " ".join(long + long), "en", "s1"),
             (502, "\t".join(["日本", "語 "] * 9), None, None), (503, " ".join(fibonacci(12)), "en", "s1")] * 2
    out = pr.periodic_runs(frame(spark, rows))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute(w) if len(w) < 5000 else None
        if doc_id == 501:
            runs = [(0, 80_000, 40_000)]
        if doc_id == 307:  # random words of a large vocabulary
            runs = []
        want.append((doc_id, len(w), [tuple(r) for r in runs], collapse(w, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert as_sorted((t[0], t[1], str(t[2]), t[3]) for t in got) == as_sorted((t[0], t[1], str(t[2]), t[3]) for t in want)


def test_empty_table(spark):
    assert by_row(pr.periodic_runs(frame(spark, [])), [], "doc_id") == []


def test_string_ids(spark):
    df = spark.createDataFrame([("a", "x y " * 8), (None, None)], "doc_id string, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in pr.periodic_runs(df).collect()}
    assert got == {"a": [(0, 16, 2)], None: []}
