"""Operators 3, 8 and 10 against brute force on the awkward frame."""

import hashlib
import random
import re
from collections import Counter

import pytest
from cases import as_sorted, by_row, edge_texts, frame

from dayspan.llm import chunk_dedup, ngram_join, substring_dedup


def test_substring_dedup(spark):
    rows = edge_texts()
    want = [(r[0], *b) for r, b in zip(rows, substring_dedup.brute_force([r[1] for r in rows]), strict=True)]
    out = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out]
    assert as_sorted(got) == as_sorted(want)
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("length,seed", [(6, 2), (10, 10)])
def test_substring_dedup_other_lengths(spark, length, seed):
    rows = [(i, t, None, None) for i, t in enumerate(["a b a b a b a b a b a b", "c a b a b a b d", "x y z", "b a b a b a b a q r s t u v w",
                                                      "q r s t u v w", "e q r s t u v w", None])]
    want = [(r[0], *b) for r, b in zip(rows, substring_dedup.brute_force([r[1] for r in rows], length), strict=True)]
    out = substring_dedup.remove_repeats(frame(spark, rows), length, seed).collect()
    assert as_sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out]) == as_sorted(want)


def brute_components(rows):
    sets, ids = [], [r[0] for r in rows]
    for r in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            groups[root(i)] = min(groups.get(root(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), groups.get(root(i)) if sets[i] else ids[i]) for i in range(len(rows))]


def test_jaccard_components(spark):
    rows = edge_texts()
    want = brute_components(rows)
    out = ngram_join.linked(frame(spark, rows))
    assert by_row(out, rows, "doc_id", "n_shingles", "component_id") == as_sorted(want)
    assert len({w[2] for w in want}) < len({w[0] for w in want})


def test_jaccard_group_without_a_common_center(spark):
    """A chain of edits around one text: stars leave open pairs that the second round must find."""
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(14):
        w = list(base)
        for j in range(3):
            w[(i * 8 + j * 3) % 120] = f"edit{i}-{j}"
        rows.append((i, " ".join(w), None, None))
    rows += [(50 + i, " ".join(base[:60] + [f"other{i}-{j}" for j in range(60)]), None, None) for i in range(10)]  # one passage, no links
    assert by_row(ngram_join.linked(frame(spark, rows)), rows, "doc_id", "n_shingles", "component_id") == as_sorted(brute_components(rows))


@pytest.mark.parametrize("seed", [1, 6, 9])
def test_jaccard_of_very_long_texts(spark, seed):
    """So many tokens that the low halves of different ones clash, ahead of the first common token."""
    rng = random.Random(seed)
    one = [str(rng.randrange(10**6)) for _ in range(500_000)]
    two = list(one)
    for i in rng.sample(range(500_000), 500_000 // 95):
        two[i] = f"x{i}"
    rows = [(1, " ".join(one), None, None), (2, " ".join(two), None, None)]
    assert {r.component_id for r in ngram_join.linked(frame(spark, rows)).collect()} == {1}


def test_one_document_of_each_group_stays(spark):
    rows = edge_texts()
    df = frame(spark, rows)
    out = ngram_join.deduplicated(df)
    assert out.schema == df.schema
    kept = Counter(r.doc_id for r in out.collect())
    want = Counter({r[0] for r, w in zip(rows, brute_components(rows), strict=True) if r[0] is not None and w[2] == r[0]})
    assert {k: n for k, n in kept.items() if k is not None} == want
    assert kept[None] == 1  # the empty one; the other is a copy of document 6


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(spark, digest_bytes):
    """With one-byte fingerprints different chunks clash, and the result must not change."""
    rows = edge_texts()
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    ids = {}
    for r, t in zip(rows, normal, strict=True):
        ids.setdefault(t, []).append(r[0])
    keep = {t: None if None in x else min(x) for t, x in ids.items()}
    want = [(r[0], keep[t], len(ids[t]), keep[t] == r[0], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, normal, strict=True)]
    out = chunk_dedup.exact_dedup(frame(spark, rows), digest_bytes)
    assert by_row(out, rows, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == as_sorted(want)


def test_chunks_follow_content():
    import numpy as np
    rng = np.random.default_rng(5)
    body, lead = rng.integers(32, 127, 60_000, dtype=np.uint8), rng.integers(32, 127, 333, dtype=np.uint8)

    def chunks(data):
        ends = chunk_dedup.cut_points(data, np.array([0, len(data)]))[0].tolist()
        assert ends[-1] == len(data) and all(0 < b - a <= chunk_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends, strict=False))
        return {data.tobytes()[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    alone, shifted = chunks(body), chunks(np.concatenate([lead, body]))
    assert len(alone) > 10 and len(alone & shifted) >= len(alone) - 3  # a shift changes only the first chunks
    assert chunk_dedup.cut_points(np.zeros(0, np.uint8), np.array([0, 0]))[0].tolist() == []
    assert chunk_dedup.cut_points(np.zeros(3, np.uint8), np.array([0, 3]))[0].tolist() == [3]


def test_empty_tables(spark):
    none = frame(spark, edge_texts()).limit(0)
    assert substring_dedup.remove_repeats(none).count() == 0
    assert ngram_join.linked(none).count() == 0
    assert ngram_join.deduplicated(none).count() == 0
    assert chunk_dedup.exact_dedup(none).count() == 0
