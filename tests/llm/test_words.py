"""Word and shingle hashing against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from dayspan.llm.common import Words, blocks, window_sums

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAbBzZ \t\n\x0b\x0c\r\x1c é日", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words_are_cut_like_the_pattern(texts):
    w = Words(pa.array(texts, pa.string()), lower=False)
    raw = w.data.tobytes()
    for d, t in enumerate(texts):
        own = [raw[a:b].decode() for a, b in zip(w.start[w.first[d]: w.first[d + 1]], w.end[w.first[d]: w.first[d + 1]], strict=True)]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_equal_words_hash_equally_and_others_do_not():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcXYZé", k=rng.randrange(1, 6))) for _ in range(200)) for _ in range(20)]
    w = Words(pa.array(texts), lower=True)
    seen = {}
    flat = [x for t in texts for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()]
    for h, x in zip(w.hash.tolist(), flat, strict=True):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_depend_on_their_words_alone():
    a = Words(pa.array(["x y a b c d e f", "a b c d e", "q"]), lower=False)
    g, at = a.shingles(5)
    assert g[2] == g[4] and at.tolist() == [0, 1, 2, 3, 8, 13]
    b = Words(pa.array(["a b c d e"]), lower=False).shingles(5)[0]
    assert b[0] == g[4]
    assert Words(pa.array(["a b"]), lower=False).shingles(5)[0][0] != Words(pa.array(["a b b"]), lower=False).shingles(5)[0][0]
    assert len(window_sums(np.arange(3, dtype=np.uint64), 5)) == 0


def test_blocks_cover_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * 700_000, None, "b" * 600_000, "c" * 3_000_000, "", "d"])})
    parts = list(blocks(batch, size=1 << 20))
    assert sum(p.num_rows for p in parts) == 6 and [p.num_rows for p in parts] == [2, 1, 1, 2]
