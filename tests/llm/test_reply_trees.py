"""Reply trees against plain recursion, and the template's round trip."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dayspan.llm import reply_trees as rt

SCHEMA = "tree long, id long, parent long, role string, text string, score double, depth string, branch string"
NASTY = ["", None, "\\", "\\\\<turn ", "<turn user>\nhi\n</turn>\n", "</turn>", "\\</turn>", "<turn", "a\n</turn>\nb", "é👍\\", "### Assistant: </turn> ok",
         "<<turn <turn </turn></turn>", "\n", "x" * 3000]


def plain(messages, top):
    """{(tree, branch): messages of the path} of the branches chosen by mean score, then leaf."""
    first = {}
    for m in messages:
        key = (m[0], m[1])
        first[key] = min(first.get(key, m), m, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r[2:6]))
    kids = {(m[0], m[2]) for m in first.values() if m[2] is not None}
    paths = {}
    for key, m in first.items():
        if key in kids:
            continue
        path, seen = [], set()
        while True:
            if (m[0], m[1]) in seen:
                path = None
                break
            seen.add((m[0], m[1]))
            path.append(m)
            up = first.get((m[0], m[2])) if m[2] is not None else None
            if not up:
                break
            m = up
        if path:
            paths.setdefault(key[0], []).append((-sum(p[5] or 0.0 for p in path) / len(path), key[1], path[::-1]))
    return {(tree, n + 1): p for tree, ps in paths.items() for n, (_, _, p) in enumerate(sorted(ps, key=lambda x: x[:2])[:top])}


def digests(path):
    whole = "".join(f"{m[3] or ''}\n{m[4] or ''}\n" for m in path)
    loss = "".join(m[4] or "" for m in path if m[3] == "assistant")
    return len(path), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check(spark, messages, top=2, piece_chars=rt.PIECE_CHARS):
    df = spark.createDataFrame([(*m, "x", "y") for m in messages], SCHEMA)
    pieces = rt.saved(rt.formatted(df, top=top, piece_chars=piece_chars), "test-pieces")
    got = {(r.tree, r.branch): (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rt.read_back(pieces).collect()}
    assert got == {k: digests(p) for k, p in plain(messages, top).items()}
    return pieces


def forest(rng, trees, most):
    out = []
    for t in range(trees):
        n = rng.randrange(1, most)
        for i in range(n):
            up = None if i == 0 else rng.randrange(max(0, i - 3), i)
            out.append((t, i, up, rng.choice(["user", "assistant", "system", "<x>\\"]), rng.choice(NASTY), rng.choice([None, .5, 1.0, -2.0])))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    check(spark, forest(rng, 25, 30), top=3, piece_chars=[rt.PIECE_CHARS, 50][seed])


def test_edge_rows(spark):
    rows = [(None, 1, None, "user", "null tree", 1.0), (None, 2, 1, "assistant", "a", 1.0),
            (1, None, 5, "user", "null id", 1.0), (1, 5, None, None, None, None),
            (2, 1, 99, "user", "parent not there", 1.0), (2, 2, 1, "assistant", "", 3.0),
            (3, 1, 2, "user", "circle", 1.0), (3, 2, 1, "user", "circle", 1.0), (3, 3, 2, "assistant", "below it", 1.0),
            (4, 1, 1, "user", "own parent", 1.0), (5, 1, None, "user", "repeat", 1.0), (5, 1, None, "user", "repeat", 1.0),
            (6, 1, None, "user", "tie", 1.0), (6, 2, 1, "assistant", "b", 1.0), (6, 3, 1, "assistant", "c", 1.0)]
    check(spark, rows, top=1)
    df = spark.createDataFrame([(*m, "x", "y") for m in rows], SCHEMA)
    circular = {(r.tree, r.id) for r in rt.Trees(rt.one_row_each(df)).circular.collect()}
    assert circular == {(3, 1), (3, 2), (3, 3), (4, 1)}


def test_empty_table(spark):
    check(spark, [])


def test_a_long_chain_takes_few_joins_and_bounded_pieces(spark):
    n = 700
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"text {i} </turn>", None) for i in range(n)]
    rows += [(2, i, 0 if i else None, "user", "star", float(i)) for i in range(300)]
    pieces = check(spark, rows, top=1, piece_chars=1000)
    assert pieces.where("tree = 1").count() > 20
    assert pieces.agg(F.max(F.length("text"))).first()[0] < 1100
    df = spark.createDataFrame([(*m, "x", "y") for m in rows], SCHEMA)
    assert len(rt.Trees(df).jumps) == 10


def test_mask_covers_exactly_the_trained_texts(spark):
    rows = [(1, i, i - 1 if i else None, r, t, None) for i, (r, t) in enumerate([("user", "</turn>"), ("assistant", "a\\b"), ("assistant", ""), ("assistant", None)])]
    piece = check(spark, rows).first()
    assert [rt.unescape(piece.text[s.start: s.end]) for s in piece.loss] == ["a\\b", "", ""]
    assert list(rt.turns_in(piece.text)) == [("user", "</turn>"), ("assistant", "a\\b"), ("assistant", ""), ("assistant", "")]


def test_conversations_become_chains(spark):
    rows = [(1, 3, "assistant", "late"), (1, 1, "user", "early"), (1, None, "system", "no turn"), (1, 3, "assistant", "late"),
            (2, 10, "user", "alone"), (None, 0, "user", "no id"), (None, 5, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, parent string").repartition(4)
    pieces = rt.saved(rt.formatted(rt.replies(df), repeated=False), "test-chains")
    got = {r.tree: list(rt.turns_in(r.text)) for r in pieces.collect()}
    assert got == {1: [("system", "no turn"), ("user", "early"), ("assistant", "late"), ("assistant", "late")], 2: [("user", "alone")],
                   None: [("user", "no id"), ("", "")]}
    empty = spark.createDataFrame([], df.schema)
    assert rt.formatted(rt.replies(empty), repeated=False).count() == 0
