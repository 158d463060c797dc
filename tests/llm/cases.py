"""Frames with every awkward case, shared by the operator tests."""

from __future__ import annotations

import random

from pyspark.sql import types as T

#: names that operators use inside, as extra columns of the input
CLASHING = ("key", "size", "d", "c", "n", "node", "spans", "copies", "position", "row_key", "own", "kinds", "score", "ids")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])


def words(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_texts(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source) rows: nulls, blanks, short and very long texts, repeats, near copies, ties."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(20, 200)) for _ in range(30)]
    passage = words(rng, 60)
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, f"{words(rng, 30)}\n{passage}\t{words(rng, 20 + i)}", "de", "s1") for i in range(6)]  # a shared passage
    for i in range(8):  # near copies, one word changed
        w = base[i].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w), "en", None))
    rows += [(300, None, "en", "s1"), (301, "", None, "s2"), (302, " \t\n ", "en", "s3"), (303, "one", "de", "s1"),
             (304, "a b c", None, None), (305, "A B C", "en", "s1"), (306, "a  b\nc", "en", "s1"),
             (307, words(rng, 60_000), "en", "s2"), (308, "loop " * 500, "en", "s1"), (309, "x" * 40_000, "de", "s1"),
             (310, "é ñ ß 日本語 <|endoftext|> naïve text 👍", "fr", "s1"), (311, passage, "en", "s1")]
    rows += [(5, base[5], "en", "s1"), (400, base[5], "en", "s1"), (401, base[5].replace(" ", "  "), "en", "s1")]  # repeats
    rows += [(None, base[6], "en", "s1"), (None, None, None, None), (300, None, "en", "s1")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASHING)) for r in rows], SCHEMA)


def by_row(df, rows, *cols):
    """Collected values aligned with the input rows: sorted tuples of (doc_id, ...) compare as multisets."""
    def sortable(t):
        return tuple((v is None, "" if v is None else v) for v in t)
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=sortable)


def as_sorted(tuples):
    return sorted(tuples, key=lambda t: tuple((v is None, "" if v is None else v) for v in t))
