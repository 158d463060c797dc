"""Operator 9: secret scans over a trigram inverted index.

A Boolean trigram query is derived from each rule's regex. The index holds, per
segment of about 1 MB of text, the postings of every trigram that some rule's
query names (over ASCII-lower-cased text). Queries are answered per segment by
intersecting and uniting postings with DataFrame array functions; only
candidates are verified with the regex itself. A rule without mandatory
trigrams (such as a bare run of hex digits) scans every text.

Nulls and empty texts have no spans. A null doc_id is reported like others.
Rows that repeat id and text give equal rows. Ties of spans at one start go by
the rules' order. Texts of any length are one document; empty tables and extra
columns are fine.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.llm.common import blocks, in_arrow, row_key, saved

MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: regex, flags, and the least length of ``group`` for a match to count."""
    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 1


#: fixed values: the base kinds, in the order of the report
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         re.IGNORECASE | re.ASCII, 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 0, 32),
)
#: fixed values: kinds that the method adds
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 0, 40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 0, 32),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 0, 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 0, 39),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]+", 0, 0, 24),
)

# A query is None (no condition) or a set of alternatives, each a set of trigrams that must all be present.
Query = frozenset | None


def _exact(op, arg) -> set[str] | None:
    """The strings a node matches, ASCII-lower-cased, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is sre.AT:
        return {""}
    if op is sre.IN:
        if all(o is sre.LITERAL and a < 128 for o, a in arg) and len(arg) <= 6:
            return {chr(a).lower() for _, a in arg}
        return None
    if op is sre.SUBPATTERN:
        return _exact_all(arg[3])
    if op is sre.BRANCH:
        sets = [_exact_all(x) for x in arg[1]]
        return None if any(s is None for s in sets) else set().union(*sets)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        own = _exact_all(body)
        if own is None or int(high) > 4:
            return None
        out: set[str] = set()
        for n in range(low, int(high) + 1):
            out |= {"".join(x) for x in product(own, repeat=n)}
        return out if len(out) <= MOST_STRINGS else None
    return None


def _exact_all(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        own = _exact(op, arg)
        if own is None or len(own) * len(out) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least({x | y for x in a for y in b})


def _least(alternatives: set[frozenset]) -> Query:
    """Alternatives that contain another one are implied by it."""
    return frozenset(x for x in alternatives if not any(y < x for y in alternatives))


def _strings(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return _least({frozenset(s[i: i + 3] for i in range(len(s) - 2)) for s in strings})


def _required(items) -> Query:
    query, pending = None, {""}
    for op, arg in items:
        own = _exact(op, arg)
        if own is not None and len(own) * len(pending) <= MOST_STRINGS:
            pending = {a + b for a in pending for b in own}
            continue
        query, pending = _both(query, _strings(pending)), {""}
        if op is sre.SUBPATTERN:
            query = _both(query, _required(arg[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            query = _both(query, _required(arg[2]))
        elif op is sre.BRANCH:
            parts = [_required(x) for x in arg[1]]
            if all(p is not None for p in parts):
                query = _both(query, _least(set().union(*parts)))
    return _both(query, _strings(pending))


def trigram_query(rule: Rule) -> Query:
    """Alternatives of trigrams without which the regex cannot match; None: scan."""
    return _required(_parser.parse(rule.pattern, rule.flags))


def vocabulary(rules: Sequence[Rule]) -> list[str]:
    return sorted({t for r in rules for alt in trigram_query(r) or () for t in alt})


def build_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """One row per segment: a map from trigram to the keys of the texts that have it."""
    needles = [(t, t.encode()) for t in trigrams]

    def run(batches):
        for batch in batches:
            for block in blocks(batch, size=1 << 20):
                keys = block.column("key").to_pylist()
                texts = [(t or "").encode().lower() for t in block.column("text").to_pylist()]
                postings = {t: [k for k, x in zip(keys, texts, strict=True) if raw in x] for t, raw in needles}
                yield pa.record_batch({"postings": pa.array([[(t, p) for t, p in postings.items() if p]],
                                                            pa.map_(pa.string(), pa.list_(pa.int64())))})

    return docs.select(row_key().alias("key"), "text").transform(in_arrow, run, "postings map<string, array<long>>")


def matching(query: frozenset) -> Column:
    """Keys of a segment that satisfy a query: intersections within, unions between alternatives."""
    none = F.array().cast("array<long>")

    def keys(t: str) -> Column:
        return F.coalesce(F.try_element_at("postings", F.lit(t)), none)

    alternatives = [reduce(F.array_intersect, [keys(t) for t in sorted(alt)]) for alt in sorted(query, key=sorted)]
    return reduce(F.array_union, alternatives)


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """key and the kinds whose trigram queries it satisfies."""
    asked = [(r.kind, q) for r in rules if (q := trigram_query(r)) is not None]
    if not asked:
        return index.select(F.lit(0).cast("long").alias("key"), F.array().cast("array<string>").alias("kinds")).limit(0)
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), matching(q).alias("keys")) for kind, q in asked])
    rows = index.select(F.explode(found).alias("f")).select("f.kind", F.explode("f.keys").alias("key"))
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def find(text: str, rules: Sequence[tuple[Rule, re.Pattern]]) -> list[tuple[int, int, str]]:
    """(start, rank of the rule, kind:start:end) of all spans, in report order."""
    out = []
    for rank, (rule, pattern) in enumerate(rules):
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), rank, f"{rule.kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """doc_id and spans: array of kind:start:end (code points) per row, by start, then rule order."""
    index = saved(build_index(docs, vocabulary(rules)), "trigram-index")
    found = saved(candidates(index, rules), "secret-candidates").withColumnRenamed("key", "found")
    always = {r.kind for r in rules if trigram_query(r) is None}
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    rows = rows.join(found, F.col("key") == F.col("found"), "left").select("doc_id", "text", "kinds")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        compiled = [(r, re.compile(r.pattern, r.flags)) for r in rules]
        for batch in batches:
            spans = []
            for text, kinds in zip(batch.column("text").to_pylist(), batch.column("kinds").to_pylist(), strict=True):
                own = [c for c in compiled if c[0].kind in always or kinds and c[0].kind in kinds]
                rank = {c[0].kind: i for i, c in enumerate(compiled)}
                hits = find(text, own) if text else []
                spans.append([s for _, _, s in sorted((a, rank[own[i][0].kind], s) for a, i, s in hits)])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, pa.list_(pa.string()))})

    return rows.transform(in_arrow, run, f"doc_id {kind}, spans array<string>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the digests of a scan."""
    def of(*rules: Rule) -> Column:
        return F.filter("spans", lambda s: F.element_at(F.split(s, ":"), 1).isin([r.kind for r in rules]))

    counts = [F.size(of(r)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(of(*BASE), ",").cast("binary"), 256).alias("base_sha256"),
                        F.array_join("spans", ",").alias("spans"))


def digest_of(text: str | None) -> tuple[int, int, int, str]:
    """Brute force of the base columns for one text, for tests."""
    compiled = [(r, re.compile(r.pattern, r.flags)) for r in BASE]
    hits = [s for _, _, s in find(text or "", compiled)]
    n = [sum(s.startswith(r.kind + ":") for s in hits) for r in BASE]
    return (*n, hashlib.sha256(",".join(hits).encode()).hexdigest())
