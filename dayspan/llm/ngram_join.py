"""Operator 10: n-gram Jaccard join with several global token orders.

A document's set is its distinct five-word shingles (64-bit hashes). Two sets
of Jaccard similarity >= t share at least ceil(t n) tokens of the one with n
tokens, so under any total order of tokens their prefixes of
n - ceil(t n) + 1 tokens share one. Every order puts frequent tokens last (by
classes of their count over the whole corpus, ``CLASSES``), then goes by a
hash of its own. If the first common token of two sets stands at ranks i and
j, they share at most min(n - i, m - j) tokens; a pair is a candidate only if
that reaches t / (1 + t) (n + m), under the first order and then under every
further one. What all filters leave is verified exactly.

Skew: documents with equal sets are one node. Within the nodes of a token
first only stars are verified (every node against the one of its size class
with the fewest rare tokens); then, token by token, only candidates that are
still in different components. Pairs inside a component need no test, since
links only matter up to reachability, so a group of m copies costs about m
pairs and no link between components is lost.

Tokens that occur once in the corpus stand first in every order and make no
pair, so a text with enough tokens of its own emits nothing. Tokens are counted
exactly; the classes reach the scans as Bloom filters of at most 2^28 bits each
(a false hit is the same for all texts, so it changes the order, not the result).

Nulls, empty texts and texts of white space: empty set, own component. Equal
sets (also repeated rows) link. A null doc_id is never the smallest unless all
ids of a component are null. Texts of any length are one set. Empty tables give
empty results; extra columns are ignored. Sets and nodes are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm.common import MOST_SEEN, Bloom, U, Words, blocks, deal_bits, in_arrow, key_of, mix, repeated_keys, row_key, saved

WIDTH, PERCENT = 5, 80
#: least number of occurrences of the frequency classes above the first one
CLASSES = (2, 16, 256, 4096)
SALTS = [0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xCBBB9D5DC1059ED8]


class Sets:
    """The sets of a block: text d has ``tokens[cut[d]: cut[d + 1]]``, sorted and distinct."""

    def __init__(self, block: pa.RecordBatch, width: int = WIDTH):
        words = Words(block.column("text"), lower=True)
        hashes, at = words.shingles(width)
        hashes = hashes.copy()
        ends = np.searchsorted(at, words.first)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            hashes[a:b].sort()
        new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        new[ends[:-1][ends[:-1] < len(hashes)]] = True
        self.cut = np.append(0, np.cumsum(new))[ends]
        self.tokens = hashes[new]
        self.sizes = np.diff(self.cut)

    def nodes(self) -> np.ndarray:
        """64-bit identity of each set (0 for the empty one)."""
        total = np.append(U(0), np.cumsum(mix(self.tokens ^ U(0xA54FF53A5F1D36F1))))
        sums = total[self.cut[1:]] - total[self.cut[:-1]] + self.sizes.astype(U) * U(0x9E3779B97F4A7C15)
        return np.where(self.sizes > 0, mix(sums), U(0)).view(np.int64)

    def ranks(self, levels: np.ndarray, order: int) -> np.ndarray:
        """The tokens' ranks under an order: frequency class, then the order's own hash."""
        return (levels.astype(U) << U(56)) | (mix(self.tokens ^ U(SALTS[order])) >> U(8))

    def prefix(self, ranks: np.ndarray, d: int, percent: int, ordered: bool = True) -> np.ndarray:
        """The first tokens of set d under an order."""
        a, b = self.cut[d], self.cut[d + 1]
        n = prefix_length(int(b - a), percent)
        own = ranks[a:b]
        first = np.argpartition(own, n - 1)[:n]
        return self.tokens[a:b][first[np.argsort(own[first])] if ordered else first]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n + (-percent * n) // 100 + 1


def fresh(nodes: np.ndarray, seen: set[int]) -> list[int]:
    """Places of the non-empty nodes that this task has not had yet."""
    own = {n: d for d, n in reversed(list(enumerate(nodes.tolist()))) if n and n not in seen}
    if len(seen) < MOST_SEEN:  # only saves work: a node may come twice
        seen.update(own)
    return sorted(own.values())


class Frequencies:
    """Frequency class of every token, from Bloom filters of the classes."""

    def __init__(self, docs: DataFrame, width: int = WIDTH):
        self.bits = deal_bits(docs.sparkSession)
        counts = saved(repeated_keys(docs, lambda block: Sets(block, width).tokens), "token-counts")
        self.blooms = [Bloom(counts.where(F.col("n") >= least).select("key")) for least in CLASSES]

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        keys = key_of(tokens, self.bits)
        out, at = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for bloom in self.blooms:
            at = at[bloom.has(keys[at])]
            out[at] += 1
        return out


def _lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    return pa.array(arrays, pa.list_(kind))


def describe(docs: DataFrame, known: Broadcast, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, key (row identity), node, n; and for one row per node and task
    that may have a partner the repeated tokens of its first-order prefix with their ranks (p0, rank)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch):
                sets = Sets(block, width)
                nodes, levels = sets.nodes(), known.value.levels(sets.tokens)
                ranks = sets.ranks(levels, 0)
                first, rank = [None] * block.num_rows, [None] * block.num_rows
                for d in fresh(nodes, seen):
                    own = levels[sets.cut[d]: sets.cut[d + 1]]
                    alone = int(np.count_nonzero(own == 0))  # these come first
                    p = sets.prefix(ranks, d, percent) if alone < prefix_length(len(own), percent) else ()
                    if len(p):
                        first[d], rank[d] = p[alone:].view(np.int64), np.arange(alone, len(p), dtype=np.int32)
                yield pa.record_batch({"doc_id": block.column("doc_id"), "key": block.column("key"), "node": pa.array(nodes, pa.int64()),
                                       "n": pa.array(sets.sizes, pa.int64()), "p0": _lists(first, pa.int64()), "rank": _lists(rank, pa.int32())})

    return docs.select("doc_id", row_key().alias("key"), "text").transform(
        in_arrow, rows, f"doc_id {kind}, key long, node long, n long, p0 array<long>, rank array<int>")


def enough(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m tokens can be similar if their first common token stands at ranks i and j (from 0)."""
    return F.least(n - i, m - j) * (100 + percent) >= (n + m) * percent


def sets_of(docs: DataFrame, wanted: DataFrame, frequencies: Broadcast, width: int, percent: int, orders: int) -> DataFrame:
    """(node, n, prefixes under the further orders, tokens) of the wanted nodes; a few others may come along."""
    known = docs.sparkSession.sparkContext.broadcast(Bloom(wanted))
    names = [f"p{k}" for k in range(1, orders)]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch):
                sets = Sets(block, width)
                nodes = sets.nodes()
                own = fresh(np.where(known.value.has(nodes.view(U)), nodes, 0), seen)
                more = {}
                levels = frequencies.value.levels(sets.tokens) if own else None
                for k, p in enumerate(names, 1):
                    ranks = sets.ranks(levels, k) if own else None
                    more[p] = _lists([sets.prefix(ranks, d, percent).view(np.int64) for d in own], pa.int64())
                yield pa.record_batch({"node": pa.array(nodes[own], pa.int64()), "n": pa.array(sets.sizes[own], pa.int64()), **more,
                                       "tokens": _lists([sets.tokens[sets.cut[d]: sets.cut[d + 1]].view(np.int64) for d in own], pa.int64())})

    kinds = "".join(f"{p} array<long>, " for p in names)
    found = docs.select("text").transform(in_arrow, run, f"node long, n long, {kinds}tokens array<long>")
    sets = saved(found.dropDuplicates(["node"]), "join-sets")
    known.destroy()  # the workers need not keep it
    return sets


def verify(docs: DataFrame, pairs: DataFrame, frequencies: Broadcast, width: int, percent: int, orders: int) -> DataFrame:
    """The pairs (a, b) that are candidates under every further order too and pass the exact test."""
    wanted = saved(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "join-wanted")
    sets = sets_of(docs, wanted, frequencies, width, percent, orders)
    keys = ["n", *[f"p{k}" for k in range(1, orders)]]
    kept = (pairs.join(sets.select(F.col("node").alias("a"), F.struct(*keys).alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.struct(*keys).alias("y")), "b"))
    for k in keys[1:]:
        x, y = F.col("x")[k], F.col("y")[k]
        kept = kept.withColumn("t", F.get(F.array_intersect(x, y), F.lit(0))).where(
            enough(F.col("x.n"), F.array_position(x, F.col("t")) - 1, F.col("y.n"), F.array_position(y, F.col("t")) - 1, percent))
    kept = saved(kept.select("a", "b"), "join-candidates")
    both = (kept.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b"))
    same = F.size(F.array_intersect("ta", "tb"))
    return both.where(same * 100 >= (F.size("ta") + F.size("tb") - same) * percent).select("a", "b")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes: least labels flow over the links
    and labels of labels are taken, until nothing changes. Nothing is collected."""
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("least"))
                   .select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        near = saved(near.withColumnRenamed("a", "node"), "near")
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        step = saved(step, "step")
        up = step.select(F.col("node").alias("c"), F.col("c").alias("up"))
        labels = saved(step.join(up, "c").select("node", F.col("up").alias("component"), (F.col("up") < F.col("was")).alias("moved")), "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def postings(rows: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, rank, size_class), without those that no other posting
    of the token can make a candidate.

    By ``enough``, a partner of a set of n tokens at rank i has at most
    (n - i) (100 + percent) / percent - n tokens ("most"); so some set of the
    token must be that small, and some must allow n.
    """
    most = (F.col("n") - F.col("rank")) * (100 + percent) / percent - F.col("n") + 1e-6
    at = F.explode(F.arrays_zip("p0", "rank")).alias("at")
    every = (rows.where(F.col("p0").isNotNull()).select("node", "n", at)
             .select("node", "n", F.col("at.p0").alias("token"), F.col("at.rank").alias("rank")).withColumn("most", most))
    token = (every.groupBy(F.col("token").alias("t")).agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("n").alias("least"),
                                                          F.max("most").alias("widest"))
             .where(F.col("lo") < F.col("hi")).select("t", "least", "widest"))
    kept = every.join(saved(token, "tokens"), F.col("token") == F.col("t")).where((F.col("least") <= F.col("most")) & (F.col("widest") >= F.col("n")))
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) + 1e-9))
    return kept.select("node", "n", size_class.alias("size_class"), "token", "rank").distinct()


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, orders: int = 3) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, key (row
    identity) and whether the row is the one of its component that stays."""
    spark = docs.sparkSession
    frequencies = spark.sparkContext.broadcast(Frequencies(docs, width))  # bounded Bloom filters
    rows = saved(describe(docs, frequencies, width, percent), "set-rows")
    posts = saved(postings(rows, percent), "postings")

    # round 1: stars, every node against one node of its own and the next size class
    first = F.min(F.struct("rank", "node", "n")).alias("c")
    centers = posts.groupBy("token", F.col("size_class").alias("near")).agg(first)
    centers = saved(centers.select("token", "near", F.col("c.node").alias("center"), F.col("c.n").alias("m"), F.col("c.rank").alias("center_rank")), "centers")
    beside = posts.withColumn("near", F.explode(F.array("size_class", F.col("size_class") + 1)))
    stars = beside.join(centers, ["token", "near"]).where((F.col("node") != F.col("center")) & enough(F.col("n"), F.col("rank"), F.col("m"), F.col("center_rank"), percent))
    stars = saved(stars.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct(), "stars")
    links = saved(verify(docs, stars, frequencies, width, percent, orders), "star-links")
    found = components(spark, links)

    # round 2: per token only candidates of different components are still open
    named = posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = saved(named, "named-postings")
    open_tokens = saved(named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"))
                        .where((F.col("lo") < F.col("hi")) & (F.col("m") > 2)).select("token"), "open-tokens")
    still = saved(named.join(open_tokens, "token", "left_semi"), "open-postings")
    one = still.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.col("component").alias("ca"))
    two = still.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), F.col("component").alias("cb"))
    rest = (one.join(two, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                                         & enough(F.col("na"), F.col("ra"), F.col("nb"), F.col("rb"), percent))
            .select("a", "b").distinct().join(stars, ["a", "b"], "left_anti"))
    rest = saved(rest, "rest")
    more = rest if rest.isEmpty() else saved(verify(docs, rest, frequencies, width, percent, orders), "rest-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(spark, links)

    frequencies.destroy()  # all that used it is written
    # a component is named after its row of the smallest doc_id (nulls last)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = saved(rows.where("n > 0").groupBy("node").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("m"))
                    .join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "classes")
    names = saved(classes.groupBy("component").agg(F.min("first").alias("first"), F.sum("m").alias("m"))
                  .where("m > 1").select("component", "first"), "component-ids")
    member = saved(classes.drop("first").join(names, "component").select(F.col("node").alias("in_node"), "first"), "members")
    out = rows.select("doc_id", "key", "node", F.col("n").alias("n_shingles")).join(member, F.col("node") == F.col("in_node"), "left")
    alone = F.col("in_node").isNull() | (F.col("n_shingles") == 0)
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
                      "key", (alone | (F.col("key") == F.col("first.key"))).alias("stays"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the row of the smallest doc_id, all
    columns kept. Of rows that repeat id and text one stays, also of empty ones.

    Texts that surely stay are not moved: a Bloom filter of the keys to drop (or
    to keep once) parts the rows, and only those that it holds are joined.
    """
    ids = linked(docs, **options)
    special = saved(ids.groupBy("key").agg(F.max("stays").alias("once"), F.count(F.lit(1)).alias("times"))
                    .where(~F.col("once") | (F.col("times") > 1)).select(F.col("key").alias("special"), "once"), "dropped")
    known = docs.sparkSession.sparkContext.broadcast(Bloom(special.select("special")))
    rows = docs.select(row_key().alias("own"), F.struct("*").alias("d"))

    def held(wanted: bool):
        def run(batches):
            for batch in batches:
                keys = batch.column("own").to_numpy(zero_copy_only=False).astype(np.int64).view(U)
                yield batch.filter(pa.array(known.value.has(keys) == wanted))
        return run

    names = [F.col("d")[c].alias(c) for c in docs.columns]
    sure = rows.transform(in_arrow, held(False), rows.schema).select(*names)
    looked_up = rows.transform(in_arrow, held(True), rows.schema).join(special, F.col("own") == F.col("special"), "left")
    out = sure.unionByName(looked_up.where(F.col("special").isNull()).select(*names))
    if not special.where("once").isEmpty():
        once = looked_up.where("once").groupBy("own").agg(F.min_by("d", F.xxhash64("d")).alias("d"))
        out = out.unionByName(once.select(*names))
    return out
