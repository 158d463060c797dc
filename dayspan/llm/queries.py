"""The opN queries (whole tables, production parameters) and their DuckDB SQL where SQL can state them."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayspan.llm import (
    chunk_dedup,
    compression_quality,
    hyper_language,
    mixing,
    ngram_join,
    periodic_runs,
    pseudo_likelihood,
    reply_trees,
    secret_index,
    simhash_decontamination,
    substring_dedup,
    token_output,
    zone_clusters,
)
from dayspan.llm.common import WORD, documents, saved


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_output.token_output(documents(spark, sf_dir), tokenizer_path())
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(documents(spark, sf_dir))
    first = F.get("copies", F.lit(0))["position"]
    return (plan.select("doc_id", "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("n_copies"), first.alias("first"))
            .orderBy(F.col("first").asc_nulls_last(), "doc_id").drop("first"))


def op3_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    net, tokens = pseudo_likelihood.fit(documents(spark, sf_dir))
    return pseudo_likelihood.score(tokens, net)


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = compression_quality.crc_mod("doc_id", 3) == 1
    model = hyper_language.fit(docs.where(~held).select("text", "lang"))
    return hyper_language.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = compression_quality.fit(docs, compression_quality.learnable(labels))
    return compression_quality.score(docs, model).select(
        "doc_id", (compression_quality.crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_dedup(documents(spark, sf_dir))


def op9_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_index.digest(secret_index.scan(documents(spark, sf_dir)))


def op10_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = zone_clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return zone_clusters.with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def with_periodic_ends(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The query's input: the words of every tenth document (by crc32 of its id) repeat with a period from some word on."""
    marks = [zlib.crc32(str(i).encode()) if i is not None else 1 for i in batch.column("doc_id").to_pylist()]
    texts, changed, new = batch.column("text"), [], []
    for at, h in enumerate(marks):
        w = re.findall(WORD, texts[at].as_py() or "") if h % 10 == 0 else None
        if w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            new.append(" ".join(w[:a] + [w[a + i % p] for i in range(n - a)]))
        changed.append(bool(w))
    text = pc.replace_with_mask(texts, pa.array(changed), pa.array(new, texts.type)) if new else texts
    return pa.record_batch({"doc_id": batch.column("doc_id"), "text": text})


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(documents(spark, sf_dir), prepare=with_periodic_ends)
    most = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] > best["length"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return out.withColumn("most", most).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("most.start").alias("start"), F.col("most.length").alias("length"),
        F.col("most.period").alias("period"), F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


#: the conversation that op13 adds: it holds the template's own marks
MARKED = r"\### Assistant: </turn> ok"


def op13_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.select("conv_id", "turn", "role", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    own = spark.createDataFrame([(-7, 0, "user", MARKED, "", 0), (-7, 1, "assistant", MARKED, "", 1)], rows.schema)
    pieces = saved(reply_trees.formatted(reply_trees.replies(rows.union(own)), repeated=False), "conversations")
    return reply_trees.read_back(pieces).withColumnRenamed("tree", "conv_id").drop("branch")


QUERIES = {f.__name__: f for f in (
    op1_wavelet_tokens, op2_curriculum_mixing, op3_seed_extend, op4_masked_likelihood, op5_simhash_windows,
    op6_hyperdimensional_language, op7_compression_quality, op8_chunk_recipes, op9_trigram_secrets, op10_multi_order_jaccard,
    op11_zone_clusters, op12_periodic_runs, op13_reply_trees)}

ORACLE: dict[str, str] = {}

ORACLE["op2_curriculum_mixing"] = r"""
with d as (
    select doc_id, source, md5('mix:' || doc_id) as coin,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
    from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
w as (select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 3 as cap from s),
l as (select *, cap / weight as ratio,
             (sum(source_size) over () - coalesce(sum(cap) over upto, 0))::double
               / (sum(weight) over () - coalesce(sum(weight) over upto, 0))::double as tried
      from w window upto as (order by cap / weight, rank rows between unbounded preceding and 1 preceding)),
m as (select *, max(case when ratio >= tried then tried end) over () as level from l),
t as (select source, source_size, case when level is null or ratio <= level then cap::double else level * weight end as target from m),
p as (select d.*, t.source_size, t.target, floor(t.target)::bigint as goal,
             coalesce(sum(size) over (partition by d.source order by coin, doc_id rows between unbounded preceding and 1 preceding), 0) as place
      from d join t on d.source is not distinct from t.source),
c as (select doc_id, size, source_size, target, k, greatest(0, least(size, goal - (k * source_size + place)))::bigint as words
      from p, (select unnest([0, 1, 2]) as k) copies)
select doc_id, size, source_size, any_value(target) as target, sum(words)::bigint as taken, count(*) filter (words > 0) as n_copies
from c group by doc_id, size, source_size
"""

ORACLE["op3_seed_extend"] = r"""
with d as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
a as (select r, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
x as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from a),
again as (select h from x group by h having count(*) > 1),
gone as (select distinct r, i + k as j from x join again using (h), (select unnest(range(35)) as k) o),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as j from d),
kept as (select r, string_agg(word, ' ' order by j) as t, count(*) as n from words anti join gone using (r, j) group by r)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)
"""

ORACLE["op10_multi_order_jaccard"] = r"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') as w
    from documents),
a as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0),
x as (select distinct doc_id, md5(array_to_string(w[i:i + 4], ' ')) as h from a),
n as (select doc_id, count(*) as n from x group by doc_id),
shared as (select p.doc_id as a, q.doc_id as b, count(*) as c from x p join x q using (h) where p.doc_id < q.doc_id group by all),
links as (
    select a, b from shared join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
    select doc_id as start, doc_id as node from d
    union
    select start, b from reach join both_ways on node = a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(node) as component_id
from d left join n using (doc_id) join reach on start = d.doc_id group by all
"""

ORACLE["op8_chunk_recipes"] = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""


def _centroid_rounds(rounds: int = 10) -> str:
    """DuckDB SQL of op11: one pair of steps for each round."""
    steps = ["""
with v as (
    select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e
    from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
p as (select r, unnest(e) as x, unnest(range(64)) as i from v),
c0 as (select row_number() over (order by sha256('3:' || vec_id), e) - 1 as c, e
       from (select vec_id, e from v order by sha256('3:' || vec_id), e limit 8))"""]
    for k in range(rounds + 1):
        steps.append(f"""
q{k} as (select c, unnest(e) as y, unnest(range(64)) as i from c{k}),
d{k} as (select r, c, sum((x - y) * (x - y))::bigint as d from p join q{k} using (i) group by r, c),
a{k} as (select r, min(d) as d, arg_min(c, d * 8 + c) as c from d{k} group by r)""")
        if k < rounds:
            steps.append(f"""
m{k} as (select c, i, sum(x)::bigint as s, count(*) as n from p join a{k} using (r) group by c, i),
n{k} as (select c, list((s - ((s % n) + n) % n) // n order by i) as e from m{k} group by c),
c{k + 1} as (select c{k}.c, coalesce(n{k}.e, c{k}.e) as e from c{k} left join n{k} using (c))""")
    return ",".join(steps) + f"""
select vec_id, c::int as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
       sha256(array_to_string(c{rounds}.e, ',')) as centroid_sha256
from v join a{rounds} using (r) join c{rounds} using (c)
"""


ORACLE["op11_zone_clusters"] = _centroid_rounds()

# Every run of twelve words holds two equal windows of six words, a period apart; such pairs of one distance that follow
# each other are a stretch. k is the crc32 of the id, bit by bit.
ORACLE["op12_periodic_runs"] = r"""
with d as (
    select row_number() over () as r, doc_id, doc_id::varchar as s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
k as (
    select r, doc_id, w, len(w) as n, xor(4294967295::bigint, list_reduce(
        list_concat([4294967295::bigint], list_transform(range(9 * length(s)), lambda i: case when i % 9 = 0 then ascii(s[i // 9 + 1])::bigint else -1 end)),
        lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end)) as h
    from d),
g as (select r, doc_id, w, n, h % 10 = 0 and n > 0 as changed, h // 10 as g, case when n > 0 then (h // 10) % n end as a from k),
x as (
    select r, doc_id, n, case when changed then list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % (1 + (n - a) // (3 + g % 8)) else i end]) else w end as w
    from g),
f as (select r, i, md5(array_to_string(w[i + 1:i + 6], ' ')) as m from (select r, w, unnest(range(n - 5)) as i from x where n >= 12)),
pairs as (select l.r, l.i, m.i - l.i as q from f l join f m on l.r = m.r and l.m = m.m and l.i < m.i),
islands as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from pairs),
stretches as (select r, min(i) as a, max(i) + 6 + q as b, q from islands group by r, q, island),
runs as (select r, a, b, min(q) as q, b - a as length from stretches where b - a >= greatest(12, 2 * q) group by r, a, b),
listed as (
    select r, count(*) as n_runs, sha256(string_agg(a || ',' || length || ',' || q || chr(10), '' order by a, q)) as runs_sha256,
           first(struct_pack(a := a, length := length, q := q) order by length desc, a, q) as most
    from runs group by r),
gone as (select distinct r, unnest(range(a + q, b)) as i from runs),
words as (select r, unnest(range(n)) as i, unnest(w) as word from x),
kept as (select r, string_agg(word, ' ' order by i) as t from words anti join gone using (r, i) group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, most.a as start, most.length as length, most.q as period,
       1000 * most.length // most.q as exponent_milli, coalesce(runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from x left join listed using (r) left join kept using (r)
"""

ORACLE["op13_reply_trees"] = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f as (select *, 17 + length(regexp_replace(role, '([\\<>])', '\\\1', 'g')) + length(regexp_replace(t, '(\\|<turn |</turn>)', '\\\1', 'g')) as chars,
             role || chr(10) || t || chr(10) as whole, case when role = 'assistant' then t end as said
      from c)
select conv_id, count(*) as n_turns, sha256(string_agg(whole, '' order by turn, role, md5(t))) as turns_sha256,
       coalesce(sum(length(said)), 0)::bigint as loss_chars, sha256(coalesce(string_agg(said, '' order by turn, role, md5(t)), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from f group by conv_id
"""
