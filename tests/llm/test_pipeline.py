"""The pipeline's stages against brute force, each on the input its predecessor kept."""

import zlib

import numpy as np
import pytest
from cases import as_sorted, edge_texts, frame
from test_dedup import brute_components
from test_learned import filled, quality_rows
from test_scans import contaminated_rows

import __spark_entry__
import corpus_pipeline
from dayspan.llm import compression_quality, simhash_decontamination
from dayspan.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    rows, items = contaminated_rows()
    rows = [*rows, *[(2000 + i, t, lang, f"s{i % 5}") for i, t, lang, _ in quality_rows(200)]]
    frame(spark, rows).repartition(4).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(2000 + i, 0 if i % 5 < 2 else 1, 0) for i in range(200)] + [(r[0], 1, 0) for r in edge_texts()[:20]],
                          "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def plain(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, schema = plain(docs), docs.schema
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        model = compression_quality.fit(docs, compression_quality.learnable(labels)) if name == "quality" else None
        scores = as_sorted((r.doc_id, r.score >= 0.3) for r in compression_quality.score(docs, model).collect()) if model else None
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(name)
        if name == "tokens":
            break
        after = plain(docs)
        assert docs.schema == schema and set(after) <= set(before)
        if name == "quality":
            assert as_sorted((x[0],) for x in after) == as_sorted((i,) for i, ok in scores if ok)
            assert 40 < len(before) - len(after) < 140
        if name == "near_copies":
            want = {i for i, _, c in brute_components(before) if i is not None and i == c}
            assert {x[0] for x in after if x[0] is not None} == want
            assert len([x for x in after if x[0] is not None]) == len(want)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").collect()]
            dirty = {d for d, _ in simhash_decontamination.brute_force([x[1] for x in before], items)}
            assert dirty and as_sorted(after) == as_sorted(x for d, x in enumerate(before) if d not in dirty)
        if name == "mixing":
            sizes, taken, largest = {}, {}, {}
            for x in before:
                n = len((x[1] or "").encode().split())
                sizes[x[3]], largest[x[3]] = sizes.get(x[3], 0) + n, max(largest.get(x[3], 0), n)
            for x in after:
                taken[x[3]] = taken.get(x[3], 0) + len(x[1].encode().split())
            goal = filled(sizes)
            assert all(abs(taken.get(s, 0) - goal[s]) <= largest[s] / 2 + 1 for s in sizes)
            assert all(after.count(x) <= 3 * before.count(x) for x in set(after))
    assert seen == ["quality", "near_copies", "decontamination", "mixing", "tokens"]
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(tokenizer_path())
    got = docs.orderBy("start").collect()
    # the shards keep the training order of the mixing stage's files
    files = sorted((tmp_path / "mixing").glob("part-*.parquet"))
    order = [r for f in files for r in spark.read.parquet(str(f)).select("doc_id", "text").collect()]
    ids = [np.array([*tool.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in order]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(r.doc_id, len(x), zlib.crc32(x.tobytes())) for r, x in zip(order, ids, strict=True)]
    assert [r.start for r in got] == np.append(0, np.cumsum([len(x) for x in ids])[:-1]).tolist()


def test_run_and_registration(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns) and out.count() > 100
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
