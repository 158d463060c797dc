"""Operator 1: exact round trips and index queries against plain arrays."""

import zlib

import numpy as np
import pytest
from cases import as_sorted, by_row, edge_texts, frame

from dayspan.llm import token_output, wavelet
from dayspan.llm.queries import tokenizer_path


@pytest.mark.parametrize("n", [0, 1, 7, 70_000])
@pytest.mark.parametrize("levels", [1, 9, 16, 20])
def test_wavelet_queries(tmp_path, n, levels):
    rng = np.random.default_rng(n + levels)
    x = (rng.zipf(1.3, n) % (1 << levels)).astype(np.uint32)
    path = str(tmp_path / "shard.wvm")
    wavelet.write(path, wavelet.build(x, levels, np.arange(0, n, 5), list(range(0, n, 5))))
    f = wavelet.WaveletFile(path)
    assert f.decode().tolist() == x.tolist() and f.doc_ids() == list(range(0, n, 5)) and f.starts.tolist() == list(range(0, n, 5))
    for i in rng.integers(0, n, 20).tolist() if n else []:
        assert f.access(i) == x[i]
    for token in {*x[:5].tolist(), 0, (1 << levels) - 1}:
        at = np.flatnonzero(x == token)
        assert f.count(token) == len(at)
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert f.count(token, a, b) == int(((at >= a) & (at < b)).sum())
        for k in {0, len(at) // 2, len(at) - 1} if len(at) else ():
            assert f.occurrence(token, k) == at[k]
        with pytest.raises(IndexError):
            f.occurrence(token, len(at))
    assert f.count(1 << levels) == 0


def test_files_hold_what_the_tokenizer_says(spark):
    from tokenizers import Tokenizer
    tool = Tokenizer.from_file(tokenizer_path())
    rows = [r for r in edge_texts() if r[0] is not None]
    ids = {}
    want, at = [], 0
    for r in sorted(rows, key=lambda r: r[0]):
        ids[r[0]] = np.array([*tool.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], at, len(ids[r[0]]), zlib.crc32(ids[r[0]].tobytes())))
        at += len(ids[r[0]])
    df = frame(spark, rows)
    out = token_output.token_output(df, tokenizer_path())
    assert by_row(out, rows, "doc_id", "start", "n_tokens", "ids_crc32") == as_sorted(want)
    small = token_output.write_shards(df, tokenizer_path(), shard_tokens=2000)
    assert small.count() > 1
    assert by_row(token_output.read_back(small), rows, "doc_id", "start", "n_tokens", "ids_crc32") == as_sorted(want)
    shard = small.orderBy("start").first()
    f = wavelet.WaveletFile(shard.path)
    token = int(ids[f.doc_ids()[0]][0])
    assert f.access(0) == token and f.occurrence(token, 0) == 0


def test_null_ids_come_first_and_empty_tables_give_nothing(spark):
    rows = edge_texts()
    out = token_output.token_output(frame(spark, rows), tokenizer_path()).orderBy("start").collect()
    assert len(out) == len(rows) and [r.doc_id for r in out[:2]] == [None, None]
    assert [r.start for r in out] == np.append(0, np.cumsum([r.n_tokens for r in out])[:-1]).tolist()
    assert token_output.token_output(frame(spark, rows).limit(0), tokenizer_path()).count() == 0


def test_table_of_known_words_is_bounded(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(token_output, "MOST_KEPT", 50)
    monkeypatch.setattr(token_output, "SLOT_BITS", 4)
    tool = token_output.Encoder(tokenizer_path(), 2)
    texts = [" ".join(f"word{i * j}" for j in range(40)) for i in range(30)]
    for t in texts * 2:
        got, n = tool.block(pa.array([t, None]))
        assert got.tolist() == [*tool.tool.encode(t, add_special_tokens=False).ids, 2, 2] and n.tolist() == [len(got) - 1, 1]


def test_reading_back_gives_the_encoders_memory_back(spark, monkeypatch):
    """Workers that encoded serve the tasks that read the files; there the tables of words are of no use."""
    runs = []
    monkeypatch.setattr(token_output, "in_arrow", lambda df, run, schema: runs.append(run) or df)
    before = token_output.encoder(tokenizer_path(), 2)
    token_output.read_back(spark.createDataFrame([("nowhere", 0)], "path string, start long"))
    assert token_output._encoders and list(runs[0](iter([]))) == [] and not token_output._encoders
    assert token_output.encoder(tokenizer_path(), 2) is not before
