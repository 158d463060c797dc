"""Operators 2, 4, 6 and 7: exact rules where there are some, held-out accuracy where models learn."""

import random
import re

import numpy as np
import pyarrow as pa
from cases import as_sorted, by_row, edge_texts, frame

from dayspan.llm import compression_quality, hyper_language, mixing, pseudo_likelihood

SYLLABLES = {"en": "the ing ion er and re st on".split(), "de": "ein sch ung lich ver ich tz ü".split(), "es": "ción de la os ñ que rr es".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def check_mix(rows, out):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = filled(sizes)
    assert as_sorted((r.doc_id, r.size, r.source_size) for r in out) == as_sorted((r[0], size(r[1]), sizes[r[3]]) for r in rows)
    source = {}
    for r in rows:
        source.setdefault((r[0], size(r[1])), set()).add(r[3])
    for s, total in sizes.items():
        mine = [r for r in out if source[r.doc_id, r.size] == {s}]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in mine)
        if len(mine) == sum(x[3] == s for x in rows):
            assert abs(sum(r.taken for r in mine) - want[s]) <= 1
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
        assert all(r.source_size == total for r in mine)


def test_mixing(spark):
    rows = [r for r in edge_texts() if r[0] not in (5, 6, 300, 301, 302)]  # every id of one source
    df = frame(spark, rows)
    plan = mixing.mix(df)
    out = plan.collect()
    check_mix(rows, out)
    again = mixing.mix(df.repartition(5)).collect()
    assert as_sorted((r.doc_id, r.taken, r.key) for r in out) == as_sorted((r.doc_id, r.taken, r.key) for r in again)
    copies = mixing.arrange(plan).collect()
    places = [r.position for r in copies]
    assert places == sorted(places) and min(places) >= 0
    assert sum(r.words for r in copies) == sum(r.taken for r in out)


def test_mixing_caps_and_reshares(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, "en", 10), None, s) for i, s in enumerate(["a"] * 2 + ["b"] * 60 + ["c"] * 5 + ["d"] * 4 + [None] * 9 + ["e"])]
    out = mixing.mix(frame(spark, rows)).collect()
    check_mix(rows, out)
    a = [r for r in out if r.doc_id < 2]
    assert all(r.taken == 30 and r.target == 60 for r in a)  # capped at three copies


def test_mixing_positions_follow_the_schedule(spark):
    """The share of a source's copies placed by time t is the integral of its schedule."""
    rows = [(i, "w " * 10, None, "ab"[i % 2]) for i in range(400)]
    plan = mixing.mix(frame(spark, rows), weights=(1, 2), schedules={1: (2.0, 0.0), 2: (1.0, 1.0)})
    copies = mixing.arrange(plan).collect()
    times = np.array([r.position / 4000 for r in copies if r.doc_id % 2 == 0])
    for t in (0.25, 0.5, 0.75):
        assert abs((times < t).mean() - (1 - (1 - t) ** 2)) < 0.03


def test_mixed_documents_keep_columns(spark):
    rows = edge_texts()
    df = frame(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.schema == df.schema
    texts = {r[1] for r in rows}
    got = out.collect()
    assert got and all(r.text in texts and r.text.strip() for r in got)
    assert mixing.mixed_documents(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_language_on_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randrange(4, 60)), lang, "s") for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "123 -- !!", "es", "s"), (1003, "the", None, None), (None, "schein lich", None, "s")]
    model = hyper_language.fit(frame(spark, [r for r in rows if r[0] is not None and r[0] % 3]))
    out = {r.doc_id: r for r in hyper_language.predict(frame(spark, rows), model).collect()}
    held = [r for r in rows[:300] if r[0] % 3 == 0]
    assert sum(out[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert {out[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and out[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out.values())
    blank = hyper_language.fit(frame(spark, rows).limit(0))
    assert {r.lang_pred for r in hyper_language.predict(frame(spark, rows[:5]), blank).collect()} == {"und"}
    assert hyper_language.predict(frame(spark, rows).limit(0), model).count() == 0


def test_language_scores_are_the_real_cosines():
    """Table lookups equal products of bundled hypervectors."""
    codes, doc = hyper_language.gram_codes(["The Ñandú sch", "", "ein"])
    assert (doc == 1).sum() == 0 and (codes != 0).all()
    letters = hyper_language.letter_vectors()
    proto = np.random.default_rng(0).normal(size=(hyper_language.DIM, 2))
    bundle = hyper_language.gram_vectors(codes[doc == 0], letters).astype(float).sum(axis=0)
    table = hyper_language.gram_vectors(codes[doc == 0], letters).astype(float) @ proto
    assert np.allclose(bundle @ proto, table.sum(axis=0))
    a, b, c = 1, 2, 3
    one = hyper_language.gram_vectors(np.array([a << 12 | b << 6 | c]), letters)[0]
    assert np.array_equal(one, np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c])


def quality_rows(n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        t = prose(rng, "en", rng.randrange(30, 120))
        if i % 5 < 2:
            t = rng.choice([lambda t: " | ".join(t.split()), lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "%%% ")])(t)
        rows.append((i, t, "en", "s"))
    return rows


def test_quality_on_held_out_texts(spark):
    rows = quality_rows()
    labels = spark.createDataFrame([(i, 0 if i % 5 < 2 else 1, "x") for i in range(300)] + [(7, 0, "x"), (8, None, "x"), (None, 1, "x")],
                                   "doc_id long, quality int, text string")
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (None, "the ing", "en", "s")]
    df = frame(spark, rows)
    model = compression_quality.fit(df, labels, per_class=60)
    out = {r.doc_id: r.score for r in compression_quality.score(df, model).collect()}
    good = np.array([out[i] for i in range(300, 400) if i % 5 >= 2])
    bad = np.array([out[i] for i in range(300, 400) if i % 5 < 2])
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert out[1000] == out[1001] and 0 < out[1000] < 1 and all(0 <= s <= 1 for s in out.values())
    kept = compression_quality.accepted(df, labels, per_class=60)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(300, 400) if i % 5 >= 2} - {i for i in range(400) if out[i] < 0.3}


def test_quality_model_ignores_repeated_rows(spark):
    """Rows that repeat sampled ids, alike or with other texts, change neither dictionaries nor weights."""
    labels = spark.createDataFrame([(i, 0 if i % 5 < 2 else 1) for i in range(300)], "doc_id long, quality int")
    rows = quality_rows()
    once = compression_quality.fit(frame(spark, rows), labels, per_class=60)
    again = compression_quality.fit(frame(spark, rows + [rows[11]] * 3000 + [rows[12]] * 3000).repartition(7), labels, per_class=60)
    assert again["good"] == once["good"] and again["bad"] == once["bad"]
    assert np.allclose(again["weights"], once["weights"], rtol=1e-6)


def test_quality_without_labels(spark):
    df = frame(spark, quality_rows(20))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in compression_quality.score(df, compression_quality.fit(df, none)).collect()} == {0.5}
    assert compression_quality.accepted(df, none).count() == 20
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    model = compression_quality.fit(df, one)
    assert all(r.score > 0.9 for r in compression_quality.score(df, model).collect())
    assert compression_quality.score(df.limit(0), model).count() == 0


def test_language_model(spark):
    rng = random.Random(5)
    # every second word follows from its neighbours
    follow = {f"a{i}": f"b{(i * 7) % 20}" for i in range(20)}
    rows = [(i, " ".join(x for _ in range(100) for a in [f"a{rng.randrange(20)}"] for x in (a, follow[a])), "en", "s") for i in range(700)]
    rows += [(900 + i, " ".join(rng.choices([*follow, *follow.values()], k=200)), "en", "s") for i in range(10)]
    rows += [(1000, None, None, None), (1001, "", "en", "s"), (1002, "a1", "en", "s"), (None, "a1 b7", "en", "s")]
    net, tokens = pseudo_likelihood.fit(frame(spark, rows).coalesce(1))
    out = {r.doc_id: r for r in pseudo_likelihood.score(tokens, net).collect()}
    ordered = np.mean([out[i].mean_log_likelihood for i in range(700)])
    shuffled = np.mean([out[900 + i].mean_log_likelihood for i in range(10)])
    assert ordered > shuffled + 0.5 and ordered > np.log(1 / 40) + 0.3  # better than the words' shares alone
    assert (out[1000].n_tokens, out[1000].log_likelihood, out[1000].mean_log_likelihood) == (0, 0.0, None)
    assert out[1002].n_tokens == 1 and out[0].n_tokens == 200
    flat = {r.doc_id: r for r in tokens.where("doc_id = 3").collect()}[3]
    x = np.concatenate([np.full(3, 256), np.frombuffer(flat.ids, np.uint8), np.full(3, 256)]).astype(np.int16)
    assert abs(net.log_probabilities(x, np.arange(3, 203)).sum() - out[3].log_likelihood) < 1e-2


def test_language_model_trains_on_every_position(spark, monkeypatch):
    seen = []
    real = pseudo_likelihood.Network.step
    monkeypatch.setattr(pseudo_likelihood.Network, "step", lambda net, x, at, *rest: (seen.extend(at.tolist()), real(net, x, at, *rest))[1])
    lengths = np.array([0, 1, 2, 3, 5, 8, 50])
    starts = 3 + np.cumsum(lengths + 3) - lengths - 3
    batch = pa.record_batch({"key": pa.array([7, -1, 0, 1, 2, 2**62, -(2**62)], pa.int64()), "ids": pa.array([bytes(n) for n in lengths], pa.binary())})

    class Tokens:  # runs the training task here, where its steps can be seen
        sparkSession, select, columns = spark, lambda self, *names: self, ["key", "ids"]

        def transform(self, with_, run, schema):
            list(run([batch]))
            return spark.createDataFrame([], schema)

    net = pseudo_likelihood.Network.start(np.ones(256))
    for number in range(pseudo_likelihood.ROUNDS):
        pseudo_likelihood.train_round(Tokens(), net, number)
    assert sorted(seen) == [p for s, n in zip(starts.tolist(), lengths.tolist(), strict=True) for p in range(s, s + n)]


def test_language_model_tells_rare_words_of_a_bucket_apart(spark, monkeypatch):
    rng = random.Random(7)
    common = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(rng.choices(common, k=60)), "en", "s") for i in range(300)]
    last = rows[0][1].rsplit(" ", 1)[0]
    rows += [(900 + i, f"{last} junk{i}", "en", "s") for i in range(40)] + [(990, None, None, None), (900, f"{last} junk0", "en", "s")]
    found = []
    for near in (1 << 18, 250, 0):  # all words broadcast, some, none: the same scores
        monkeypatch.setattr(pseudo_likelihood, "NEAR", near)
        net, tokens = pseudo_likelihood.fit(frame(spark, rows))
        shares = {}
        for r in tokens.select("doc_id", "share").collect():
            shares.setdefault(r.doc_id, set()).add(round(r.share, 6))
        found.append(shares)
    assert found[0] == found[1] == found[2]
    counts = {}
    for r in rows:
        for w in (r[1] or "").split():
            counts[w] = counts.get(w, 0) + 1
    hashes = dict(zip(counts, pseudo_likelihood.Words(pa.array([" ".join(counts)]), lower=True).hash.tolist(), strict=True))
    signed = lambda w: hashes[w] - 2**64 * (hashes[w] >= 2**63)
    top = set(sorted(counts, key=lambda w: (-counts[w], signed(w)))[:192])
    buckets = {}
    for w in counts.keys() - top:
        buckets[hashes[w] % 64] = buckets.get(hashes[w] % 64, 0) + counts[w]
    for r in rows:
        want = sum(np.log(counts[w] / buckets[hashes[w] % 64]) for w in (r[1] or "").split() if w not in top)
        assert found[0][r[0]] == {round(want, 6)} or abs(min(found[0][r[0]]) - want) < 1e-5
    scored = {r.doc_id: r for r in pseudo_likelihood.score(tokens, net).collect()}
    flat = tokens.where("doc_id = 905").collect()[0]
    x = np.concatenate([np.full(3, 256), np.frombuffer(flat.ids, np.uint8), np.full(3, 256)]).astype(np.int16)
    assert abs(net.log_probabilities(x, np.arange(3, len(x) - 3)).sum() + flat.share - scored[905].log_likelihood) < 1e-2
    assert scored[990].log_likelihood == 0


def test_language_model_gradient():
    """One step's gradient against finite differences."""
    rng = np.random.default_rng(1)
    net = pseudo_likelihood.Network(rng.normal(0, 0.3, pseudo_likelihood.Network.SIZE))
    x = rng.integers(0, 256, 60).astype(np.int16)
    at = np.arange(3, 57)
    before, squares = net.flat.copy(), np.zeros(pseudo_likelihood.Network.SIZE, np.float32)
    net.step(x, at, squares, 0.0)
    for i in [*np.flatnonzero(squares)[rng.integers(0, np.count_nonzero(squares), 12)].tolist()]:
        change = []
        for e in (1e-2, -1e-2):
            moved = before.astype(np.float64)
            moved[i] += e
            change.append(-pseudo_likelihood.Network(moved).log_probabilities(x, at).astype(np.float64).mean())
        assert abs(abs(change[0] - change[1]) / 2e-2 - np.sqrt(squares[i])) < 2e-3


def test_language_model_on_edge_rows(spark):
    rows = edge_texts()
    net, tokens = pseudo_likelihood.fit(frame(spark, rows))
    out = pseudo_likelihood.score(tokens, net)
    assert by_row(out, rows, "doc_id", "n_tokens") == as_sorted((r[0], len((r[1] or "").encode().split())) for r in rows)
    empty = pseudo_likelihood.fit(frame(spark, rows).limit(0))
    assert pseudo_likelihood.score(empty[1], empty[0]).count() == 0
