"""Gradients, plain-loop scorers and distances; clashing columns and empty tables of operators and stages."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdant.llm import jaccard, language, neighbours, packing, toxicity, warc


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


@pytest.fixture(scope="module")
def network():
    index = np.zeros(toxicity.WORDS, np.int32)
    index[::3] = np.arange(1, len(index[::3]) + 1)
    model = toxicity.Model(index)
    rng = np.random.default_rng(1)
    for k, v in model.p.items():
        if k in ("b", "c"):
            model.p[k] = (v + 0.3 * rng.standard_normal(v.shape)).astype(np.float32)
    return model


def test_toxicity_gradient_equals_differences(network):
    rng = np.random.default_rng(2)
    d = toxicity.WORD_DIM + toxicity.CHAR_DIM
    x = rng.standard_normal((3, 6, d)).astype(np.float32)
    mask = np.ones((3, 6), np.float32)
    mask[1, 4:] = 0
    coef = np.array([1.0, -0.5, 2.0], np.float32)
    logit, saved = network.forward(x, mask, keep=True)
    g, dx = network.backward(x, mask, coef, saved)
    value = lambda: float((network.forward(x, mask).astype(np.float64) * coef).sum())
    e = 1e-2
    for k in g:
        kept = network.p[k]
        way = rng.standard_normal(kept.shape).astype(np.float32)
        way /= np.linalg.norm(way)
        network.p[k] = kept + e * way
        up = value()
        network.p[k] = kept - e * way
        down = value()
        network.p[k] = kept
        assert (up - down) / (2 * e) == pytest.approx(float((g[k] * way).sum()), rel=0.03, abs=2e-3), k
    way = rng.standard_normal(x.shape).astype(np.float32)
    way /= np.linalg.norm(way)
    up = float((network.forward(x + e * way, mask) * coef).sum())
    down = float((network.forward(x - e * way, mask) * coef).sum())
    assert (up - down) / (2 * e) == pytest.approx(float((dx * way).sum()), rel=0.03, abs=2e-3)


def test_toxicity_scores_equal_a_plain_loop(network):
    p = {k: v.astype(np.float64) for k, v in network.p.items()}
    h = toxicity.HIDDEN

    def window(x):
        states = []
        for way in (0, 1):
            s, out = np.zeros(h), {}
            for t in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
                g = x[t] @ p["W"][way] + p["b"][way]
                z = sigmoid(g[:h] + s @ p["U"][way][:, :h])
                r = sigmoid(g[h:2 * h] + s @ p["U"][way][:, h:2 * h])
                cand = np.tanh(g[2 * h:] + (r * s) @ p["U"][way][:, 2 * h:])
                s = out[t] = s + z * (cand - s)
            states.append(out)
        both = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(x))]
        weight = np.exp([np.tanh(b @ p["A"]) @ p["a"] for b in both])
        return sum(w * b for w, b in zip(weight / weight.sum(), both)) @ p["o"] + p["c"][0] if len(x) else p["c"][0]

    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(50)] + ["Été", "x", "ÜBER"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 5, toxicity.WINDOW, toxicity.WINDOW + 1, 3 * toxicity.WINDOW)] + ["", "?!"]
    for text, got in zip(texts, network.scores(texts)):
        x = network.inputs(text).astype(np.float64)
        starts = range(0, max(1, -(-(len(x) - toxicity.WINDOW) // toxicity.STRIDE) + 1))
        want = max(window(x[k * toxicity.STRIDE:k * toxicity.STRIDE + toxicity.WINDOW]) for k in starts)
        assert got == pytest.approx(sigmoid(want), abs=2e-4), text[:40]


def test_language_distance_equals_a_plain_loop():
    rng = random.Random(4)
    k = 25
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(40))
    learned = {name: language.top(*language.grams(text(letters)), k) for name, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "xyzab"))}
    known = language.Profiles(learned, k)
    for letters in ("abcde", "cdefg", "xyzab", "abcdefgxyz", "qrs"):
        for _ in range(20):
            t = text(letters)[:rng.randint(1, 200)]
            mine = language.top(*language.grams(t), k).tolist()
            if not mine:
                continue
            away = {}
            for name, profile in learned.items():
                place = {g: i for i, g in enumerate(profile.tolist())}
                away[name] = sum(abs(place[g] - i) if g in place else k for i, g in enumerate(mine))
            got, score = known.language(t)
            assert got == min(sorted(away), key=away.get)
            second = min([k * len(mine), *sorted(away.values())[1:]])
            assert score == pytest.approx(1 - away[got] / second if second else 1.0)


def test_packing_tiers_and_step_groups(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([0, 3, 80, 400, 2000])))) for i in range(120)],
                                 "doc_id long, text string").repartition(3)
    rows = packing.pack_documents(docs, buffer_tokens=20_000, step_tokens=8192).collect()
    windows, groups = collections.Counter(), collections.defaultdict(dict)
    for r in rows:
        windows[r.sequence_id] += r.length
        groups[r.step_group][r.sequence_id] = r.tier
    tiers = {s: t for g in groups.values() for s, t in g.items()}
    assert all(windows[s] == tiers[s] and tiers[s] <= 4096 and tiers[s] & (tiers[s] - 1) == 0 for s in windows)  # full, so no padding
    for g in groups.values():  # one size, and tokens of a step at most
        assert len(set(g.values())) == 1 and sum(g.values()) <= max(8192, *g.values())
    assert sum(n for n in windows.values() if n in packing.TIERS) > 0.9 * sum(windows.values())


def test_extra_columns_do_not_clash(spark):
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(base[:58] + [f"z{i}"] * (i % 3)), "en", 1, 2, 3, 4, b"5") for i in range(12)],
                                 "doc_id long, text string, lang string, n int, _key int, _best int, _own int, _set binary")
    docs = docs.selectExpr("*", "text as _text", "1 as digest", "2 as u", "'x' as root")
    got = jaccard.jaccard_components(docs)
    assert {r.component_id for r in got.collect()} == {0} and got.count() == 12
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r["_key"] == 2 and r["_best"] == 3 and r["_own"] == 4 and r["_set"] is not None for r in rows)
    pages = spark.createDataFrame([(1, "u", "<p>", 7, "d"), (2, "u", "<p>" * 40, 7, "d"), (3, "u", "<p>" * 40, 7, "d")],
                                  "page_id long, url string, html string, refers_to int, digest string")
    assert {(r.page_id, r.refers_to) for r in warc.warc_round_trip(pages).collect()} >= {(2, None), (3, 2)}


def test_extra_columns_of_vectors(spark):
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0], 1, 2, 3) for i in range(30)], "vec_id long, embedding array<float>, ids int, v int, rank int")
    found = neighbours.nearest(vectors, F.col("vec_id") % 10 == 0, k=3).collect()
    assert len(found) == 9 and {r["rank"] for r in found} == {1, 2, 3}


def test_pages_without_an_id_revisit(spark):
    rows = [(1, "x"), (None, "x"), (2, "x"), (None, "x"), (None, "y"), (None, "y"), (7, None)]
    got = warc.warc_round_trip(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr) == sorted(
        [(1, 1, "response", None), (None, 1, "revisit", 1), (2, 1, "revisit", 1), (None, 1, "revisit", 1), (None, 1, "response", None),
         (None, 1, "response", None), (7, 0, "response", None)], key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert jaccard.jaccard_components(docs).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
