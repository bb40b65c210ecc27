"""The neural text model: gradient, word order, training loop with early stopping, store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant.operators import history as H
from verdant.operators import metrics as M
from verdant.operators import neural as N
from verdant.sources.model_store import ModelStore

TINY = N.Settings(buckets=40, size=5, filters=4, steps=2, epochs=4, patience=1, rate=0.02)


def texts(rng, n=6):
    return [np.concatenate([[0], rng.integers(1, 40, rng.integers(0, 12)), [0]]) for _ in range(n)]


def test_gradient_equals_differences(monkeypatch):
    monkeypatch.setattr(N, "STRETCH", 4)  # long texts in stretches
    rng = np.random.default_rng(1)
    p = N.initial(TINY, 3)
    p = {k: v + 0.1 * rng.standard_normal(v.shape) for k, v in p.items()}
    p["embedding"][0] = 0
    batch, y = texts(rng, 8), rng.integers(0, 3, 8)
    batch[0] = np.array([0, 0])  # a text without words
    loss, right, g = N.gradient(batch, y, p)
    assert right == sum(N.forward(t, p)[0].argmax() == k for t, k in zip(batch, y))
    x, e = N.flat(p), 1e-6
    for i in rng.permutation(len(x))[:200]:
        d = np.zeros_like(x)
        d[i] = e
        q = [N.shaped(x + s * d, p) for s in (1, -1)]
        for one in q:
            one["embedding"][0] = 0
        assert (N.gradient(batch, y, q[0])[0] - N.gradient(batch, y, q[1])[0]) / (2 * e) == pytest.approx(N.flat(g)[i], abs=1e-5)


def test_features_equal_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(2)
    p = N.initial(TINY, 2)
    p["filter_bias"] += rng.standard_normal(4)
    for t in texts(rng, 20):
        prob, features, _ = N.forward(t, p)
        words = [p["embedding"][i] for i in t]
        want = [max([0.0] + [sum(words[i + j] @ p["filter"][j * 5:(j + 1) * 5, f] for j in range(3)) + p["filter_bias"][f] for i in range(len(t) - 2)])
                for f in range(4)]
        assert np.allclose(features, want) and prob.sum() == pytest.approx(1)


def test_no_text_is_multiplied_with_the_filters():
    class Counted(np.ndarray):
        rows = 0

        def __array_ufunc__(self, ufunc, method, *inputs, **kw):
            if ufunc is np.matmul:
                Counted.rows += len(inputs[0])
            return getattr(ufunc, method)(*(np.asarray(x) for x in inputs), **kw)

    rng = np.random.default_rng(4)
    p = N.initial(TINY, 2)
    seen = []
    for n in (5, 500):
        batch, y = [np.concatenate([[0], rng.integers(1, 40, 30), [0]]) for _ in range(n)], rng.integers(0, 2, n)
        Counted.rows = 0
        N.gradient(batch, y, {**p, "filter": p["filter"].view(Counted)})
        seen.append(Counted.rows)
    assert seen[0] == seen[1]  # products with the filters, whatever the number of texts


def test_word_order_counts():
    p = N.initial(TINY, 2)
    a, b = (N.forward(np.array([0, *ids, 0]), p)[0] for ids in ((3, 7, 9, 4), (3, 9, 7, 4)))
    assert abs(a - b).max() > 1e-6


@pytest.fixture(scope="module")
def split(spark):
    # the label is which of two words comes first: only a model of word order can learn it
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        words = [f"w{j}" for j in rng.integers(0, 6, 4)]
        label, at = int(rng.random() < 0.5), int(rng.integers(0, 4))
        words[at:at] = ["up", "down"] if label else ["down", "up"]
        rows.append((i, " ".join(words), label, "train" if i < 280 else "val" if i < 340 else "test"))
    rows.append((1000, None, 1, "train"))
    return spark.createDataFrame(rows, "doc_id long, text string, label int, split string")


def test_training(spark, split, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    s = N.Settings(buckets=64, size=8, filters=16, steps=4, epochs=12, patience=2, rate=0.03)
    run = N.train(split, [0, 1], store, "run", s)
    history = run.history.orderBy("epoch").collect()
    assert [r.epoch for r in history] == list(range(1, len(history) + 1)) and history[-1].loss < history[0].loss
    # a version an epoch, early stopping on the history, the best epoch loaded
    assert store.versions("run") == {r.epoch: True for r in history}
    stop = H.early_stopping(run.history, patience=2).first()
    assert stop.best_epoch == run.stopped["best_epoch"] and stop.epochs_run == len(history)
    assert len(history) == (stop.stopped_epoch or s.epochs)
    assert store.load("run", stop.best_epoch).meta["figures"][1] == max(r.val_accuracy for r in history)
    per_epoch = {r.epoch: r for r in M.metrics_of_cells(run.cells, ("run", "epoch")).collect()}
    assert all(per_epoch[r.epoch].accuracy == pytest.approx(r.val_accuracy) and per_epoch[r.epoch].n == 60 for r in history)
    test = split.where("split = 'test'")
    scored = run.model.score(test, ["doc_id", "label"]).collect()
    assert len(scored) == 60 and np.mean([r.choice == r.label for r in scored]) > 0.9
    again = N.TextModel.load(store, "run", stop.best_epoch).score(test, ["doc_id", "label"]).collect()
    assert sorted(again) == sorted(scored)


def test_layout_and_edge_cases(spark, split, tmp_path):
    p = N.initial(TINY, 2)
    rows = N.with_ids(split, TINY).select(F.col("label").alias("y"), "ids")
    one, many = (N.summed_gradient(rows.repartition(n), p) for n in (1, 5))
    assert one[:3] == pytest.approx(many[:3]) and np.allclose(one[3], many[3]) and one[2] == 401
    none = N.summed_gradient(rows.where("false"), p)
    assert none[2] == 0 and not none[3].any()
    run = N.train(split.where("split = 'train' and label = 1"), [1], ModelStore(spark, str(tmp_path)), "one", TINY)
    assert {r.choice for r in run.model.score(split, ["doc_id"]).collect()} == {0}


def test_places_are_found_in_runs_and_only_if_asked_for():
    rng = np.random.default_rng(7)
    for n in (1, 15, 16, 17, 100):
        z = rng.integers(0, 4, (n, 9)).astype(float)  # many ties: the first place counts
        at, top = N.first_largest(z)
        assert (at == z.argmax(axis=0)).all() and (top == z.max(axis=0)).all()
    p = N.initial(TINY, 2)
    for t in texts(rng, 20):
        whole, without = N.forward(t, p), N.forward(t, p, None, False)
        assert (whole[0] == without[0]).all() and (whole[1] == without[1]).all() and not without[2].any()
