"""Linear classifiers: losses, optimum against a dense solver, joint fits, one vector table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdant.operators import linear as L
from verdant.plans.classic import fit_linear, linear_scores, prepare, vector_rows
from verdant.sources.tables import reviews

SF = "/root/testdata/sf0.001"


def sparse(rng, n, width):
    x = rng.random((n, width)) * (rng.random((n, width)) < 0.4)
    x[0] = 0  # a row without entries
    return x


def frame(spark, x, y, parts=3):
    rows = [(int(k), [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for r, k in zip(x, y)]
    return spark.createDataFrame(rows, "y int, index array<int>, value array<double>").repartition(parts)


def objective(problem, x, y, w):
    """Loss of dense rows by the plain formulas."""
    z = np.column_stack([x, np.ones(len(x))]) @ w.T
    s = problem.c * (np.array(problem.weights)[y] if problem.weights else np.ones(len(y)))
    if problem.kind == "softmax":
        loss = (s * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y])).sum()
    else:
        t = np.where(y == problem.target, 1, -1)
        loss = (s * (np.log1p(np.exp(-t * z[:, 0])) if problem.kind == "logistic" else np.maximum(0, 1 - t * z[:, 0]) ** 2)).sum()
    return loss + 0.5 * (problem.penalty(x.shape[1]) * w * w).sum()


PROBLEMS = [L.Problem("logistic", 2, weights=(0.7, 1.6)), L.Problem("squared_hinge", 2), L.Problem("squared_hinge", 3, target=0),
            L.Problem("softmax", 3, weights=(1.0, 2.0, 0.5))]


@pytest.mark.parametrize("problem", PROBLEMS)
def test_derivatives(problem):
    rng = np.random.default_rng(1)
    z, dz = rng.standard_normal((20, problem.outputs)) * 3, rng.standard_normal((20, problem.outputs))
    y, e = rng.integers(0, problem.classes, 20), 1e-6
    f = lambda a: problem.value(z + a * dz, y)
    assert (f(e)[0] - f(-e)[0]) / (2 * e) == pytest.approx((f(0)[1] * dz).sum(), rel=1e-5)
    assert np.allclose((f(e)[1] - f(-e)[1]) / (2 * e), problem.curve(z, dz, y), atol=1e-4)


def dense_optimum(problem, x, y):
    """Steepest descent with backtracking from many iterations, by numeric gradient of the plain objective."""
    shape = (problem.outputs, x.shape[1] + 1)
    w = np.zeros(shape)
    basis = np.eye(w.size).reshape(w.size, *shape)
    e = 1e-5
    for _ in range(60):
        g = np.array([(objective(problem, x, y, w + e * b) - objective(problem, x, y, w - e * b)) / (2 * e) for b in basis])
        h = np.array([[(objective(problem, x, y, w + 1e-4 * (a + b)) - objective(problem, x, y, w + 1e-4 * a) - objective(problem, x, y, w + 1e-4 * b)
                        + objective(problem, x, y, w)) / 1e-8 for b in basis] for a in basis])
        step = np.linalg.lstsq(h + 1e-6 * np.eye(len(h)), -g, rcond=None)[0].reshape(shape)
        t = 1.0
        while t > 1e-6 and objective(problem, x, y, w + t * step) > objective(problem, x, y, w):
            t /= 2
        if t <= 1e-6:
            break
        w = w + t * step
    return w


def test_optimum_equals_a_dense_solver(spark):
    rng = np.random.default_rng(2)
    for classes, problems in ((2, PROBLEMS[:2]), (3, PROBLEMS[2:])):
        x = sparse(rng, 40, 4)
        y = np.minimum((x @ [1, 2, 0.5, 0.1] + 0.4 * rng.standard_normal(40)).clip(0).astype(int), classes - 1)
        passes = []
        got = L.fit(frame(spark, x, y), problems, 4, tol=1e-8, passes=passes)
        for problem, r in zip(problems, got):
            want = dense_optimum(problem, x, y)
            assert r["norm"] <= 1e-4 * r["start"]
            assert r["loss"] == pytest.approx(objective(problem, x, y, r["coefficients"]), rel=1e-9)
            assert r["loss"] <= objective(problem, x, y, want) + 1e-6
            free = problem.kind == "softmax"  # intercepts of a softmax are free up to a common shift
            a, b = r["coefficients"], want
            assert np.allclose(a - (a[:, -1:].mean() if free else 0) * np.eye(5)[-1], b - (b[:, -1:].mean() if free else 0) * np.eye(5)[-1], atol=2e-3)
        assert max(passes) == len(problems)  # both problems in one pass


def test_penalised_intercept_only_for_the_hinge():
    assert PROBLEMS[1].penalty(3).tolist() == [[1, 1, 1, 1]] and PROBLEMS[0].penalty(3).tolist() == [[1, 1, 1, 0]]


@pytest.fixture(scope="module")
def prep(spark):
    return prepare(reviews(spark, SF), max_features=2000)


def test_joint_fit_equals_single_fits(spark, prep):
    passes = []
    both = fit_linear(prep, ["logreg", "svm"], tol=1e-6, passes=passes)
    assert max(passes) == 2
    for model in both:
        (alone,) = fit_linear(prep, [model.name], tol=1e-6)
        assert np.allclose(alone.coefficients, model.coefficients, atol=1e-7)
    s = linear_scores(prep, ["logreg", "svm"])
    n = prep.split.where(F.col("split").isin("val", "test")).count()
    assert {r["model"]: r["count"] for r in s.groupBy("model").count().collect()} == {"logreg": n, "svm": n}
    assert s.where("prob is null or prob < 0 or prob > 1 or y_pred not in (0, 1)").count() == 0


def test_stationary_on_the_training_rows(prep):
    """The gradient of the squared-hinge objective, from the rows themselves, is near zero at the fit."""
    (model,) = fit_linear(prep, ["svm"])
    rows, features = vector_rows(prep)
    got = rows.where("split = 'train'").select("y", "index", "value").collect()
    w, zero = model.coefficients[0], np.zeros(features + 1)

    def gradient(w):
        g = w.copy()
        for r in got:
            t = 1 if r.y == 1 else -1
            short = max(0.0, 1 - t * (sum(w[i] * v for i, v in zip(r["index"], r["value"])) + w[-1]))
            for i, v in zip(r["index"], r["value"]):
                g[i] -= 2 * t * short * v
            g[-1] -= 2 * t * short
        return g

    assert np.linalg.norm(gradient(w)) <= 1.01e-4 * np.linalg.norm(gradient(zero))


def test_vectors_equal_the_weights_and_read_no_text(prep):
    rows, features = vector_rows(prep)
    assert vector_rows(prep)[0] is rows  # one table a flow
    index = {r.term: r.term_index for r in prep.vocab.collect()}
    assert sorted(index.values()) == list(range(features))
    want = {}
    for r in prep.weights.collect():
        want.setdefault(r.doc_id, {})[index[r.term]] = r.weight
    for r in rows.collect():
        assert list(r["index"]) == sorted(r["index"]) and dict(zip(r["index"], r["value"])) == want.get(r.doc_id, {})
    plan = linear_scores(prep, ["svm"])._jdf.queryExecution().toString()
    assert "text" not in plan and "Exchange" not in plan


def test_bad_names_and_sizes(spark, prep):
    with pytest.raises(ValueError, match="unknown"):
        L.problems_of("tree", 2, [1, 1])
    with pytest.raises(ValueError, match="coefficients"):
        L.fit(frame(spark, np.zeros((2, 2)), [0, 1]), [L.Problem("logistic", 2)], L.MAX_COEFFICIENTS)
    assert L.fit(frame(spark, np.zeros((2, 2)), [0, 1]).where("false"), [L.Problem("logistic", 2)], 2)[0]["steps"] == 0


def test_passes_take_the_entries_as_bytes(spark, monkeypatch):
    x = np.array([[0.5, 0, 2.0], [0, 0, 0], [1.5, -1.0, 0]])
    rows = frame(spark, x, [0, 1, 1])
    whole = pa.Table.from_batches(L.packed(rows).toArrow().to_batches()).combine_chunks().to_batches()[0]
    for b in (whole, whole.slice(1), whole.slice(0, 0)):
        y, index, value, row = L.rows_of(b)
        dense = np.zeros((b.num_rows, 3))
        dense[row, index] = value
        assert sorted([int(a), *d] for a, d in zip(y, dense.tolist())) == sorted([int(a), *x[[0.5, 0, 1.5].index(d[0])].tolist()] for a, d in zip(y, dense.tolist()))
    seen = []
    plain = L.one_pass
    monkeypatch.setattr(L, "one_pass", lambda r, *a: seen.append(r.schema["value"].dataType.typeName()) or plain(r, *a))
    L.fit(rows, [L.Problem("logistic", 2)], 3)
    assert seen and set(seen) == {"binary"}


def test_passes_read_the_row_groups_of_the_files(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = sparse(rng, 600, 40)
    y = rng.integers(0, 2, 600)
    monkeypatch.setattr(L, "GROUP_BYTES", 20_000)
    rows = L.packed(frame(spark, x, y))
    groups = L.groups_of(rows)
    named = [(r.file, r.row_group) for r in groups.collect()]
    assert len(set(named)) == len(named) > len({f for f, _ in named}) > 1  # several groups a file
    requests = [(p, (kind, rng.standard_normal((1, 41)), rng.standard_normal((1, 41)))) for p in PROBLEMS[:2] for kind in (L.VALUE, L.CURVE)]
    for (a, u), (b, v) in zip(L.one_pass(rows, requests, 40), L.one_pass(rows, requests, 40, groups)):
        assert a == pytest.approx(b, rel=1e-12) and np.allclose(u, v, rtol=1e-12, atol=1e-12)
    assert L.groups_of(L.packed(frame(spark, x, y).where("false"))) is None or not L.one_pass(rows, requests[:1], 40, L.groups_of(L.packed(frame(spark, x, y).where("false"))))[0][1].any()

    seen = []
    plain = L.summed
    monkeypatch.setattr(L, "summed", lambda rows, *a: seen.append(rows.columns) or plain(rows, *a))
    (fitted,) = L.fit(frame(spark, x, y), PROBLEMS[:1], 40)
    assert seen and all(c == ["file", "row_group"] for c in seen)
    # where Arrow can't open the folder, Spark reads the rows

    class Closed:
        @staticmethod
        def from_uri(uri):
            raise OSError("no such file system")

    monkeypatch.setattr(L.pafs, "FileSystem", Closed)
    seen.clear()
    (again,) = L.fit(frame(spark, x, y), PROBLEMS[:1], 40)
    assert all("value" in c for c in seen) and np.allclose(again["coefficients"], fitted["coefficients"], atol=1e-9)
