"""Boosted trees against a plain numpy booster, their sums, layout and edge cases."""

import json

import numpy as np
import pytest

from verdant.operators import boosting as B

NAMES = ["a", "b", "c", "d"]


def data(seed, n=90):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, 4)), 2)
    x[:, 3] = rng.integers(0, 3, n)
    y = ((x[:, 0] + 0.6 * x[:, 1] ** 2 + 0.2 * x[:, 3] + 0.2 * rng.standard_normal(n)) > 0.9).astype(int)
    x[rng.random(n) < 0.1, 2] = np.nan
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in row), int(t)) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "doc_id long, a double, b double, c double, d double, y_true int").repartition(parts)


def plain(x, y, rows, s, start):
    """Value by value, node by node: margins after all rounds, and the cuts as (feature, value)."""
    margin, shapes = np.full(len(y), start), []
    for number in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, use = p - y, p * (1 - p), B.drawn(rows, s.row_fraction, s.seed, number)
        columns, shape = B.tree_columns(s, x.shape[1], number), []
        l2 = s.l2 if s.gain == "newton" else 0.0

        def value(at):
            return -s.step * g[at].sum() / (h[at].sum() + l2)

        def build(train, every, depth):
            best = None
            for f in columns if depth < s.depth else ():
                for cut in sorted({v for v in x[use, f] if not np.isnan(v)} | {v for v in x[:, f] if not np.isnan(v)}):
                    with np.errstate(invalid="ignore"):
                        goes_left = x[:, f] < cut
                    a, b = train & goes_left, train & ~goes_left
                    if not a.any() or not b.any():
                        continue
                    if s.gain == "newton":
                        if h[a].sum() < s.min_hessian - 1e-9 or h[b].sum() < s.min_hessian - 1e-9:
                            continue
                        of = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
                        gain = (of(a) + of(b) - of(train)) / 2
                    else:
                        na, nb = a.sum(), b.sum()
                        gain = na * nb / (na + nb) * (g[a].mean() - g[b].mean()) ** 2
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-8):
                        best = gain, f, cut, goes_left
            if best is None:
                margin[every] += value(train)
                return
            shape.append((best[1], best[2]))
            build(train & best[3], every & best[3], depth + 1)
            build(train & ~best[3], every & ~best[3], depth + 1)

        build(use, np.ones(len(y), dtype=bool), 0)
        shapes.append(sorted(shape))
    return margin, shapes


@pytest.mark.parametrize("gain, columns", [("newton", 0.8), ("variance", 1.0)])
def test_equals_a_plain_booster(spark, gain, columns):
    x, y = data(1)
    s = B.Settings(rounds=12, row_fraction=0.8, column_fraction=columns, gain=gain)
    df = frame(spark, x, y)
    model = B.fit(df, NAMES, settings=s)
    rows = np.zeros(len(y), dtype=np.int64)
    for r in df.selectExpr("doc_id", "xxhash64(doc_id) as h").collect():
        rows[r.doc_id] = r.h
    margin, shapes = plain(x, y, rows, s, model.start)
    got = np.zeros(len(y))
    for r in model.score(df).collect():
        got[r.doc_id] = r.margin
        assert r.prob == pytest.approx(1 / (1 + np.exp(-r.margin))) and r.y_pred == int(r.margin > 0)
    assert np.allclose(got, margin, atol=1e-6)
    # the cuts may stand at another value of the same gap between training rows
    assert [[f for f, _ in t] for t in shapes] == [sorted(f for f in t.feature if f >= 0) for t in model.trees]
    assert ((got > 0) == y).mean() > 0.85
    if columns < 1:
        used = [{f for f in t.feature if f >= 0} for t in model.trees]
        assert all(len(u) <= 3 for u in used) and len(set(map(frozenset, used))) > 1


def test_layout_does_not_matter(spark):
    x, y = data(2)
    s = B.Settings(rounds=4, row_fraction=0.7)
    assert B.fit(frame(spark, x, y, 1), NAMES, settings=s).to_json() == B.fit(frame(spark, x, y, 7), NAMES, settings=s).to_json()


def test_importances_and_json(spark):
    x, y = data(3)
    model = B.fit(frame(spark, x, y), NAMES, settings=B.Settings(rounds=11))
    for kind in ("gain", "total_gain"):
        assert sum(model.importances(kind)) == pytest.approx(1.0) and model.importances(kind)[0] == max(model.importances(kind))
    again = B.BoostedTrees.from_json(json.dumps(json.loads(model.to_json())))
    df = frame(spark, x, y)
    key = lambda m: sorted((r.doc_id, r.margin) for r in m.score(df).collect())
    assert key(again) == key(model)


def test_edge_cases(spark):
    x, y = data(4, 30)
    none = frame(spark, x, y).where("false")
    model = B.fit(none, NAMES)
    assert model.trees == [] and model.importances() == [0.0] * 4
    one = B.fit(frame(spark, x, np.ones(len(y))), NAMES, settings=B.Settings(rounds=3))
    assert all(r.y_pred == 1 for r in one.score(frame(spark, x, y)).collect())
    flat = B.fit(frame(spark, np.zeros_like(x), y), NAMES, settings=B.Settings(rounds=2))
    assert flat.importances() == [0.0] * 4
    with pytest.raises(ValueError, match="0 or 1"):
        B.fit(frame(spark, x, y + 1), NAMES)
    with pytest.raises(ValueError, match="gain"):
        B.Settings(gain="none")
    assert B.scale_for(10) == 2.0 ** 30 and B.scale_for(2 ** 40) * 2 ** 40 <= 2 ** 62


def test_a_level_takes_tasks_by_its_rows(spark, monkeypatch):
    files, sums = [], B.level_sums
    monkeypatch.setattr(B, "level_sums", lambda rows, *a: files.append(len(rows.inputFiles())) or sums(rows, *a))
    s = B.Settings(rounds=2, depth=2)
    x, y = data(5)
    many = B.fit(frame(spark, x, y, 7), NAMES, settings=s)
    assert set(files) == {1}
    monkeypatch.setattr(B, "TASK_ROWS", 40)
    files.clear()
    assert B.fit(frame(spark, x, y), NAMES, settings=s).to_json() == many.to_json()
    assert set(files) == {90 // 40 + 1}
