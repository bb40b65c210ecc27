"""Hard negatives: residue arithmetic against Python integers, results against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdant.llm import hard_negatives as H

ROWS = "vec_id long, embedding array<float>, label int, v double, rank int, _r long"  # clashing extra columns


def brute(rows, every=50):
    seen = set()
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(math.floor(256 * float(np.float32(c))) for c in x)
        if math.sqrt(sum(c * c for c in v)) >= 2 ** 31:
            continue
        seen.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, v))
    anchors = {}
    for r in sorted(seen):
        if r[0] % every == 0:
            anchors.setdefault(r[0], r)
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in anchors.values():
        others = sorted((-dot(a[2], r[2]), r[0], r[1]) for r in seen if r[0] != a[0])
        positives = [(-s, i) for s, i, label in others if label == a[1]][:5]
        for score, i in sorted(set(positives)):
            found = [(-s, j) for s, j, label in others if label != a[1] and 50 * score <= -100 * s <= 95 * score][:3]
            out += [(a[0], i, k + 1, j, score, s) for k, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, every=50):
    df = spark.createDataFrame([(*r, 0.0, 1, 2) for r in rows], ROWS)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % every == 0).collect()))


def test_residue_products_are_exact():
    rng = np.random.default_rng(1)
    for width, size in ((1, 5), (64, 200), (64, 2 ** 20), (3000, 2 ** 9), (7, 2 ** 28)):
        a = rng.integers(-size, size + 1, (5, width)).astype(float)
        b = rng.integers(-size, size + 1, (9, width)).astype(float)
        a[0], b[0], b[1] = size, size, -size  # the ends of the range
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        primes = H.moduli(max(abs(x) for u in want for x in u))
        got = H.scores([H.residues(a, p) for p in primes], [H.residues(b, p) for p in primes], primes)
        assert got.tolist() == want


def test_moduli_cover_the_range():
    assert H.PRIMES[:3] == [251, 241, 239] and all(H.PRIMES[0] // 2 * (p // 2) * H.CHUNK < 2 ** 24 for p in H.PRIMES)
    for bound in (1, 125, 126, 10 ** 6, 2 ** 62):
        primes = H.moduli(bound)
        assert math.prod(primes) > 2 * bound and math.prod(primes[:-1]) <= 2 * bound


def table(rng, n, width=6):
    rows = []
    for i in range(n):
        centre = i % 4
        rows.append((i, [float(np.float32(rng.gauss(1.0 if j == centre else 0.3, 0.3))) for j in range(width)], centre if rng.random() < 0.9 else rng.randrange(10)))
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = table(rng, 400)
    rows += rows[:30]  # repeated rows
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(150)]  # one vector with a third of the rows: ties
    rows += [(50, rows[7][1], 3), (7, rows[8][1], 2)]  # ids with several rows
    rows += [(None, rows[0][1], 1), (2000, None, 1), (2050, rows[0][1], None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2101, [float("nan")] + [1.0] * 5, 1),
             (2102, [float("inf")] + [1.0] * 5, 1), (2103, [], 1), (2104, [2.0, 1.0], 2), (2105, [1.0] * 9, 0), (2106, [0.0] * 6, 1), (2107, [1e30] * 6, 1)]
    rows += [(-50, [-1.0] * 6, 2), (-7, [-2.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1)]
    rng.shuffle(rows)
    want = brute(rows)
    assert len(want) > 50 and run(spark, rows) == want
    monkeypatch.setattr(H, "ROW_BLOCK", 60)  # several cells
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(H, "LEAST_BLOCK", 40)
    monkeypatch.setattr(H, "AT_ONCE", 2)
    assert run(spark, rows) == want


def test_few_candidates_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 1.0], 1)]) == []
    rows = [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.7, 0.0], 2), (53, [0.2, 0.0], 2), (54, [0.6, 0.0], 3)]
    assert run(spark, rows) == brute(rows) == [(50, 51, 1, 52, 65536, 45824), (50, 51, 2, 54, 65536, 39168)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(H.OP12_SQL).fetchall()
    got = H.op12_hard_negatives(spark, sf)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == sorted(want)


@pytest.mark.parametrize("count", [1, 3])
def test_first_of(count):
    rng = np.random.default_rng(3)
    line = rng.integers(0, 4, 200)
    at = np.flatnonzero(rng.random(200) < 0.5)
    assert H.first_of(line, at, count).tolist() == sorted(at.tolist(), key=lambda j: (-line[j], j))[:count]
