"""The score registry: appends, mergeable cells, boards of fitted models."""

import random

import pytest
from pyspark.sql import functions as F

from verdant.operators import metrics as M
from verdant.operators.score_registry import ScoreRegistry
from verdant.plans.models import QUERIES, fitted_members

SF = "/root/testdata/sf0.001"
SCORES = "split string, doc_id long, y_true int, y_pred int, prob double"


def rows(seed, n, start=0):
    rng = random.Random(seed)
    return [(rng.choice(["val", "test"]), start + i, rng.randrange(3), rng.randrange(3), rng.random()) for i in range(n)]


def as_set(df):
    return {tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect()}


def test_append_equals_recompute(spark, tmp_path):
    reg = ScoreRegistry(spark, str(tmp_path / "r"))
    with pytest.raises(ValueError, match="empty"):
        reg.metrics()
    reg.append("a", spark.createDataFrame(rows(1, 50), SCORES))
    before = as_set(reg.metrics())
    # a new model, and more rows of the first one
    reg.append("b.2", spark.createDataFrame(rows(2, 70), SCORES).withColumn("extra", F.lit(1)))
    assert before <= as_set(reg.metrics())
    assert reg.append("a", spark.createDataFrame(rows(3, 30, 1000), SCORES)) == 2
    assert reg.parts() == {"a": [1, 2], "b.2": [1]}
    assert as_set(reg.metrics()) == as_set(M.summary_metrics(reg.scores(), ("model", "split")).select(reg.metrics().columns))
    assert as_set(reg.cells().select("model", "split", "y_true", "y_pred", "n")) == as_set(
        M.confusion_cells(reg.scores(), ("model", "split")).select("model", "split", "y_true", "y_pred", "n"))
    with pytest.raises(ValueError, match="no scores"):
        reg.scores(["a", "c"])


def test_metrics_read_cells_only(spark, tmp_path):
    reg = ScoreRegistry(spark, str(tmp_path / "r"))
    reg.append("a", spark.createDataFrame(rows(1, 50), SCORES))
    files = reg.metrics().inputFiles()
    assert files and all("/cells/" in f for f in files)


def test_a_part_counts_once(spark, tmp_path):
    reg = ScoreRegistry(spark, str(tmp_path / "r"))
    df = spark.createDataFrame(rows(1, 50), SCORES)
    reg.append("a", df, part=7)
    with pytest.raises(ValueError, match="already"):
        reg.append("a", df, part=7)
    df.write.parquet(f"{reg.store.root}/a/8/scores")  # an append that was cut short
    df.write.parquet(f"{reg.store.root}/new/1/scores")
    assert reg.parts() == {"a": [7]} and reg.metrics().agg(F.sum("n")).first()[0] == 50


def test_boards(spark):
    full = {r["model"]: r for r in QUERIES["full_board"](spark, SF).collect()}
    part = {r["model"]: r for r in QUERIES["fitted_board"](spark, SF).collect()}
    assert sorted(full) == ["m0", "m1", "m2", "majority_voting", "meta_ensemble_gb", "stacked_ensemble_lr", "weighted_voting"]
    assert {m: full[m] for m in part} == part and len(part) == 5
    total = sum(full[m]["emissions"] for m in ("m0", "m1", "m2"))
    assert all(full[m]["emissions"] == pytest.approx(total, abs=1e-5) for m in full if not m.startswith("m0") and m not in ("m1", "m2"))
    test = fitted_members(spark, SF).scores(["m0"]).where("split = 'test'")
    assert full["m0"]["acc"] == pytest.approx(test.where("y_true = y_pred").count() / test.count(), abs=1e-6)
