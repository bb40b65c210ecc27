"""Hand-checked values (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from verdant.operators import ensemble as E
from verdant.operators import features as FT
from verdant.operators import history as H
from verdant.operators import metrics as M
from verdant.sources import checkpoints as CK

Y = [0, 0, 0, 1, 1, 1]
PROBS = {"m0": [.2, .6, .4, .9, .5, .3], "m1": [.1, .4, .5, .8, .7, .6], "m2": [.7, .3, .45, .95, .2, .5]}


@pytest.fixture(scope="module")
def votes(spark):
    rows = []
    for m, ps in PROBS.items():
        for i, (y, p) in enumerate(zip(Y, ps)):
            rows.append((m, "test", i, y, 1 if p > 0.5 else 0, p))
            rows.append((m, "val", i, y, 1 if p > 0.5 else 0, p))
    return spark.createDataFrame(rows, "model string, split string, doc_id long, y_true int, y_pred int, prob double")


def _col(df, c, order="doc_id"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_base_metrics(votes):
    m = {r["model"]: r for r in M.summary_metrics(votes.where("split = 'test'"), ("model",)).collect()}
    assert m["m0"]["accuracy"] == pytest.approx(0.5)
    assert m["m0"]["f1"] == pytest.approx(0.485714, abs=1e-6)
    assert m["m1"]["f1"] == pytest.approx(1.0)
    assert m["m2"]["f1"] == pytest.approx(0.485714, abs=1e-6)
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in
          M.confusion_matrix(votes.where("model = 'm0' AND split = 'test'"), ("model",)).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 2, (1, 1): 1}
    pc = {r["class"]: r for r in M.prf_by_class(votes.where("model = 'm0' AND split = 'test'"), ("model",)).collect()}
    assert (pc[0]["precision"], pc[0]["recall"], pc[0]["f1"]) == pytest.approx((0.5, 2 / 3, 0.571429), abs=1e-6)
    assert (pc[1]["precision"], pc[1]["recall"], pc[1]["f1"]) == pytest.approx((0.5, 1 / 3, 0.4), abs=1e-6)


def test_soft_vote_pair(votes):
    out = E.soft_vote_pair(votes, "m0", "m1")
    assert _col(out, "prob") == pytest.approx([.132692, .465385, .467308, .832692, .634615, .501923], abs=1e-6)
    assert _col(out, "y_pred") == [0, 0, 0, 1, 1, 1]


def test_weighted_and_mean(votes):
    w = E.weighted_vote_f1(votes, ["m0", "m1", "m2"])
    assert _col(w, "prob") == pytest.approx([.272464, .424638, .463043, .861594, .527536, .501449], abs=1e-6)
    assert _col(w, "y_pred") == [0, 0, 0, 1, 1, 1]
    mean = E.soft_vote_mean(votes)
    assert _col(mean, "prob") == pytest.approx([.333333, .433333, .45, .883333, .466667, .466667], abs=1e-6)
    assert _col(mean, "y_pred") == [0, 0, 0, 1, 0, 0]


def test_majority_rules(votes):
    three = E.majority_mode(votes, models=["m0", "m1", "m2"])
    assert _col(three, "y_pred") == [0, 0, 0, 1, 0, 0]
    m = M.summary_metrics(three.withColumn("g", F.lit(1)), ("g",)).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == pytest.approx((2 / 3, 0.8, 2 / 3, 0.625), abs=1e-6)
    assert _col(E.majority_mode(votes, models=["m0", "m1"]), "y_pred") == [0, 0, 0, 1, 0, 0]
    assert _col(E.majority_mean(votes, models=["m0", "m1"]), "y_pred") == [0, 1, 0, 1, 1, 1]


def test_threshold_rules(spark):
    from verdant.functions.math import class_from_prob
    df = spark.createDataFrame([(0.5,), (0.49,), (0.51,)], "p double")
    ge = [r[0] for r in df.select(class_from_prob(F.col("p"), True)).collect()]
    gt = [r[0] for r in df.select(class_from_prob(F.col("p"), False)).collect()]
    assert ge == [1, 0, 1] and gt == [0, 0, 1]


def test_undefined_precision(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1)], "y_true int, y_pred int").withColumn("g", F.lit("x"))
    rep = {r["label"]: r for r in M.classification_report(df, ("g",)).collect()}
    assert rep["accuracy"]["precision"] == pytest.approx(1 / 3)
    assert rep["accuracy"]["support"] == pytest.approx(1 / 3)
    assert (rep["0"]["precision"], rep["0"]["recall"], rep["0"]["f1"]) == (0.0, 0.0, 0.0)
    assert (rep["1"]["precision"], rep["1"]["recall"], rep["1"]["f1"]) == pytest.approx((1 / 3, 1.0, 0.5))
    assert (rep["macro avg"]["precision"], rep["macro avg"]["recall"], rep["macro avg"]["f1"]) == \
        pytest.approx((1 / 6, 0.5, 0.25))
    assert (rep["weighted avg"]["precision"], rep["weighted avg"]["recall"], rep["weighted avg"]["f1"]) == \
        pytest.approx((1 / 9, 1 / 3, 1 / 6))


def test_meta_features(spark):
    df = spark.createDataFrame([("m0", "test", 1, 1, 1, 0.9)], "model string, split string, doc_id long, y_true int, y_pred int, prob double")
    r = E.meta_features(df, ["m0"]).first()
    assert r["conf_m0"] == pytest.approx(0.4)
    assert r["ent_m0"] == pytest.approx(0.325082971, abs=1e-9)


def test_latest_checkpoint_numeric(spark):
    df = spark.createDataFrame([("d", "d/checkpoint-9"), ("d", "d/checkpoint-88"), ("d", "d/checkpoint-1760"), ("d", "d/logs")],
                               "model_dir string, path string")
    assert CK.latest_checkpoint(df).first()["latest_path"] == "d/checkpoint-1760"


def test_early_stopping(spark):
    h = spark.createDataFrame([(1, e + 1, v) for e, v in enumerate([.70, .80, .80, .79, .90])],
                              "run long, epoch int, val_accuracy double")
    r = H.early_stopping(h).first()
    assert (r["best_epoch"], r["stopped_epoch"], r["epochs_run"]) == (2, 4, 4)
    assert r["best_value"] == pytest.approx(0.80)
    never = spark.createDataFrame([(1, 1, .1), (1, 2, .2), (1, 3, .3)], "run long, epoch int, val_accuracy double")
    r = H.early_stopping(never).first()
    assert r["stopped_epoch"] is None and r["epochs_run"] == 3 and r["best_epoch"] == 3


def test_decode_and_cap(spark):
    index = spark.createDataFrame([("the", 1), ("film", 2)], "word string, id long")
    enc = spark.createDataFrame([(1, [1, 4, 5, 9])], "doc_id long, ids array<int>")
    assert FT.decode_reviews(enc, index).first()["text"] == "? the film ?"
    capped = FT.cap_vocabulary(enc, 5)
    assert FT.decode_reviews(capped, index).first()["text"] == "? the ? ?"


def test_padding(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, [1, 2, 3, 4, 5])], "doc_id long, ids array<int>")
    out = {r["doc_id"]: r["ids"] for r in FT.pad_sequences(df, 4).collect()}
    assert out == {1: [5, 6, 0, 0], 2: [1, 2, 3, 4]}
    enc = {r["doc_id"]: r["attention_mask"] for r in FT.encode_fixed(df, 4).collect()}
    assert enc == {1: [1, 1, 0, 0], 2: [1, 1, 1, 1]}
