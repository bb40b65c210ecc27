"""Versions, markers, reload and scoring from the store."""

import pytest
from pyspark.sql import functions as F

from verdant.operators import classifiers as C
from verdant.operators import stored as ST
from verdant.plans.classic import fit_linear, nb_scores, prepare, score_linear
from verdant.plans.models import QUERIES
from verdant.sources.model_store import ModelStore
from verdant.sources.tables import reviews
from verdant.streaming.scoring import score_batches, score_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prep(spark):
    return prepare(reviews(spark, SF), max_features=2000)


@pytest.fixture
def store(spark, tmp_path):
    return ModelStore(spark, str(tmp_path / "models"))


def test_versions(spark, store):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    with pytest.raises(FileNotFoundError):
        store.load("m")
    assert store.versions("m") == {}
    assert [store.save("m", {"t": df}, {"k": i}) for i in range(3)] == [1, 2, 3]
    assert store.save("m", {"t": df}, {"k": 10}, version=10) == 10
    assert store.latest("m") == 10 and store.load("m").meta == {"k": 10}  # as numbers: 10 is over 9 and 3
    df.write.parquet(f"{store.root}/m/12/t")  # a writer that died
    df.write.parquet(f"{store.root}/m/latest/t")  # not a version
    assert store.latest("m") == 10 and store.versions("m")[12] is False
    with pytest.raises(FileNotFoundError, match="12"):
        store.load("m", 12)
    assert store.save("m", {"t": df}, {}) == 13  # numbered past the unfinished one
    with pytest.raises(ValueError, match="already"):
        store.save("m", {"t": df}, {}, version=2)
    assert store.load("m", 2).meta == {"k": 1} and store.load("m", 2).tables["t"].collect() == df.collect()
    for bad in ("a/b", "", ".. "):
        with pytest.raises(ValueError):
            store.versions(bad)
    with pytest.raises(ValueError):
        store.save("m", {"meta": df}, {})


def test_only_an_unfinished_version_is_an_error(spark, store):
    spark.range(1).write.parquet(f"{store.root}/m/1/t")
    with pytest.raises(FileNotFoundError):
        store.load("m")


def test_naive_bayes_reload_and_stream(spark, prep, store, tmp_path):
    train = prep.split.where(F.col("split") == "train")
    lp, prior = C.fit_naive_bayes(prep.weights.where(F.col("split") == "train"), train.select("doc_id", "label"), prep.vocab, prep.classes)
    ST.save_naive_bayes(store, "nb", lp, prior, prep.vocab, prep.classes, prep.max_features, prep.ngram_max)
    scorer = ST.newest_scorer(store, "nb")
    want = {r.doc_id: (r.y_pred, round(r.prob, 9)) for r in nb_scores(prep, ("train", "val", "test")).collect()}
    docs = reviews(spark, SF).select("doc_id", "text")
    assert {r.doc_id: (r.y_pred, round(r.prob, 9)) for r in scorer(docs).collect()} == want
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    docs.repartition(3).write.parquet(src)
    score_batches(score_stream(spark, src, docs.schema, lambda d: d, max_files_per_trigger=1), scorer, out)
    assert {r.doc_id: (r.y_pred, round(r.prob, 9)) for r in spark.read.parquet(out).collect()} == want


def test_linear_reload(spark, prep, store):
    models = fit_linear(prep, ["logreg", "svm"])
    for m in models:
        ST.save_linear(store, m.name, m, prep.vocab, prep.max_features, prep.ngram_max)
        want = {r.doc_id: (r.y_pred, round(r.prob, 9)) for r in score_linear(prep, [m], ("train", "val", "test")).collect()}
        got = ST.newest_scorer(store, m.name)(reviews(spark, SF).select("doc_id", "text"))
        assert {r.doc_id: (r.y_pred, round(r.prob, 9)) for r in got.collect()} == want


def test_query_reads_the_newest_complete_version(spark):
    want = {r.doc_id: (r.y_pred, r.prob) for r in QUERIES["clf_nb"](spark, SF).where("split = 'test'").collect()}
    assert {r.doc_id: (r.y_pred, r.prob) for r in QUERIES["stored_model"](spark, SF).collect()} == want
