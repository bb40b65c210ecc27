"""Model invariants, streaming = batch, save/load, bad input."""

import pytest
from pyspark.sql import functions as F

from verdant.operators import classifiers as C
from verdant.operators import prepare as P
from verdant.plans.classic import nb_scores, prepare
from verdant.plans.models import QUERIES
from verdant.sources import emissions as EM
from verdant.sources import reviews as RV
from verdant.sources.tables import reviews
from verdant.streaming.scoring import run_available, score_batches, score_stream

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def prep(spark):
    return prepare(reviews(spark, SF), max_features=2000)


def test_nb_predictions(prep):
    s = nb_scores(prep, ("val", "test"))
    n_docs = prep.split.where(F.col("split").isin("val", "test")).count()
    assert s.count() == n_docs
    assert {r[0] for r in s.select("y_pred").distinct().collect()} <= set(prep.classes)
    assert s.where((F.col("prob") < 0) | (F.col("prob") > 1)).count() == 0


def test_comparison_has_every_model(spark):
    """All four models are fitted and compared on the test split."""
    rows = QUERIES["compare_models"](spark, SF).collect()
    assert sorted((r["model"], r["split"]) for r in rows) == [(m, "test") for m in ("logreg", "nb", "neural", "svm")]
    assert len({r["n"] for r in rows}) == 1 and all(0 <= r["accuracy"] <= 1 for r in rows)
    by_split = {(r["model"], r["split"]): r for r in QUERIES["clf_all"](spark, SF).collect()}
    assert sorted(by_split) == sorted((m, s) for m in C.MODEL_NAMES for s in ("val", "test"))
    assert all(by_split[r["model"], "test"] == r for r in rows if r["model"] != "neural")
    single = QUERIES["clf_svm"](spark, SF).where("split = 'test'")
    assert single.where("y_true = y_pred").count() / single.count() == pytest.approx(by_split["svm", "test"]["accuracy"], abs=1e-6)


def test_stacked_trees(spark):
    for name in ("stack_gbt", "stack_gbt_colsample"):
        rows = QUERIES[name](spark, SF).collect()
        assert {r["y_pred"] for r in rows} <= {0, 1} and len({r["doc_id"] for r in rows}) == len(rows) > 0


def test_importances_sum_to_one(spark):
    # four validation rows at the smaller scale: no cut leaves a Hessian of 1 on both sides
    assert {r["importance"] for r in QUERIES["feature_importances"](spark, SF).collect()} == {0.0}
    rows = QUERIES["feature_importances"](spark, SF01).collect()
    assert len(rows) == 9 and all(r["importance"] >= 0 for r in rows)
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0, abs=1e-5)


def test_stream_equals_batch(spark, prep, tmp_path):
    """Naive Bayes scores of a stream, micro-batch by micro-batch, equal the batch scores."""
    from verdant.operators import features as FT
    train_w = prep.weights.where(F.col("split") == "train")
    train_docs = prep.split.where(F.col("split") == "train").select("doc_id", "label")
    lp, prior = C.fit_naive_bayes(train_w, train_docs, prep.vocab, prep.classes)
    vocab, lp, prior = prep.vocab.cache(), lp.cache(), prior.cache()

    def scorer(df):
        w = FT.tfidf(FT.doc_terms(df, keep=("doc_id",)), vocab, prep.max_features)
        return C.predict_naive_bayes(w, df, lp, prior, prep.classes, prep.max_features, keep=("doc_id",))

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    reviews(spark, SF).select("doc_id", "text").repartition(3).write.parquet(src)
    want = {r["doc_id"]: (r["y_pred"], round(r["prob"], 9)) for r in scorer(spark.read.parquet(src)).collect()}
    stream = score_stream(spark, src, spark.read.parquet(src).schema, lambda d: d, max_files_per_trigger=1)
    score_batches(stream, scorer, out)
    rows = spark.read.parquet(out).collect()
    assert len({r["batch"] for r in rows}) == 3 and len(rows) == len(want)
    assert {r["doc_id"]: (r["y_pred"], round(r["prob"], 9)) for r in rows} == want


def test_row_local_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    reviews(spark, SF).select("doc_id", "text").write.parquet(src)
    run_available(score_stream(spark, src, spark.read.parquet(src).schema, lambda d: d.select("doc_id", F.length("text").alias("n"))), out)
    want = {r["doc_id"]: len(r["text"]) for r in spark.read.parquet(src).collect()}
    assert {r["doc_id"]: r["n"] for r in spark.read.parquet(out).collect()} == want


def test_bad_input(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError):
        P.encode_labels(df, "label")
    with pytest.raises(ValueError):
        C.resolve_models("tree")
    with pytest.raises(ValueError):
        RV.load_source("nope", spark)
    with pytest.raises(ValueError):
        RV.load_source("csv", spark, "x", fraction=1.5)
    p = str(tmp_path / "bad.csv")
    spark.createDataFrame([("a",)], "text string").write.option("header", True).csv(p)
    with pytest.raises(ValueError):
        RV.read_reviews(spark, p)
    assert EM.read_emission_log(spark, str(tmp_path / "absent.csv")).count() == 0


def test_csv_edge_rows(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('text,label\n"a, quoted comma",pos\n"doubled ""quote""",neg\n"line\nbreak",pos\n,neg\nNA,10\n')
    df = RV.read_reviews(spark, str(p))
    rows = df.collect()
    assert {r["text"] for r in rows} == {"a, quoted comma", 'doubled "quote"', "line\nbreak", None, "NA"} and len({r["doc_id"] for r in rows}) == 5
    enc = {r["label"]: r["label_idx"] for r in P.encode_labels(df, mode="string").collect()}
    assert enc == {"10": 0, "neg": 1, "pos": 2}


def test_meta_logreg_is_regularised(spark):
    """C14 agrees with Newton's method on the L2 problem with C = 1."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from verdant.operators import classifiers as C
    rng = np.random.default_rng(3)
    x = rng.random((40, 3))
    y = (x @ [1.0, 2.0, -1.5] + 0.3 * rng.standard_normal(40) > 0.7).astype(float)
    model = C.meta_logreg(len(x)).fit(spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label_d"]))
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    assert np.allclose([*model.coefficients.toArray(), model.intercept], w, atol=1e-4)


def test_weighted_vote_with_zero_weights(spark):
    from verdant.operators import ensemble as E
    rows = [("a", "test", 1, 1, 0, 0.2), ("b", "test", 1, 1, 0, 0.4)]
    s = spark.createDataFrame(rows, "model string, split string, doc_id long, y_true int, y_pred int, prob double")
    w = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "model string, f1 double")
    got = E.weighted_vote(s, w).collect()
    assert len(got) == 1 and abs(got[0]["prob"] - 0.3) < 1e-9


def test_vote_with_a_missing_member_is_an_error(spark):
    from verdant.operators import ensemble as E
    rows = [("a", "test", 1, 1, 0, 0.2), ("b", "test", 1, 1, 0, 0.4), ("a", "test", 2, 1, 0, 0.2)]
    s = spark.createDataFrame(rows, "model string, split string, doc_id long, y_true int, y_pred int, prob double")
    with pytest.raises(Exception, match="no score for document 2"):
        E.soft_vote_mean(s, models=["a", "b"]).collect()
    assert E.soft_vote_mean(s.where("doc_id = 1"), models=["a", "b"]).count() == 1


def test_early_stopping_against_a_loop(spark):
    import random
    from verdant.operators import history as H
    rng, rows = random.Random(5), []
    for run in range(60):
        rows += [(run, e, rng.choice([0.1, 0.2, 0.3, 0.4, 0.5])) for e in range(1, rng.randint(2, 12))]
    rows.append((99, 1, None))
    got = {r["run"]: tuple(r)[1:] for r in H.early_stopping(spark.createDataFrame(rows, "run int, epoch int, val_accuracy double")).collect()}
    for run in {r[0] for r in rows} - {99}:
        best, best_epoch, stopped, last = None, None, None, None
        for _, e, v in [r for r in rows if r[0] == run]:
            last = e
            if best is None or v > best:
                best, best_epoch = v, e
            elif e - best_epoch >= 2:
                stopped = e
                break
        assert got[run] == (best_epoch, best, stopped, last)
    assert got[99] == (1, None, None, 1)


def test_json_sinks(spark):
    import json
    from verdant.sources import sinks as K
    labels = spark.createDataFrame([("pos", 1), ("neg", 0)], "label string, label_idx int")
    assert json.loads(K.label_mapping_json(labels).first()["json"]) == {"classes_": ["neg", "pos"]}
    ms = spark.createDataFrame([("m", "val", 0.5, 0.4, 0.3, 0.2, 7)], "model string, split string, accuracy double, f1 double, "
                               "precision double, recall double, n long")
    got = json.loads(K.summary_json(K.run_summary(ms, {"neg": 0, "pos": 1}, {"alpha": 1.0})).first()["json"])
    assert got["val"] == {"accuracy": 0.5, "f1": 0.4, "precision": 0.3, "recall": 0.2}
    assert got["label_map"] == {"neg": 0, "pos": 1} and got["n_val"] == 7 and got["params"] == {"alpha": 1.0}


def test_every_event_reaches_the_emission_figures(spark):
    from verdant.sources import tables as TB
    events = TB.table(spark, SF, "events")
    log = TB.emission_log(spark, SF)
    assert log.count() == events.count() and log.select("event_id").distinct().count() == events.select("event_id").distinct().count()
    lookup = {r["model"]: r["emissions"] for r in QUERIES["emissions_lookup"](spark, SF).collect()}
    assert sorted(lookup) == [f"m{i}" for i in range(5)]
    for i in range(5):
        last = events.where(F.col("user_id") % 5 == i).orderBy(F.desc("ts"), F.desc("event_id")).first()
        assert lookup[f"m{i}"] == pytest.approx(last["value"] / 1e6, abs=1e-6)
    of = {r["model"]: r["emissions"] for r in QUERIES["model_emissions"](spark, SF).collect()}
    assert of["m9"] == 0.0 and of["M3"] == lookup["m3"]


def test_member_sets_need_every_member(spark):
    from verdant.operators import ensemble as E
    rows = [("a", "test", 1, 1, 0, 0.2), ("b", "test", 1, 1, 0, 0.4), ("a", "test", 2, 1, 0, 0.2), ("a", "test", 2, 1, 0, 0.3)]
    s = spark.createDataFrame(rows, "model string, split string, doc_id long, y_true int, y_pred int, prob double")
    sets = spark.createDataFrame([("pair", "a"), ("pair", "b"), ("alone", "a")], "ensemble string, model string")
    with pytest.raises(Exception, match="no score for document 2"):  # two rows of one member don't make two members
        E.ensemble_votes(s, sets).collect()
    with pytest.raises(Exception, match="no score for document 2"):
        E.majority_mode(s, models=["a", "b"]).collect()
    assert E.ensemble_votes(s, sets.where("ensemble = 'alone'")).count() == 4
    assert E.ensemble_votes(s.where("doc_id = 1"), sets).count() == 4


ODD_TEXTS = ["Good good day", "caf\u00e9 CAF\u00c9 stra\u00dfe \u4f60\u597d \u4e16\u754c", "", None, "a b c", "x_1 22 x_1 22", "good day stra\u00dfe", "\u0130stanbul good-day"]


def test_terms_counted_in_tasks_equal_counts_by_document(spark):
    from verdant.operators import features as T

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string").repartition(3)
    by_doc = T.doc_terms(docs.where("text is not null"), ngram_max=2).collect()
    want = {}
    for r in by_doc:
        want[r.term] = want.get(r.term, 0) + r.tf
    chosen = T.choose_terms(docs, 1000).orderBy("term_index").collect()
    assert {r.term: r["count"] for r in chosen} == want
    terms = [r.term for r in chosen][::2]
    counted = T.count_vectors(docs, terms)
    got = {r.doc_id: dict(zip(r["index"], r.tf)) for r in counted.collect()}
    assert all(list(v) == sorted(v) for v in got.values())
    assert {(d, terms[i]): n for d, v in got.items() for i, n in v.items()} == {(r.doc_id, r.term): r.tf for r in by_doc if r.term in terms}
    assert set(got) == set(range(len(ODD_TEXTS)))
    assert {r.doc_id: (r["index"], r.tf) for r in T.count_vectors(docs, []).collect()} == {i: ([], []) for i in range(len(ODD_TEXTS))}


def test_naive_bayes_inside_rows_equals_the_one_by_terms(spark):
    import dataclasses

    from verdant.plans import classic

    words = "good bad day night film book slow fast".split()
    rows = [(i, " ".join(words[(i * k + k) % 8] for k in range(1, 5 + i % 4)), i % 2) for i in range(120)]
    # ids that repeat, rows without an id, a repeated id without any term
    rows += [(7, "good film", 1), (7, "bad book", 0), (None, "good good", 1), (None, "bad", 0), (200, "", 0), (200, "", 0), (201, "", 1)]
    split = spark.createDataFrame([(*r, ("train", "test", "val")[n % 3] if r[0] != 7 else "test") for n, r in enumerate(rows)],
                                  "doc_id long, text string, label int, split string")
    p = classic.prepare(None, split=classic.bucketed_table(split, "doc_id", "split"))
    assert p.rows is not None
    scored = classic.nb_scores(p, ("val", "test"))
    shown = lambda df: sorted((str(r.doc_id), r.split, r.y_true, r.y_pred, round(r.prob, 9)) for r in df.collect())
    assert shown(scored) == shown(classic.nb_scores(dataclasses.replace(p, rows=None), ("val", "test")))
    single = classic.prepare(None, split=classic.bucketed_table(split.where("doc_id is not null and doc_id != 7 and doc_id < 200"), "doc_id", "split"))
    # no term row is made to score documents of one row
    assert "Generate" not in classic.nb_scores(single, ("val", "test"))._jdf.queryExecution().executedPlan().toString()


def test_grams_counted_as_numbers_equal_counts_of_strings():
    import random
    from collections import Counter

    import numpy as np

    from verdant.operators import features as T

    rng = random.Random(4)
    for ngram_max in (1, 2, 3):
        texts = [[rng.choice("good bad day x_1 straße night".split()) for _ in range(rng.randrange(9))] for _ in range(40)]
        want = [Counter(" ".join(t[i:i + n]) for n in range(1, ngram_max + 1) for i in range(len(t) - n + 1)) for t in texts]
        number = T.Numbers()
        held = [np.array([number[w] for w in t], np.int64) for t in texts]
        got = [r for b in T.gram_counts(held, list(number), ngram_max) for r in zip(b.column("term").to_pylist(), b.column("n").to_pylist())]
        assert len(got) == len(dict(got)) and dict(got) == sum(want, Counter())
        # every second term, so that some are there only as the beginning of others; longer ones don't count
        terms = sorted(dict(got))[::2] + ["good " * 3 + "day", "never seen"]
        row, at = T.Grams.of(terms, ngram_max).found(texts)
        assert Counter(zip(row.tolist(), at.tolist())) == {(i, j): c[t] for i, c in enumerate(want) for j, t in enumerate(terms) if c[t]}
    assert [len(x) for x in T.Grams.of([], 2).found([["good"], []])] == [0, 0]


def test_tasks_hand_on_counts_at_a_bound(spark, monkeypatch):
    """However many words a task holds at once, the counts are those of all texts."""
    from verdant.operators import features as T

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS * 5)], "doc_id long, text string").repartition(2)
    counted = {}
    for bound in (1, 7, 1 << 20):
        monkeypatch.setattr(T, "HELD_WORDS", bound)
        counted[bound] = sorted((r.term, r["count"]) for r in T.choose_terms(docs, 1000, ngram_max=3).collect())
    assert counted[1] == counted[7] == counted[1 << 20] and ("good good day", 5) in counted[1]
