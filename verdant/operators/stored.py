"""Fitted text classifiers as versions of a model store, and scorers read from it.

A scorer takes rows (doc_id, text) and returns (doc_id, y_pred, prob); it needs
nothing but the stored tables, so a stream or another program can score with
the newest complete version.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.model_store import ModelStore, Stored
from . import classifiers as C
from . import features as FT
from . import linear as LIN

Scorer = Callable[[DataFrame], DataFrame]


def save_naive_bayes(store: ModelStore, name: str, log_prob: DataFrame, prior: DataFrame, vocab: DataFrame, classes: list,
                     max_features: int | None, ngram_max: int, version: int | None = None) -> int:
    """Tables log_prob(term, class, flp), prior(class, prior) and vocab."""
    meta = {"kind": "naive_bayes", "classes": list(classes), "max_features": max_features, "ngram_max": ngram_max}
    return store.save(name, {"log_prob": log_prob, "prior": prior, "vocab": vocab}, meta, version)


def save_linear(store: ModelStore, name: str, model: LIN.LinearModel, vocab: DataFrame, max_features: int | None, ngram_max: int,
                version: int | None = None) -> int:
    """Tables coefficients(output, index, value), the intercept at the last index, and vocab."""
    out, index = np.nonzero(model.coefficients)
    spark = vocab.sparkSession
    rows = spark.createDataFrame(list(zip(out.tolist(), index.tolist(), model.coefficients[out, index].tolist())), "output int, index int, value double")
    meta = {"kind": "linear", "model": model.name, "classes": list(model.classes), "shape": list(model.coefficients.shape),
            "max_features": max_features, "ngram_max": ngram_max}
    return store.save(name, {"coefficients": rows, "vocab": vocab}, meta, version)


def linear_model(stored: Stored) -> LIN.LinearModel:
    w = np.zeros(stored.meta["shape"])
    for r in stored.tables["coefficients"].collect():  # at most LIN.MAX_COEFFICIENTS
        w[r["output"], r["index"]] = r["value"]
    return LIN.LinearModel(stored.meta["model"], stored.meta["classes"], w)


def weights_of(docs: DataFrame, stored: Stored) -> DataFrame:
    """The TF-IDF weights of texts by the stored vocabulary."""
    m = stored.meta
    return FT.tfidf(FT.doc_terms(docs, ngram_max=m["ngram_max"], keep=("doc_id",)), stored.tables["vocab"], m["max_features"])


def scorer(stored: Stored) -> Scorer:
    """The scorer of a stored classifier."""
    m = stored.meta
    if m["kind"] == "naive_bayes":
        return lambda docs: C.predict_naive_bayes(weights_of(docs, stored), docs, stored.tables["log_prob"], stored.tables["prior"], m["classes"],
                                                  m["max_features"], keep=("doc_id",))
    if m["kind"] == "linear":
        model = linear_model(stored)

        def score(docs: DataFrame) -> DataFrame:
            rows = FT.document_vectors(weights_of(docs, stored), docs, stored.tables["vocab"], m["max_features"], keep=("doc_id",))
            y = F.element_at(F.array(*[F.lit(c) for c in m["classes"]]), F.col("choice") + 1)
            return LIN.score(rows, [model], ["doc_id"]).select("doc_id", y.alias("y_pred"), "prob")

        return score
    raise ValueError(f"unknown kind of model {m['kind']!r}")


def newest_scorer(store: ModelStore, name: str) -> Scorer:
    """The scorer of the newest complete version; an error if there is none."""
    return scorer(store.load(name))
