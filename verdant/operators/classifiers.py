"""Classifiers.

* Multinomial naive Bayes (alpha = 1, unsmoothed class prior) is built from
  DataFrame aggregates over the long TF-IDF table, so it is exact and
  checkable in SQL: per (class, term) weight sums, a broadcast of the bounded
  (classes x vocabulary) log-probability table, and one grouped sum per
  (document, class).
* Logistic regression and the linear SVM are fitted together by ``linear`` over
  one table of sparse TF-IDF vectors; boosted trees are in ``boosting``.
* The meta logistic regression is a stock ``pyspark.ml`` estimator.
* The neural text classifier is in ``neural``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .features import MAX_BROADCAST_TERMS


# --------------------------------------------------------------------------- C2
def class_weights(train: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c), one row per class."""
    counts = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    every = Window.partitionBy()  # one row per class
    return counts.select(label_col, "n_c", (F.sum("n_c").over(every).cast("double")
                                             / (F.count(F.lit(1)).over(every) * F.col("n_c"))).alias("weight"))


# --------------------------------------------------------------------------- C4
def fit_naive_bayes(train_weights: DataFrame, train_docs: DataFrame, vocab: DataFrame, classes: Sequence,
                    label_col: str = "label", alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Returns (log_prob(term, class, flp), prior(class, prior)).

    ``train_weights(doc_id, label, term, weight)``; ``train_docs(doc_id, label)``
    counts documents for the prior, including documents without any term.
    flp = ln((fc + alpha) / (sum_terms fc + alpha * V)); prior = ln(n_c / n).
    """
    classes = list(classes)
    v = vocab.select("term").withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    fc = train_weights.groupBy(F.col(label_col).alias("class"), "term").agg(F.sum("weight").alias("fc"))
    dense = v.join(fc, ["class", "term"], "left").withColumn("fc", F.coalesce("fc", F.lit(0.0)))
    # per-class denominators: a grouped aggregate (one row per class, broadcast
    # back), not a window by class, which would put a class's whole
    # vocabulary into one task
    totals = dense.groupBy("class").agg((F.sum("fc") + F.lit(alpha) * F.count(F.lit(1))).alias("_den"))
    log_prob = (dense.join(F.broadcast(totals), "class")
                     .select("term", "class", F.log((F.col("fc") + alpha) / F.col("_den")).alias("flp")))
    docs = train_docs.groupBy(F.col(label_col).alias("class")).agg(F.count(F.lit(1)).alias("n_c"))
    prior = docs.select("class", F.log(F.col("n_c") / F.sum("n_c").over(Window.partitionBy())).alias("prior"))
    return log_prob, prior


HOT_TERMS = 100_000


def _term_join(weights: DataFrame, log_prob: DataFrame, n_classes: int, max_features: int | None,
               term_counts: DataFrame | None, hot_terms: int | None) -> DataFrame:
    """weights ⋈ log_prob on term.  Capped vocabulary: one broadcast join.
    Uncapped with ``term_counts(term, count)``: the ``hot_terms`` most
    frequent terms' rows are broadcast (the hot keys of this join), the others
    are joined with a shuffle that by construction has no hot key.  Uncapped
    without counts: a shuffled join (AQE splits skewed partitions)."""
    if max_features is not None and max_features * n_classes <= MAX_BROADCAST_TERMS:
        return weights.join(F.broadcast(log_prob), "term")
    if term_counts is None:
        return weights.join(log_prob, "term")
    from .features import top_k_by_count
    n_hot = HOT_TERMS if hot_terms is None else hot_terms
    hot_terms_df = top_k_by_count(term_counts.select("term", "count"), n_hot, "count", "term").select("term")
    hot = log_prob.join(F.broadcast(hot_terms_df), "term")          # n_hot x classes rows
    rare = log_prob.join(F.broadcast(hot_terms_df), "term", "left_anti")
    first = weights.join(F.broadcast(hot), "term")
    rest = weights.join(F.broadcast(hot_terms_df), "term", "left_anti").join(rare, "term")
    return first.unionByName(rest)


def predict_naive_bayes(weights: DataFrame, docs: DataFrame, log_prob: DataFrame, prior: DataFrame,
                        classes: Sequence, max_features: int | None, keep=("doc_id", "label"),
                        term_counts: DataFrame | None = None, hot_terms: int | None = None) -> DataFrame:
    """(keep..., y_pred, prob): argmax of prior + sum(weight * flp), first
    (smallest) class on ties; prob = posterior of class 1 (binary) or of the
    predicted class.

    Plan: the (term, class) table is bounded by vocabulary x classes and is
    broadcast; per-(document, class) sums and the per-document map of class
    sums are aggregated on ``doc_id``, so when ``weights`` and ``docs`` are
    hash-partitioned by ``doc_id`` (``session.by_doc``) scoring runs without
    any shuffle.  Class scores are then built inside each row from the k
    priors (one value per class, read once).
    """
    classes = sorted(classes)
    priors = {r["class"]: r["prior"] for r in prior.collect()}
    joined = _term_join(weights.select("doc_id", "term", "weight"), log_prob, len(classes), max_features,
                        term_counts, hot_terms)
    sums = (joined
                   .groupBy("doc_id", "class").agg(F.sum(F.col("weight") * F.col("flp")).alias("_s"))
                   .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "_s"))).alias("_m")))
    scored = docs.select(*keep).join(sums, "doc_id", "left")
    return _decided(scored, [F.coalesce(F.col("_m")[F.lit(c)], F.lit(0.0)) for c in classes], priors, classes, keep)


def _decided(scored: DataFrame, sums: Sequence[Column], priors: dict, classes: Sequence, keep) -> DataFrame:
    """(keep..., y_pred, prob) of rows with one sum a class."""
    score_cols = [F.lit(float(priors.get(c, float("-inf")))) + s for c, s in zip(classes, sums)]
    scored = scored.withColumn("_sc", F.array(*score_cols))
    best = F.array_position(F.col("_sc"), F.array_max("_sc")).cast("int")
    y = F.element_at(F.array(*[F.lit(c) for c in classes]), best)
    m = F.array_max("_sc")
    lse = m + F.log(F.aggregate("_sc", F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    target = F.col("_sc")[classes.index(1)] if set(classes) == {0, 1} else m
    yc = y.cast("int") if set(classes) == {0, 1} else y
    return scored.select(*keep, yc.alias("y_pred"), F.exp(target - lse).alias("prob"))


def predict_rows(rows: DataFrame, log_prob: DataFrame, prior: DataFrame, vocab: DataFrame, classes: Sequence,
                 keep=("doc_id", "label")) -> DataFrame:
    """``predict_naive_bayes`` for rows(keep..., index, value) that hold all terms of
    their document: the sums are made inside the row from a broadcast (class x term)
    array, so no term row is exploded, joined or grouped."""
    spark = rows.sparkSession
    ship_package(spark)
    classes = sorted(classes)
    priors = {r["class"]: r["prior"] for r in prior.collect()}
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")).cast("int") - 1
    got = (log_prob.join(F.broadcast(vocab.select("term", "term_index")), "term")
           .select(number.alias("at"), "term_index", "flp").toArrow())  # classes x terms
    table = np.zeros((len(classes), got.num_rows // len(classes)))
    table[got.column("at").to_numpy(), got.column("term_index").to_numpy()] = got.column("flp").to_numpy()
    sent = spark.sparkContext.broadcast(table)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, value = b.column("index").flatten().to_numpy(), b.column("value").flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), b.column("index").value_lengths().to_numpy(zero_copy_only=False))
            sums = np.column_stack([np.bincount(row, weights=value * t[index], minlength=b.num_rows) for t in sent.value])
            offsets = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=[*keep, "_s"])

    scored = rows.select(*keep, "index", "value").mapInArrow(run, f"{kept}, _s array<double>")
    return _decided(scored, [F.col("_s")[i] for i in range(len(classes))], priors, classes, keep)


# ------------------------------------------------------------------ C1/C3/C5
MODEL_NAMES = ("logreg", "svm", "nb")


def resolve_models(name: str) -> list[str]:
    if name == "all":
        return list(MODEL_NAMES)
    if name not in MODEL_NAMES:
        raise ValueError(f"unknown model {name!r}")
    return [name]


def deterministic_order(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Fixed hash partitioning by ``key`` and a sort inside each partition.

    An estimator whose result depends on row order then sees the same rows in the
    same order on every run, without a global sort into one task.  The count
    defaults to ``spark.sql.shuffle.partitions``; AQE does not change an
    explicit repartition count."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key)


# ---------------------------------------------------------------------- C14
def stack_features(meta: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(feature_cols), outputCol="features").transform(
        meta.withColumn("label_d", F.col("y_true").cast("double")))


def meta_logreg(n_rows: int, max_iter: int = 1000) -> LogisticRegression:
    """Meta logistic regression over ``n_rows`` training rows: L2 with C = 1
    (the mean loss is regularised by 1/n), standardisation off."""
    return LogisticRegression(featuresCol="features", labelCol="label_d", maxIter=max_iter, standardization=False,
                              regParam=1.0 / max(n_rows, 1), tol=1e-10)
