"""Classic baseline flow: split -> TF-IDF -> classifier -> scores -> report.

The split table and the long TF-IDF table are each computed once and reused
by the vocabulary, every classifier and every metric (checkpointed into the
shared checkpoint folder so that later jobs neither recompute nor depend on a
long lineage).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classifiers as C
from ..operators import features as T
from ..operators import linear as LIN
from ..operators.prepare import split_80_10_10
from ..session import bucketed_table, by_doc, cut_lineage

KEEP = ("doc_id", "label", "split")
SCORE_COLS = ("model", "split", "doc_id", "y_true", "y_pred", "prob")


@dataclass
class Prepared:
    split: DataFrame      # doc_id, text, label, split
    vocab: DataFrame      # term, count, df, idf, term_index
    weights: DataFrame    # doc_id, label, split, term, weight
    classes: list
    max_features: int | None
    ngram_max: int
    vectors: tuple[DataFrame, int] | None = None  # filled by vector_rows
    rows: DataFrame | None = None  # doc_id, label, split, single, index, value: the weights by document


def prepare_split(reviews: DataFrame, seed: int = 42, test_size: float = 0.1, val_size: float = 0.1,
                  materialize: bool = True) -> DataFrame:
    """(doc_id, text, label, split): the 80/10/10 split, the input of every
    text flow.  Materialised as a table bucketed by document, so the term
    counts, TF-IDF norms and per-document scores downstream need no shuffle."""
    split = split_80_10_10(reviews.select("doc_id", "text", "label"), seed=seed,
                           test_size=test_size, val_size=val_size)
    return bucketed_table(split, "doc_id", "split") if materialize else by_doc(split)


def prepare(reviews: DataFrame, seed: int = 42, max_features: int | None = 50000, ngram_max: int = 2,
            test_size: float = 0.1, val_size: float = 0.1, materialize: bool = True,
            split: DataFrame | None = None) -> Prepared:
    """Split, vocabulary and TF-IDF table of one flow; ``split`` may be a
    split computed earlier by ``prepare_split``."""
    if split is None:
        split = prepare_split(reviews, seed, test_size, val_size, materialize)
    # class list and training size in one small aggregate (one row per class)
    per_class = split.where(F.col("split") == "train").groupBy("label").count().collect()
    classes = sorted(r["label"] for r in per_class)
    n_train = sum(r["count"] for r in per_class)
    if materialize and max_features is not None and 0 < max_features <= T.MAX_LOCAL_TERMS:
        vocab, rows = fit_rows(split, n_train, max_features, ngram_max)
        return Prepared(split, vocab, long_weights(rows, vocab), classes, max_features, ngram_max, rows=rows)
    terms = T.doc_terms(split, ngram_max=ngram_max, keep=KEEP)
    if materialize:
        # read twice (vocabulary, then weights): tokenise once
        terms = terms.persist(StorageLevel.MEMORY_AND_DISK)
    train_terms = terms.where(F.col("split") == "train")
    vocab = T.fit_vocabulary(train_terms, max_features, n_train)
    if materialize:
        vocab = cut_lineage(vocab)
    weights = T.tfidf(terms, vocab, max_features, keep=KEEP)
    if materialize:
        # bucketed like the split: scoring joins and per-document sums stay local
        weights = bucketed_table(weights, "doc_id", "tfidf")
        terms.unpersist()
    return Prepared(split, vocab, weights, classes, max_features, ngram_max)


def repeated_ids(split: DataFrame) -> DataFrame:
    """The doc_ids of more than one row (the split is bucketed by them)."""
    return split.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")


def fit_rows(split: DataFrame, n_train: int, max_features: int, ngram_max: int) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, rows): the vocabulary, and one row of TF-IDF weights per
    document, bucketed like the split.  The texts are read twice: for the total
    count of each term, and for each document's counts of the chosen terms.
    Rows that share a doc_id (or have none) count as one document per label and
    split; only they are grouped."""
    chosen = cut_lineage(T.choose_terms(split.where(F.col("split") == "train"), max_features, ngram_max=ngram_max))
    terms = [r["term"] for r in chosen.select("term", "term_index").orderBy("term_index").collect()]  # max_features rows
    again = cut_lineage(repeated_ids(split))
    repeated = not split.where(F.col("doc_id").isNull()).isEmpty() or not again.isEmpty()
    single = split.where(F.col("doc_id").isNotNull()).join(again, "doc_id", "left_anti") if repeated else split
    counts = bucketed_table(T.count_vectors(single, terms, ngram_max=ngram_max, keep=KEEP), "doc_id", "counts")
    seen = counts.where(F.col("split") == "train").select("index")
    if repeated:
        more = split.where(F.col("doc_id").isNull()).unionByName(split.join(again, "doc_id", "left_semi").select(*split.columns))
        found = cut_lineage(T.doc_terms(more, ngram_max=ngram_max, keep=KEEP).join(F.broadcast(chosen.select("term", "term_index")), "term"))
        seen = seen.unionByName(found.where(F.col("split") == "train").select(F.array("term_index").alias("index")))
    vocab = cut_lineage(T.document_frequencies(seen, chosen, n_train))
    rows = T.weigh(counts, vocab, KEEP).withColumn("single", F.lit(True))
    if repeated:
        weights = T.tfidf(found, vocab, max_features, keep=(*KEEP, "term_index"))
        grouped = weights.groupBy(*KEEP).agg(F.array_sort(F.collect_list(F.struct("term_index", "weight"))).alias("_x"))
        rows = rows.unionByName(grouped.select(*KEEP, F.col("_x.term_index").alias("index"), F.col("_x.weight").alias("value"),
                                               F.lit(False).alias("single")))
    return vocab, bucketed_table(rows, "doc_id", "tfidf")


def long_weights(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, label, split, term, weight) of rows(index, value)."""
    entries = rows.select(*KEEP, F.explode(F.arrays_zip("index", "value")).alias("_e"))
    entries = entries.select(*KEEP, F.col("_e.index").alias("term_index"), F.col("_e.value").alias("weight"))
    return entries.join(F.broadcast(vocab.select("term_index", "term")), "term_index").select(*KEEP, "term", "weight")


def nb_scores(p: Prepared, splits=("train", "val", "test"), alpha: float = 1.0) -> DataFrame:
    train = F.col("split") == "train"
    train_docs = p.split.where(train).select("doc_id", "label")
    docs = p.split.where(F.col("split").isin(list(splits))).select("doc_id", "label", "split")
    local = p.rows is not None and p.max_features * len(p.classes) <= T.MAX_BROADCAST_TERMS
    # sums by feature number first: a term's name joins one row a class
    train_w = class_totals(p.rows.where(train), p.vocab) if local else p.weights.where(train)
    log_prob, prior = C.fit_naive_bayes(train_w, train_docs, p.vocab, p.classes, alpha=alpha)

    def by_terms(docs: DataFrame, w: DataFrame) -> DataFrame:
        return C.predict_naive_bayes(w, docs, log_prob, prior, p.classes, p.max_features, keep=KEEP, term_counts=p.vocab)

    if not local:
        pred = by_terms(docs, p.weights.where(F.col("split").isin(list(splits))))
    else:
        pred = C.predict_rows(p.rows.where("single").where(F.col("split").isin(list(splits))), log_prob, prior, p.vocab, p.classes, KEEP)
        # rows that share a doc_id (or have none) have the terms of all
        others = docs.join(p.rows.where("single").select("doc_id"), "doc_id", "left_anti").select(*KEEP)
        if not others.isEmpty():
            more = long_weights(p.rows.where("not single"), p.vocab).where(F.col("split").isin(list(splits)))
            pred = pred.unionByName(by_terms(others, more))
    return pred.select(F.lit("nb").alias("model"), "split", "doc_id", F.col("label").cast("int").alias("y_true"),
                       "y_pred", "prob")


def class_totals(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(label, term, weight): the total weight of each term by label."""
    entries = rows.select("label", F.explode(F.arrays_zip("index", "value")).alias("_e"))
    sums = entries.groupBy("label", F.col("_e.index").alias("term_index")).agg(F.sum("_e.value").alias("weight"))
    return sums.join(F.broadcast(vocab.select("term_index", "term")), "term_index").select("label", "term", "weight")


def vector_rows(p: Prepared) -> tuple[DataFrame, int]:
    """(doc_id, label, split, y, index, value) of every document, y its class
    number, and the number of features.  Built from the TF-IDF table and written
    once per flow, bucketed by document like it: no text is read again and no
    row moves."""
    if p.vectors is None:
        if p.rows is None:
            vectors = T.document_vectors(p.weights, p.split, p.vocab, p.max_features)
        else:
            # a document's row as it is; those that share a doc_id have the entries of all
            vectors = p.rows.where("single").select(*KEEP, "index", "value")
            if not p.rows.where("not single").isEmpty():
                others = p.split.join(p.rows.where("single").select("doc_id"), "doc_id", "left_anti")
                weights = long_weights(p.rows.where("not single"), p.vocab)
                vectors = vectors.unionByName(T.document_vectors(weights, others, p.vocab, p.max_features))
        y = F.array_position(F.array(*[F.lit(c) for c in p.classes]), F.col("label")) - 1
        p.vectors = bucketed_table(vectors.withColumn("y", y.cast("int")), "doc_id", "vectors"), p.vocab.count()
    return p.vectors


def linear_scores(p: Prepared, names: Sequence[str], splits=("val", "test"), tol: float = 1e-4, max_iter: int = 100,
                  passes: list | None = None) -> DataFrame:
    """The scores of linear classifiers (logreg, svm) fitted together on the
    train vectors; one pass over them serves all."""
    models = fit_linear(p, names, tol, max_iter, passes)
    return score_linear(p, models, splits)


def fit_linear(p: Prepared, names: Sequence[str], tol: float = 1e-4, max_iter: int = 100, passes: list | None = None) -> list[LIN.LinearModel]:
    rows, features = vector_rows(p)
    train = rows.where(F.col("split") == "train").select("y", "index", "value")
    per = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}  # one row per class
    return LIN.fit_models(train, names, p.classes, features, [per.get(k, 0) for k in range(len(p.classes))], tol, max_iter, passes)


def score_linear(p: Prepared, models: Sequence[LIN.LinearModel], splits=("val", "test")) -> DataFrame:
    rows, _ = vector_rows(p)
    scored = LIN.score(rows.where(F.col("split").isin(list(splits))), models, ["split", "doc_id", "label"])
    y = F.element_at(F.array(*[F.lit(c) for c in p.classes]), F.col("choice") + 1)
    return scored.select("model", "split", "doc_id", F.col("label").cast("int").alias("y_true"), y.cast("int").alias("y_pred"), "prob")
