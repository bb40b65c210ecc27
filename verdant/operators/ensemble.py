"""Ensembles over the scores table ``(model, split, doc_id, y_true, y_pred, prob)``.

Members are aligned by ``doc_id`` (never by position).  A vote is one grouped
aggregate by document: rows per document are bounded by the number of member
models, and the partial aggregate combines them before the shuffle.  Member
weights come from a per-model metric table (one row per model), joined by
model name; AQE broadcasts it at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import binary_entropy, class_from_prob, confidence
from .metrics import macro_prf, summary_metrics

KEY = ("split", "doc_id")


def _members(scores: DataFrame, models: Sequence[str] | None, split: str | None) -> DataFrame:
    s = scores
    if models is not None:
        s = s.where(F.col("model").isin(list(models)))
    if split is not None:
        s = s.where(F.col("split") == split)
    return s


def _first_member_truth(models: Sequence[str] | None) -> Column:
    """y_true of the first member in the given order (the alignment reference).
    A document without a score of every named member is an error."""
    if models is None:
        return F.min_by("y_true", "model")
    models = list(dict.fromkeys(models))
    order = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    if len(models) < 64:  # one bit a member: two rows of one member don't stand for another
        present = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (order - 1).cast("int"))) == (1 << len(models)) - 1
    else:
        present = F.size(F.collect_set("model")) == len(models)
    return F.when(present, F.min_by("y_true", order)).otherwise(_lacking())


def _lacking() -> Column:
    return F.raise_error(F.concat(F.lit("a member has no score for document "), F.col("doc_id").cast("string")))


def f1_weights(scores: DataFrame, split: str, models: Sequence[str] | None = None) -> DataFrame:
    """(model, f1) macro F1 of each member on ``split``."""
    return macro_prf(_members(scores, models, split), ("model",)).select("model", "f1")


# --------------------------------------------------------------------------- E8
def vote_weights(scores: DataFrame, split: str = "val", models: Sequence[str] | None = None) -> DataFrame:
    """Macro-F1 weights normalised to sum 1 (one row per model); NULL when every
    F1 is 0."""
    w = f1_weights(scores, split, models)
    total = F.sum("f1").over(Window.partitionBy())  # one row per model
    return w.select("model", "f1", F.try_divide("f1", total).alias("weight"))


def weighted_vote(scores: DataFrame, weights: DataFrame, split: str = "test",
                  models: Sequence[str] | None = None, tie_positive: bool = True,
                  weight_col: str = "f1") -> DataFrame:
    """Per document: sum(w*p)/sum(w) over the members present; class by
    ``>= 0.5`` (``tie_positive``) or ``> 0.5``.  All-zero weights count as equal
    ones.  The weights (one row per model) are broadcast, so the scores keep
    their layout by document."""
    s = _members(scores, models, split).join(F.broadcast(weights.select("model", F.col(weight_col).alias("_w"))), "model")
    voted = s.groupBy(*KEY).agg(
        _first_member_truth(models).alias("y_true"),
        F.coalesce(F.try_divide(F.sum(F.col("_w") * F.col("prob")), F.sum("_w")), F.avg("prob")).alias("prob"))
    return voted.withColumn("y_pred", class_from_prob(F.col("prob"), tie_positive))


# --------------------------------------------------------------------------- E1
def soft_vote_pair(scores: DataFrame, model_a: str, model_b: str, weight_split: str = "test",
                   split: str = "test") -> DataFrame:
    """Two-model soft vote, F1 weights (normalised), class by ``>= 0.5``."""
    models = [model_a, model_b]
    w = f1_weights(scores, weight_split, models)
    return weighted_vote(scores, w, split, models, tie_positive=True)


# --------------------------------------------------------------------------- E2
def soft_vote_mean(scores: DataFrame, split: str = "test", models: Sequence[str] | None = None) -> DataFrame:
    voted = _members(scores, models, split).groupBy(*KEY).agg(
        _first_member_truth(models).alias("y_true"), F.avg("prob").alias("prob"))
    y = class_from_prob(F.col("prob"), True)
    return voted.withColumn("y_pred", y).withColumn("sentiment", F.when(y == 1, "pos").otherwise("neg"))


# --------------------------------------------------------------------------- E3
def weighted_vote_val(scores: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Weights = validation macro F1 (normalised), test probabilities, ``> 0.5``."""
    return weighted_vote(scores, f1_weights(scores, "val", models), "test", models, tie_positive=False)


# --------------------------------------------------------------------------- E4
def weighted_vote_f1(scores: DataFrame, models: Sequence[str] | None = None, split: str = "test") -> DataFrame:
    """Weights = macro F1 of each member on the evaluated split, ``>= 0.5``."""
    return weighted_vote(scores, f1_weights(scores, split, models), split, models, tie_positive=True)


# -------------------------------------------------------------------------- E5a
def majority_mode(scores: DataFrame, split: str = "test", models: Sequence[str] | None = None) -> DataFrame:
    """Most common member class; a tie goes to the smallest class."""
    return _members(scores, models, split).groupBy(*KEY).agg(
        _first_member_truth(models).alias("y_true"), F.mode("y_pred", True).cast("int").alias("y_pred"))


# -------------------------------------------------------------------------- E5b
def majority_mean(scores: DataFrame, split: str = "test", models: Sequence[str] | None = None) -> DataFrame:
    """Class 1 when the mean of member classes is ``>= 0.5`` (a tie goes to 1)."""
    voted = _members(scores, models, split).groupBy(*KEY).agg(
        _first_member_truth(models).alias("y_true"), F.avg("y_pred").alias("vote"))
    return voted.withColumn("y_pred", class_from_prob(F.col("vote"), True)).drop("vote")


# --------------------------------------------------------------------------- E6
def meta_features(scores: DataFrame, models: Sequence[str], with_confidence: bool = True) -> DataFrame:
    """One row per (split, doc): all probabilities, then all confidences
    |p-0.5|, then all entropies, in the given model order (an explicit list,
    so no extra job discovers pivot values)."""
    p = {m: F.max(F.when(F.col("model") == m, F.col("prob"))) for m in models}
    cols = [p[m].alias(f"p_{m}") for m in models]
    out = scores.where(F.col("model").isin(list(models))).groupBy(*KEY).agg(
        _first_member_truth(models).alias("y_true"), *cols)
    if with_confidence:
        out = out.select(*KEY, "y_true", *[F.col(f"p_{m}") for m in models],
                         *[confidence(F.col(f"p_{m}")).alias(f"conf_{m}") for m in models],
                         *[binary_entropy(F.col(f"p_{m}")).alias(f"ent_{m}") for m in models])
    return out


def meta_feature_names(models: Sequence[str], with_confidence: bool = True) -> list[str]:
    names = [f"p_{m}" for m in models]
    if with_confidence:
        names += [f"conf_{m}" for m in models] + [f"ent_{m}" for m in models]
    return names


# -------------------------------------------------------------------------- E6b
def prob_matrix(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    return meta_features(scores, models, with_confidence=False)


# --------------------------------------------------------------------------- E7
def alignment_check(scores: DataFrame, n_models: int | None = None, only_bad: bool = False) -> DataFrame:
    """Per (split, doc): number of distinct true labels and of members;
    misaligned when members disagree on the label or one is missing."""
    expected = F.lit(n_models) if n_models is not None else None
    out = scores.groupBy(*KEY).agg(F.count_distinct("y_true").alias("n_labels"),
                                   F.count_distinct("model").alias("n_models"))
    bad = F.col("n_labels") > 1
    if expected is not None:
        bad = bad | (F.col("n_models") < expected)
    out = out.withColumn("aligned", F.when(bad, 0).otherwise(1))
    return out.where(F.col("aligned") == 0) if only_bad else out


# --------------------------------------------------------------------------- E9
def ensemble_votes(scores: DataFrame, member_sets: DataFrame, split: str = "test",
                   weight_split: str | None = None) -> DataFrame:
    """Votes of every (ensemble, method) in one grouped pass.

    ``member_sets(ensemble, model)``; methods: ``majority`` (mean of member
    classes >= 0.5) and ``weighted`` (F1-weighted mean probability >= 0.5, F1
    on ``weight_split`` or the evaluated split).  A document that lacks the
    score of a member of an ensemble that votes on it is an error.
    """
    w = f1_weights(scores, weight_split or split)
    # one row per member: its bit, and the bits of its whole ensemble
    of = Window.partitionBy("ensemble")
    sets = member_sets.select("ensemble", "model").distinct().withColumn("_i", F.row_number().over(of.orderBy("model")) - 1)
    sets = sets.withColumn("_bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i"))).select(
        "ensemble", "model", "_bit", F.sum("_bit").over(of).alias("_all"))
    s = (_members(scores, None, split).join(F.broadcast(sets), "model").join(F.broadcast(w), "model"))
    voted = s.groupBy("ensemble", *KEY).agg(
        F.when(F.bit_or("_bit") == F.max("_all"), F.min_by("y_true", "model")).otherwise(_lacking()).alias("y_true"),
        F.avg("y_pred").alias("majority"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("prob")), F.sum("f1")), F.avg("prob")).alias("weighted"))
    return (voted.unpivot(["ensemble", *KEY, "y_true"], ["majority", "weighted"], "method", "score")
                 .withColumn("y_pred", class_from_prob(F.col("score"), True)).drop("score"))


def ensemble_grid(scores: DataFrame, member_sets: DataFrame, split: str = "test") -> DataFrame:
    """(ensemble, method, acc, f1, precision, recall) for every member set and method."""
    votes = ensemble_votes(scores, member_sets, split)
    return summary_metrics(votes, ("ensemble", "method")).select(
        "ensemble", "method", F.col("accuracy").alias("acc"), "f1", "precision", "recall")
