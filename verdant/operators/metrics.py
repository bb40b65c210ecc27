"""Evaluation aggregates over a scores table.

All functions take a DataFrame with ``y_true`` / ``y_pred`` (and ``prob``)
plus any grouping columns, and evaluate every group in one pass: the
confusion cells ``(group, y_true, y_pred, n)`` are a single partial/final hash
aggregate, and every further metric is computed from that small table.
Classes are the sorted union of true and predicted labels of each group;
undefined ratios are 0 (zero-division rule).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import binary_cross_entropy, safe_ratio

Group = Sequence[str]


def confusion_cells(scores: DataFrame, group: Group, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return (scores.groupBy(*group, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred"))
                  .agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------- M1
def accuracy(scores: DataFrame, group: Group = ("model", "split"), y_true: str = "y_true",
             y_pred: str = "y_pred") -> DataFrame:
    hit = F.when(F.col(y_true) == F.col(y_pred), 1.0).otherwise(0.0)
    return scores.groupBy(*group).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- M2
def class_counts(cells: DataFrame, group: Group) -> DataFrame:
    """Per class: tp, predicted count, support (true count)."""
    as_true = cells.select(*group, F.col("y_true").alias("class"),
                           F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                           F.lit(0).cast("long").alias("pred"), F.col("n").alias("support"))
    as_pred = cells.select(*group, F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("tp"),
                           F.col("n").alias("pred"), F.lit(0).cast("long").alias("support"))
    return (as_true.unionByName(as_pred).groupBy(*group, "class")
                   .agg(F.sum("tp").alias("tp"), F.sum("pred").alias("pred"), F.sum("support").alias("support")))


def _prf(counts: DataFrame, group: Group, *more: str) -> DataFrame:
    return counts.select(
        *group, "class", *more,
        safe_ratio(F.col("tp").cast("double"), F.col("pred").cast("double")).alias("precision"),
        safe_ratio(F.col("tp").cast("double"), F.col("support").cast("double")).alias("recall"),
        safe_ratio(2.0 * F.col("tp").cast("double"), (F.col("pred") + F.col("support")).cast("double")).alias("f1"),
        F.col("support").cast("long").alias("support"),
    )


def prf_by_class(scores: DataFrame, group: Group = ("model", "split"), y_true: str = "y_true",
                 y_pred: str = "y_pred") -> DataFrame:
    cells = confusion_cells(scores, group, y_true, y_pred)
    return _prf(class_counts(cells, group), group)


# --------------------------------------------------------------------------- M3
def macro_prf(scores: DataFrame, group: Group = ("model", "split"), y_true: str = "y_true",
              y_pred: str = "y_pred") -> DataFrame:
    per_class = prf_by_class(scores, group, y_true, y_pred)
    return per_class.groupBy(*group).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                                         F.avg("f1").alias("f1"))


def summary_metrics(scores: DataFrame, group: Group = ("model", "split"), y_true: str = "y_true",
                    y_pred: str = "y_pred") -> DataFrame:
    """accuracy and macro precision / recall / F1 per group, from one
    confusion aggregate."""
    return metrics_of_cells(confusion_cells(scores, group, y_true, y_pred), group)


def metrics_of_cells(cells: DataFrame, group: Group) -> DataFrame:
    """accuracy, n and macro precision / recall / F1 per group, from confusion
    cells (group, y_true, y_pred, n).  The classes' right answers and supports add
    up to the group's, so one aggregate over classes gives all of them."""
    if not group:
        raise ValueError("summary_metrics needs at least one grouping column")
    counts = class_counts(cells, group)
    per_class = _prf(counts, group, "tp")
    return per_class.groupBy(*group).agg(
        (F.sum("tp").cast("double") / F.sum("support").cast("double")).alias("accuracy"), F.sum("support").cast("long").alias("n"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


# --------------------------------------------------------------------------- M4
def confusion_matrix(scores: DataFrame, group: Group = ("model", "split"), y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """All (true, predicted) pairs over the sorted label union of each group,
    zero cells kept; built by exploding the per-group label array."""
    cells = confusion_cells(scores, group, y_true, y_pred)
    labels = cells.groupBy(*group).agg(
        F.array_sort(F.array_union(F.collect_set("y_true"), F.collect_set("y_pred"))).alias("_labels"))
    grid = (labels.select(*group, F.explode("_labels").alias("y_true"), "_labels")
                  .select(*group, "y_true", F.explode("_labels").alias("y_pred")))
    return (grid.join(cells, [*group, "y_true", "y_pred"], "left")
                .select(*group, "y_true", "y_pred", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


# --------------------------------------------------------------------------- M5
def classification_report(scores: DataFrame, group: Group = ("model",), y_true: str = "y_true",
                          y_pred: str = "y_pred") -> DataFrame:
    """Class rows, then 'accuracy' (its value in every column), 'macro avg' and
    'weighted avg'; columns label, precision, recall, f1, support (DOUBLE)."""
    cells = confusion_cells(scores, group, y_true, y_pred)
    per_class = _prf(class_counts(cells, group), group)
    rows = per_class.select(*group, F.col("class").cast("string").alias("label"), "precision", "recall", "f1",
                            F.col("support").cast("double").alias("support"))
    total = F.sum("support").cast("double")
    macro = per_class.groupBy(*group).agg(
        F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), total.alias("support"))
    weighted = per_class.groupBy(*group).agg(
        F.lit("weighted avg").alias("label"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"), total.alias("support"))
    acc_val = (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).cast("double")
               / F.sum("n").cast("double"))
    acc = (cells.groupBy(*group).agg(acc_val.alias("_a"))
                .select(*group, F.lit("accuracy").alias("label"), F.col("_a").alias("precision"),
                        F.col("_a").alias("recall"), F.col("_a").alias("f1"), F.col("_a").alias("support")))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


# --------------------------------------------------------------------------- M6
def log_loss(scores: DataFrame, group: Group = ("model", "split"), y_true: str = "y_true",
             prob: str = "prob") -> DataFrame:
    return scores.groupBy(*group).agg(F.avg(binary_cross_entropy(F.col(y_true), F.col(prob))).alias("loss"))


# --------------------------------------------------------------------------- M7
def metrics_by_split(scores: DataFrame, model_col: str = "model", split_col: str = "split",
                     splits: Sequence[str] = ("val", "test")) -> DataFrame:
    return summary_metrics(scores.where(F.col(split_col).isin(list(splits))), (model_col, split_col))


# --------------------------------------------------------------------------- M8
def metrics_by_epoch(epoch_scores: DataFrame, run_col: str = "run", epoch_col: str = "epoch") -> DataFrame:
    return summary_metrics(epoch_scores, (run_col, epoch_col))


# --------------------------------------------------------------------------- M9
def learning_curves(history: DataFrame, run_col: str = "run", epoch_col: str = "epoch",
                    curves: Sequence[str] = ("accuracy", "val_accuracy", "loss", "val_loss")) -> DataFrame:
    return history.unpivot([run_col, epoch_col], list(curves), "curve", "value")


# --------------------------------------------------------------------------- U3
def custom_metric(scores: DataFrame, group: Group, metrics: dict[str, Column]) -> DataFrame:
    """A caller-supplied metric callback: named aggregate expressions evaluated
    per group in the same pass."""
    return scores.groupBy(*group).agg(*[expr.alias(name) for name, expr in metrics.items()])
