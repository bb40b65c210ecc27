"""Training-history operators: early stopping (C7) and best checkpoint (C8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import segmented_running_max


def early_stopping(history: DataFrame, monitor: str = "val_accuracy", patience: int = 2,
                   run_col: str = "run", epoch_col: str = "epoch", max_epochs: int | None = None) -> DataFrame:
    """Where patience-based early stopping on a maximised metric would stop.

    An epoch improves when its value is strictly above the best of all earlier
    epochs (the first epoch always improves).  ``wait`` = epochs since the last
    improvement; training stops at the first epoch with ``wait >= patience``.
    The restored (best) epoch is the last improvement at or before the stop.
    Output: run, best_epoch, best_value, stopped_epoch (NULL when it never
    stops), epochs_run.  One segmented running maximum (skew-safe) and one
    grouped aggregate by run.
    """
    h = history.select(run_col, epoch_col, F.col(monitor).alias("_v"))
    if max_epochs is not None:
        h = h.where(F.col(epoch_col) <= max_epochs)
    # the earliest epoch that holds the best value so far is the last improvement
    best = segmented_running_max(h, run_col, epoch_col, F.struct("_v", (-F.col(epoch_col)).alias("_back")), "_best",
                                 include_current=True)
    waited = best.select(run_col, F.col(epoch_col).alias("_epoch"), F.col("_best._v").alias("_top"),
                         F.when(F.col("_best._v").isNull(), F.col(epoch_col)).otherwise(-F.col("_best._back")).alias("_last_imp"))
    stop = F.when(F.col("_epoch") - F.col("_last_imp") >= patience, F.col("_epoch"))
    per_run = waited.groupBy(run_col).agg(
        F.min(stop).alias("stopped_epoch"), F.max("_epoch").alias("_last_epoch"),
        F.min_by("_last_imp", stop).alias("_stop_imp"), F.min_by("_top", stop).alias("_stop_top"),
        F.max("_last_imp").alias("_imp"), F.max("_top").alias("_all_top"))
    return per_run.select(run_col, F.coalesce("_stop_imp", "_imp").cast("int").alias("best_epoch"),
                          F.coalesce("_stop_top", "_all_top").alias("best_value"),
                          F.col("stopped_epoch").cast("int").alias("stopped_epoch"),
                          F.coalesce("stopped_epoch", "_last_epoch").cast("int").alias("epochs_run"))


def best_checkpoint(history: DataFrame, monitor: str = "val_accuracy", run_col: str = "run",
                    epoch_col: str = "epoch") -> DataFrame:
    """Per run, the epoch with the highest monitored value; the earliest on
    ties.  A single grouped ``max_by`` (partial aggregation, skew-safe)."""
    key = F.struct(F.col(monitor), -F.col(epoch_col))
    return history.groupBy(run_col).agg(F.max_by(epoch_col, key).cast("int").alias("best_epoch"),
                                        F.max(monitor).alias("best_value"))
