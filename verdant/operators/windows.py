"""Skew-tolerant running aggregates over ordered groups.

A running aggregate over ``partitionBy(key)`` puts a whole key in one task; a
key may hold a large share of the rows.  These helpers split each key into
ordered segments (a segment expression that never decreases along the order,
such as the day of a timestamp or ``epoch div 4096``): the window runs per
(key, segment), and a small per-segment table supplies the total of all earlier
segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCHS_PER_SEGMENT = 4096


def segmented_row_number(df: DataFrame, key: str, order_cols: Sequence[str], segment: Column,
                         out_col: str) -> DataFrame:
    """1-based row number per ``key`` in ``order_cols`` order."""
    seg = df.withColumn("_seg", segment)
    counts = seg.groupBy(key, "_seg").agg(F.count(F.lit(1)).alias("_segn"))
    before = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_seg", F.coalesce(F.sum("_segn").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(key, "_seg").orderBy(*order_cols)
    numbered = seg.withColumn("_rn", F.row_number().over(within))
    return (numbered.join(offsets, [key, "_seg"])
                    .withColumn(out_col, (F.col("_off") + F.col("_rn")).cast("long"))
                    .drop("_seg", "_rn", "_off"))


def segmented_running_max(df: DataFrame, key: str, order_col: str, value: Column, out_col: str,
                          include_current: bool, segment: Column | None = None) -> DataFrame:
    """Running maximum of ``value`` per ``key`` along ``order_col``; rows before
    the current one only unless ``include_current``.  NULL when empty."""
    seg_expr = segment if segment is not None else F.floor(F.col(order_col) / F.lit(EPOCHS_PER_SEGMENT))
    seg = df.withColumn("_seg", seg_expr).withColumn("_rv", value)
    seg_max = seg.groupBy(key, "_seg").agg(F.max("_rv").alias("_segmax"))
    before = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    prefix = seg_max.select(key, "_seg", F.max("_segmax").over(before).alias("_prefix"))
    end = 0 if include_current else -1
    within = Window.partitionBy(key, "_seg").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    run = seg.withColumn("_in", F.max("_rv").over(within))
    return (run.join(prefix, [key, "_seg"])
               .withColumn(out_col, F.greatest(F.col("_prefix"), F.col("_in")))
               .drop("_seg", "_rv", "_in", "_prefix"))
