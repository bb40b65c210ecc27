"""Leaderboards and emission summaries (L1-L6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import safe_ratio
from ..functions.text import short_name
from ..sources.emissions import model_emissions


def ensemble_emissions(member_sets: DataFrame, emissions: DataFrame) -> DataFrame:
    """L3: an ensemble's emissions are the sum over its members (absent = 0)."""
    per_model = model_emissions(member_sets.select("model").distinct(), emissions)
    return (member_sets.join(per_model, "model", "left")
                       .groupBy("ensemble").agg(F.sum(F.coalesce("emissions", F.lit(0.0))).alias("emissions")))


def efficiency(results: DataFrame, acc_col: str = "acc", emissions_col: str = "emissions") -> DataFrame:
    """L4: accuracy per kg CO2; 0 when emissions are not positive."""
    return results.withColumn("efficiency", safe_ratio(F.col(acc_col), F.col(emissions_col)))


def leaderboard(model_rows: DataFrame, ensemble_rows: DataFrame, emissions: DataFrame) -> DataFrame:
    """L1: one row per base model (its own emissions) plus one per ensemble
    (emissions of all base models together); columns model, acc, f1,
    emissions.  The board has one row per model or ensemble, so the total is
    a window over the whole (tiny) board."""
    models = model_emissions(model_rows.select("model"), emissions)
    base = model_rows.join(models, "model").select("model", "acc", "f1", "emissions", F.lit(1).alias("_base"))
    ens = ensemble_rows.select(F.col("name").alias("model"), "acc", "f1",
                               F.lit(None).cast("double").alias("emissions"), F.lit(0).alias("_base"))
    total = F.sum(F.when(F.col("_base") == 1, F.col("emissions"))).over(Window.partitionBy())
    return (base.unionByName(ens)
                .withColumn("emissions", F.coalesce(F.col("emissions"), total))
                .drop("_base"))


def tradeoff_points(board: DataFrame, group_marker: str = "max") -> DataFrame:
    """L5: plot data: emissions (x), accuracy (y), short label, group flag."""
    return board.select("model", "emissions", "acc", short_name(F.col("model")).alias("label"),
                        F.when(F.lower("model").contains(group_marker), 1).otherwise(0).alias("is_max"))


def ensemble_points(results: DataFrame, group_marker: str = "max") -> DataFrame:
    """L5 for results by ensemble and method: label ``ensemble (method)``, the
    group flag from the ensemble's name."""
    return results.select(F.concat("ensemble", F.lit(" ("), "method", F.lit(")")).alias("label"), "emissions", "acc",
                          F.when(F.lower("ensemble").contains(group_marker), 1).otherwise(0).alias("is_max"))


def rounded(board: DataFrame, digits: int = 4, emission_digits: int = 6) -> DataFrame:
    """L6: report view, metrics to four decimals and emissions to six."""
    return board.select(*[F.round(c, emission_digits if c == "emissions" else digits).alias(c)
                          if c not in ("model", "ensemble", "method", "label") else F.col(c)
                          for c in board.columns])
