"""Model registry look-ups: latest checkpoint (S8) and base model by path (S9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import checkpoint_step, safe_name

# Known base models in look-up order, and the default.
KNOWN_BASE_MODELS = ("roberta-base", "distilbert-base-uncased", "albert-base-v2")
DEFAULT_BASE_MODEL = "roberta-base"


def latest_checkpoint(paths: DataFrame, group_col: str = "model_dir", path_col: str = "path") -> DataFrame:
    """Per model directory, the ``checkpoint-N`` path with the largest numeric N
    (numeric, not text order: checkpoint-1760 beats checkpoint-9)."""
    step = checkpoint_step(F.col(path_col))
    return (paths.where(step.isNotNull())
                 .groupBy(group_col)
                 .agg(F.max_by(path_col, step).alias("latest_path"), F.max(step).alias("step")))


def base_model_from_path(paths: DataFrame, path_col: str = "path",
                         known: Sequence[str] = KNOWN_BASE_MODELS,
                         default: str = DEFAULT_BASE_MODEL) -> DataFrame:
    """First known base model whose path-safe name occurs in the path."""
    expr = None
    for name in reversed(list(known)):
        hit = F.col(path_col).contains(safe_name(F.lit(name)))
        expr = F.when(hit, F.lit(name)).otherwise(expr if expr is not None else F.lit(default))
    return paths.withColumn("base_model", expr)
