"""Numeric column expressions for scores, votes and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clipping of probabilities in the cross-entropy loss and the
# epsilon inside the entropy meta feature.
LOSS_EPSILON = 1e-7
ENTROPY_EPSILON = 1e-9


def softmax_at(logits: Column, index: int = 1) -> Column:
    """Softmax probability of class ``index`` (0-based) from an ARRAY<DOUBLE>
    of logits, with the maximum subtracted for stability."""
    m = F.array_max(logits)
    denom = F.aggregate(logits, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - m))
    return F.exp(F.element_at(logits, index + 1) - m) / denom


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_from_prob(prob: Column, tie_positive: bool = True) -> Column:
    """Binary class from the positive probability: ``>= 0.5`` when
    ``tie_positive`` else ``> 0.5`` (argmax of two logits: a tie is class 0)."""
    half = F.lit(0.5).cast("double")
    cond = prob >= half if tie_positive else prob > half
    return F.when(cond, 1).otherwise(0).cast("int")


def confidence(prob: Column) -> Column:
    return F.abs(prob - F.lit(0.5).cast("double"))


def binary_entropy(prob: Column) -> Column:
    eps = F.lit(ENTROPY_EPSILON)
    return -(prob * F.log(prob + eps) + (F.lit(1.0) - prob) * F.log(F.lit(1.0) - prob + eps))


def clipped(prob: Column, eps: float = LOSS_EPSILON) -> Column:
    return F.least(F.greatest(prob, F.lit(eps)), F.lit(1.0 - eps))


def binary_cross_entropy(y: Column, prob: Column) -> Column:
    p = clipped(prob)
    yd = y.cast("double")
    return -(yd * F.log(p) + (F.lit(1.0) - yd) * F.log(F.lit(1.0) - p))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 where the denominator is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0)).cast("double")
