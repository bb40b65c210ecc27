"""Scoring hooks: batched model functions (C9/U2), logits to probabilities
(C10/C11), text scoring (C12) and a batched text-encoding hook (U1).

User-supplied Python runs only through Arrow-batched UDFs
(``predict_batch_udf`` / ``pandas_udf``), never per row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.math import argmax, class_from_prob, softmax_at
from ..functions.text import preview


def batch_logits_udf(make_predict_fn: Callable, n_outputs: int, batch_size: int = 16, input_dim: int | None = None):
    """C9: ``make_predict_fn() -> (np.ndarray[batch, d] -> np.ndarray[batch, n_outputs])``
    wrapped as an Arrow-batched UDF; the model is built once per Python worker."""
    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                             input_tensor_shapes=[[input_dim]] if input_dim else None)


def linear_model_fn(weights: np.ndarray, bias: np.ndarray | None = None) -> Callable:
    """A fixed linear model (logits = x @ W + b) as a predict function factory."""
    w = np.asarray(weights, dtype=np.float64)
    b = np.zeros(w.shape[1]) if bias is None else np.asarray(bias, dtype=np.float64)

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return np.asarray(x, dtype=np.float64) @ w + b
        return predict
    return make


def score_logits(df: DataFrame, logits_col: str = "logits") -> DataFrame:
    """C10 + C11: positive-class softmax probability and argmax class (first on ties)."""
    return df.withColumn("prob", softmax_at(F.col(logits_col), 1)).withColumn("y_pred", argmax(F.col(logits_col)))


def label_texts(scored: DataFrame, text_col: str = "text", prob_col: str = "prob") -> DataFrame:
    """C12: class by ``prob >= 0.5``, named pos / neg, with a 120-character preview."""
    y = class_from_prob(F.col(prob_col), True)
    return scored.withColumn("y_pred", y).withColumn("sentiment", F.when(y == 1, "pos").otherwise("neg")) \
                 .withColumn("preview", preview(F.col(text_col)))


def encode_udf(fn: Callable[[list[str]], list[list[int]]]):
    """U1: a caller's batch tokenizer ``list[str] -> list[list[int]]`` as a
    pandas UDF over Arrow batches."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _encode(texts: pd.Series) -> pd.Series:
        out = fn(texts.fillna("").tolist())
        return pd.Series([list(map(int, ids)) for ids in out])
    return _encode


def word_length_tokenizer(texts: list[str]) -> list[list[int]]:
    """Example hook: one id per space-separated piece, the piece's length."""
    return [[len(w) for w in t.split(" ")] for t in texts]
