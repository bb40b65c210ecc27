"""Append-only registry of model scores.

Each append is one version of ``<model>`` in a model store: the rows (split, doc_id,
y_true, y_pred, prob) and their confusion cells (split, y_true, y_pred, n).  Cells
of different appends add up, so metrics of any number of models come from the
cells alone: a new model, or more rows of one, reads no score again.  Votes and
stacked models read the rows of their members.  An append that was cut short has
no marker and counts for nothing; numbering the appends (``part``) makes a repeated
one an error instead of a second count.  The rows of a model's appends must be
of different documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.model_store import ModelStore
from . import metrics as M

COLUMNS = ("split", "doc_id", "y_true", "y_pred", "prob")


class ScoreRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, ModelStore(spark, root)

    def append(self, model: str, scores: DataFrame, part: int | None = None) -> int:
        """Adds scores of a model; returns the number of this part."""
        number = self.store.save(model, {"scores": scores.select(*COLUMNS)}, {}, part, complete=False)
        rows = self.store.table(model, number, "scores")  # counted from what was written
        self.store.add(model, number, {"cells": M.confusion_cells(rows, ("split",))})
        self.store.complete(model, number)
        return number

    def parts(self) -> dict[str, list[int]]:
        """Complete parts of each model."""
        found = {m: sorted(n for n, done in self.store.versions(m).items() if done) for m in self.store.names()}
        return {m: ns for m, ns in found.items() if ns}

    def _all(self, table: str, models: Sequence[str] | None) -> DataFrame:
        have = self.parts()
        for m in models or ():
            if m not in have:
                raise ValueError(f"no scores of model {m!r}; there are {sorted(have)}")
        each = [self.store.table(m, n, table).withColumn("model", F.lit(m)) for m in (models or sorted(have)) for n in have[m]]
        if not each:
            raise ValueError("the registry is empty")
        return reduce(DataFrame.unionByName, each)

    def scores(self, models: Sequence[str] | None = None) -> DataFrame:
        return self._all("scores", models).select("model", *COLUMNS)

    def cells(self, models: Sequence[str] | None = None) -> DataFrame:
        """(model, split, y_true, y_pred, n)."""
        return self._all("cells", models).groupBy("model", "split", "y_true", "y_pred").agg(F.sum("n").alias("n"))

    def metrics(self, models: Sequence[str] | None = None) -> DataFrame:
        """accuracy, n and macro precision / recall / F1 by model and split."""
        return M.metrics_of_cells(self.cells(models), ("model", "split"))
