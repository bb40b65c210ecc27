"""The given tables and the input views derived from them.

Every view is a lazy DataFrame over the parquet files, so column pruning and
filters reach the scan.  The views are the library's inputs for the
operators: labelled reviews, simulated model scores, an emission log and a
training history, all derived from the given tables so that their size grows
with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prepare import split_90_5_5

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed parameters of the simulated scores (see SURVEY §7.1).
SIM_MODELS = ("m0", "m1", "m2")
SIM_NOISE_WEIGHT = 0.65
SIM_LABEL_WEIGHT = 0.35
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label): documents joined with their quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return docs.join(labels, "doc_id")


def lang_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, label): every document with its language as a string
    label (multi-class input)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))


def unit_hash(*parts) -> F.Column:
    """Uniform number in [0, 1) from the first 32 bits of an md5."""
    key = F.md5(F.concat(*parts))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def model_scores(spark: SparkSession, sf_dir: str, models=SIM_MODELS, seed: int = SEED) -> DataFrame:
    """scores(model, split, doc_id, y_true, y_pred, prob) for simulated models.

    prob = 0.65*h + 0.35*label with h uniform from md5(doc_id:model); the class is
    the argmax of two logits (a tie is class 0); split is the 90/5/5 split.
    The model list is a fixed argument and is exploded, not joined.
    """
    split = split_90_5_5(reviews(spark, sf_dir).select("doc_id", "label"), seed=seed)
    with_model = split.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    h = unit_hash(F.col("doc_id").cast("string"), F.lit(":"), F.col("model"))
    prob = F.lit(SIM_NOISE_WEIGHT) * h + F.lit(SIM_LABEL_WEIGHT) * F.col("label").cast("double")
    return with_model.select(
        "model", "split", "doc_id",
        F.col("label").cast("int").alias("y_true"),
        F.when(prob > F.lit(0.5), 1).otherwise(0).cast("int").alias("y_pred"),
        prob.alias("prob"),
    )


def emission_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project_name, emissions, ts, event_id): every event, as a report of one
    of five projects M0 .. M4.  A model of another name (m9) has no report."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return ev.select(F.concat(F.lit("M"), (F.col("user_id") % 5).cast("string"), F.lit("_experiment")).alias("project_name"),
                     (F.col("value") / F.lit(1e6)).alias("emissions"), "ts", "event_id")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training history (run, epoch, accuracy, val_accuracy, loss, val_loss)
    from the events table: one run per user, epochs in (ts, event_id) order.

    The epoch number is a running count per user computed by
    ``operators.windows.segmented_row_number`` so that one very active user does
    not end up in one task.
    """
    from ..operators.windows import segmented_row_number

    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props")
    k = F.get_json_object("props", "$.k").cast("double")
    base = ev.select(
        F.col("user_id").alias("run"), "ts", "event_id",
        (k / F.lit(100.0)).alias("accuracy"),
        (F.col("value") / F.lit(500.0)).alias("val_accuracy"),
        (F.lit(1.0) - k / F.lit(100.0)).alias("loss"),
        (F.lit(1.0) - F.col("value") / F.lit(500.0)).alias("val_loss"),
    )
    numbered = segmented_row_number(base, "run", ["ts", "event_id"], F.date_trunc("day", F.col("ts")), "epoch")
    return numbered.select("run", F.col("epoch").cast("int").alias("epoch"), "accuracy", "val_accuracy", "loss", "val_loss")
