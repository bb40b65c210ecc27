"""Sinks: CSV / JSON / parquet writers for reviews, reports, summaries,
leaderboards, label maps and fitted models (K1-K6).

Writers are plain ``DataFrameWriter`` calls: every task writes its own part
file, nothing is collected to the driver.  Prediction arrays stay rows of the
scores table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1/K2/K4: CSV with header; quotes, embedded line breaks and surrounding
    spaces survive a read with ``sources.reviews.read_reviews``."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def run_summary(metrics: DataFrame, label_map: dict | None, params: dict) -> DataFrame:
    """K3: one row per model from ``metrics(model, split, accuracy, f1,
    precision, recall, n)`` (all splits): validation and test metric structs,
    split sizes, the label map (``MAP<STRING,INT>``, NULL for numeric labels)
    and the parameters.  One grouped aggregate by model."""
    def metric_struct(split: str):
        return F.struct(*[F.max(F.when(F.col("split") == split, F.col(c))).alias(c)
                          for c in ("accuracy", "f1", "precision", "recall")])
    sizes = [F.max(F.when(F.col("split") == s, F.col("n"))).cast("long").alias(f"n_{s}") for s in ("train", "val", "test")]
    out = metrics.groupBy("model").agg(metric_struct("val").alias("val"), metric_struct("test").alias("test"), *sizes)
    if label_map:
        lm = F.create_map(*[x for k, v in sorted(label_map.items(), key=lambda kv: kv[1])
                            for x in (F.lit(str(k)), F.lit(int(v)))])
    else:
        lm = F.lit(None).cast("map<string,int>")
    return out.withColumn("label_map", lm).withColumn(
        "params", F.struct(*[F.lit(v).alias(k) for k, v in params.items()]))


def summary_json(summary: DataFrame) -> DataFrame:
    """One JSON document per model row."""
    return summary.select("model", F.to_json(F.struct(*summary.columns)).alias("json"))


def label_mapping_json(label_map: DataFrame) -> DataFrame:
    """K5: ``{"classes_": [...]}`` in index order, as a one-row JSON string."""
    classes = F.transform(F.array_sort(F.collect_list(F.struct("label_idx", F.col("label").cast("string").alias("label")))),
                          lambda s: s["label"])
    return label_map.agg(F.to_json(F.struct(classes.alias("classes_"))).alias("json"))
