"""Review sources: labelled CSV (S1), polarity tables (S5) and the source
registry (S6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import require_columns, sample_exact
from ..operators.windows import segmented_row_number
from ..session import cut_lineage

# digests of repeated rows that are broadcast at most
MAX_BROADCAST = 1_000_000


def read_reviews(spark: SparkSession, path: str, text_col: str = "text", label_col: str = "label",
                 schema: str | None = None, null_values: bool = False, multi_line: bool = True) -> DataFrame:
    """Labelled CSV: quoted commas, doubled quotes and line breaks inside
    quotes parse; missing text/label columns raise one error naming them.
    ``null_values`` also reads the text ``NA`` as missing (pandas reading).

    Line breaks inside quotes make a file unsplittable (one task per file); for
    large inputs without them pass ``multi_line=False`` and a ``schema`` (else
    types are inferred in an extra pass), or keep the table as parquet."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if null_values:
        reader = reader.option("nullValue", "NA")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    require_columns(df, text_col, label_col)
    return add_row_id(df).select("doc_id", F.col(text_col).alias("text"), F.col(label_col).alias("label"))


def add_row_id(df: DataFrame) -> DataFrame:
    """An id from the row's content when the source has none: the digest of all
    columns and, for equal rows, which of them it is (``<md5>-<number>``).  The ids, and
    every split or sample drawn by them, don't depend on files, parts or tasks.

    One pass over the digests finds those that repeat; only rows that have one of
    these are numbered, by (digest, task) first and then over the tasks' counts, so
    a row that fills a third of the table is numbered in as many tasks as hold it."""
    if "doc_id" in df.columns:
        return df
    keyed = df.withColumn("_digest", F.md5(F.to_json(F.struct(*df.columns))))
    repeated = cut_lineage(keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_digest"))
    if repeated.count() <= MAX_BROADCAST:
        repeated = F.broadcast(repeated)
    once = keyed.join(repeated, "_digest", "left_anti").withColumn("_number", F.lit(1).cast("long"))
    again = keyed.join(repeated, "_digest", "left_semi").withColumn("_order", F.monotonically_increasing_id())
    again = segmented_row_number(again, "_digest", ["_order"], F.spark_partition_id(), "_number").drop("_order")
    return (once.unionByName(again).withColumn("doc_id", F.concat("_digest", F.lit("-"), F.col("_number").cast("string")))
            .drop("_digest", "_number"))


def read_polarity(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "text",
                  label_col: str = "label") -> DataFrame:
    df = spark.read.format(fmt).load(path)
    require_columns(df, text_col, label_col)
    return add_row_id(df).select("doc_id", F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))


Source = Callable[..., DataFrame]
_REGISTRY: dict[str, Source] = {}


def register_source(name: str, reader: Source) -> None:
    _REGISTRY[name] = reader


def load_source(name: str, spark: SparkSession, *args, fraction: float = 1.0, seed: int = 42, **kwargs) -> DataFrame:
    """Source by name with an optional exact-size sample; unknown names and
    fractions outside (0, 1] raise."""
    if not (0.0 < fraction <= 1.0):
        raise ValueError("fraction must be in (0, 1]")
    if name not in _REGISTRY:
        raise ValueError(f"unknown source {name!r}; choose one of {sorted(_REGISTRY)}")
    df = _REGISTRY[name](spark, *args, **kwargs)
    return sample_exact(df, fraction, seed) if fraction < 1.0 else df


register_source("csv", read_reviews)
register_source("polarity", read_polarity)
