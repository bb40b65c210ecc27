"""Scoring of a stream (C12 on Structured Streaming).

A row-local scorer (``PipelineModel.transform``) is applied to the streaming
source itself (``score_stream``, ``run_available``).  A scorer that aggregates
per document (naive Bayes) is applied to every micro-batch (``score_batches``);
a document is one row, so no state is kept between batches.
Checkpointing of the query goes to the session's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..session import scratch_path


def score_stream(spark: SparkSession, source_dir: str, schema: StructType,
                 scorer: Callable[[DataFrame], DataFrame], fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return scorer(reader.load(source_dir))


def run_available(scored: DataFrame, sink_dir: str, fmt: str = "parquet", checkpoint: str | None = None) -> None:
    """Process everything available now into ``sink_dir`` (exactly-once file
    sink with its own checkpoint), then stop."""
    spark = scored.sparkSession
    q = (scored.writeStream.format(fmt).option("path", sink_dir)
               .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
               .trigger(availableNow=True).start())
    q.awaitTermination()


def score_batches(source: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink_dir: str,
                  checkpoint: str | None = None) -> None:
    """Score everything available now, batch by batch, into ``sink_dir/batch=<id>``.
    A batch repeated after a failure replaces its own folder, so every row is
    written once."""
    def one(batch: DataFrame, number: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{sink_dir}/batch={number}")

    q = (source.writeStream.foreachBatch(one)
               .option("checkpointLocation", checkpoint or scratch_path(source.sparkSession, "stream-ckpt"))
               .trigger(availableNow=True).start())
    q.awaitTermination()
