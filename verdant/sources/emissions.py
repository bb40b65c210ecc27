"""Emission log source (S7) and model lookups (L2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prepare import require_columns

# Fixed value: suffix some trackers append to project names.
PROJECT_SUFFIX = "_experiment"

EMISSION_SCHEMA = T.StructType([
    T.StructField("project_name", T.StringType()),
    T.StructField("emissions", T.DoubleType()),
    T.StructField("ord", T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])),
])


def read_emission_log(spark: SparkSession, path: str) -> DataFrame:
    """CSV emission log; an absent path gives an empty table (not an error).
    ``ord`` is (file path, row order within the file), or the file's own
    ``ord`` column, so that the last row per model wins however the files are
    dealt to tasks: a CSV with line breaks in quotes is read by one task."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], EMISSION_SCHEMA)
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    require_columns(df, "project_name", "emissions")
    if "ord" in df.columns:
        order = F.struct(F.lit("").alias("file"), F.col("ord").cast("long").alias("row"))
    else:
        order = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    return df.select("project_name", F.col("emissions").cast("double").alias("emissions"), order.alias("ord"))


def model_key(project_name) -> F.Column:
    """Model name of a project: the suffix removed literally, then lower case."""
    return F.lower(F.replace(F.col(project_name) if isinstance(project_name, str) else project_name,
                             F.lit(PROJECT_SUFFIX), F.lit("")))


def emissions_lookup(log: DataFrame, order_cols=("ord",)) -> DataFrame:
    """(model, emissions): the last logged value per model in ``order_cols``
    order.  One grouped aggregate (partial max_by before the shuffle)."""
    require_columns(log, "project_name", "emissions", *order_cols)
    order = F.struct(*[F.col(c) for c in order_cols])
    return (log.withColumn("model", model_key("project_name"))
               .groupBy("model").agg(F.max_by("emissions", order).alias("emissions")))


def model_emissions(models: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join of model names to the lookup; an absent model gets 0.0."""
    return (models.select(F.lower(F.col("model")).alias("_key"), "model")
                  .join(lookup.withColumnRenamed("model", "_key"), "_key", "left")
                  .select("model", F.coalesce(F.col("emissions"), F.lit(0.0)).alias("emissions")))
