"""Session helpers.

The library never hard-codes cluster settings.  ``get_session`` is used by
tests, the bench and the command-line entry points; on a cluster the caller's
session (with its own shuffle sizing and ``spark.checkpoint.dir``) is used as is.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "verdant") -> SparkSession:
    """Local session for tests and benchmarks (UI off, AQE on)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VERDANT_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is unset
    and the master is local (tests) a scratch folder is created and registered;
    on a cluster such a folder would be the driver's alone.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="verdant-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a result is reused by several later jobs (features, splits);
    survives the loss of executors, unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if not eager:
        # a lazy checkpoint is written by a second job after the first action:
        # keep the computed partitions for it
        return df.persist(StorageLevel.MEMORY_AND_DISK).checkpoint(eager=False)
    # an eager checkpoint computes and writes in one job (measured), so no
    # intermediate in-memory copy is built
    return df.checkpoint(eager=True)


def bucketed_table(df: DataFrame, key: str = "doc_id", name: str = "table",
                   buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a parquet table bucketed by ``key`` into the shared
    checkpoint folder and read it back.

    Like a reliable checkpoint this cuts the lineage (executor loss costs a
    re-read, not a recomputation), and unlike a checkpoint the reader knows
    the layout: aggregates, windows and joins on ``key`` over tables bucketed
    the same way run without a shuffle.  The bucket count defaults to
    ``spark.sql.shuffle.partitions``; rows are hash-partitioned by ``key``
    first (a no-op when they already are), so every task writes one file.
    The table is registered in the session catalog under a unique name.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = "verdant_" + re.sub(r"[^a-z0-9_]", "_", name.lower()) + "_" + uuid.uuid4().hex[:16]
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_doc(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash-partition rows by document before per-document text work.

    Shuffling the raw text once is cheaper than shuffling the exploded term
    rows later: every per-document window or aggregate downstream (TF-IDF
    norm, per-document scores) then reuses this partitioning.  The count is
    the session's ``spark.sql.shuffle.partitions`` (sized by the cluster).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (needed by the
    Arrow-batched UDFs): zip it once and add it like ``--py-files``."""
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="verdant-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "verdant"), "zip", os.path.dirname(pkg_dir), "verdant")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(key)
