"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: A group of equal keys is "heavy" when it holds more than 1/HEAVY_SHARE of
#: all rows; there are fewer than HEAVY_SHARE such groups at any input size.
HEAVY_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder (``spark.checkpoint.dir``) and read back:
    cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made; nothing that is still to be computed may read them."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with the package made importable in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of a few rows, so that a worker holds few texts as
    Python strings; what Arrow frees goes back to the system after each batch."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
        pa.default_memory_pool().release_unused()


def crc_bucket(col: str = "doc_id"):
    """crc32(doc_id as text) mod 5: 0 marks held-out rows (null ids: crc32 of
    the empty text, 0)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % 5


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of many ``rows`` with one row per ``key`` in ``groups``.

    A key may hold a third of all rows, so heavy keys (more than
    total / HEAVY_SHARE rows: fewer than HEAVY_SHARE of them) are looked up in
    a broadcast table of that proven size and the rest is merge-joined.
    """
    light, hot = join_group_parts(rows, groups, key, size, total)
    return light.unionByName(hot)


def join_group_parts(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``join_groups``: the merge-joined rows (they lie partitioned
    by ``key``) and those of the heavy keys."""
    limit = max(total // HEAVY_SHARE, 16)
    heavy = F.broadcast(groups.where(F.col(size) > limit).withColumn("_heavy", F.lit(True)))
    tagged = rows.join(heavy.select(key, "_heavy"), key, "left")
    hot = rows.join(heavy.drop("_heavy"), key, "inner")
    light = tagged.where(F.col("_heavy").isNull()).drop("_heavy")
    rest = groups.where(F.col(size) <= limit)
    return light.join(rest.hint("merge"), key, "left"), hot


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_per(keyed: DataFrame, key: str, columns: list[str], rank) -> DataFrame:
    """Of the rows of each ``key`` the one with the largest rank (null: the
    least), then by a hash of its columns; the key and the columns.  An aggregate
    with a map-side part, so no key's rows meet in one task."""
    order = F.struct(rank.alias("rank"), F.xxhash64(*columns).alias("row"))
    best = free_name(keyed, "_best")
    return keyed.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias(best)).select(key, f"{best}.*")
