"""Operator 2: exact duplicates through a persistent digest index.

The index is a parquet table bucketed and sorted by digest: one row per
distinct normalised text (digest, largest doc_id, number of rows).  It lies in a
folder and is opened again from there, by a later batch or another program.  A
batch of new data is reduced to its distinct digests and merge-anti-joined with the
index, whose buckets need no shuffle (each is sorted again for the merge: after an
append it has several files); the digests that are new are appended.  Digests that
the index already holds are appended to a second bucketed table of repeats, so the
index itself is only ever appended to, never rewritten.  ``exact_dedup`` feeds the
documents to the index in ``BATCHES`` batches.

Cases: a null text counts as empty; empty texts are equal to one another;
rows repeated with the same doc_id count in group_size and are all kept when
that doc_id is the one that stays; a null doc_id stays only when its group has
no other; other columns of the input are not read (except by ``keep_one``, which also
leaves one of repeated rows).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import free_name, join_group_parts, join_groups, one_per, table, written

#: batches that a query feeds to the index
BATCHES = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest_of(text):
    """SHA-256 (binary) of the text with A-Z lower-cased.  ``lower`` does that
    for pure ASCII texts; others go through ``translate``."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))
    return F.unhex(F.sha2(low.cast("binary"), 256))


class DigestIndex:
    """``keys`` (first sight of a digest) and ``repeats`` (later batches) in a
    folder; opened again if it is there."""

    KINDS = ("keys", "repeats")
    SCHEMA = "digest binary, max_id long, n long"

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []
        have = [int(x.removeprefix("keys-")) for x in found if x.startswith("keys-")]
        # the number of buckets is part of the folder's name; an index that is there keeps its own
        self.buckets = have[0] if have else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "verdant_digests_" + hashlib.md5(self.folder.encode()).hexdigest()[:16]
        for kind in self.KINDS:
            self.fs.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(kind)))
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{kind} ({self.SCHEMA}) USING parquet "
                      f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._path(kind)}'")

    def _path(self, kind: str) -> str:
        return f"{self.folder}/{kind}-{self.buckets}"

    def _append(self, kind: str, df: DataFrame) -> None:
        df.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(f"{self.name}_{kind}")

    def rows(self, kind: str) -> DataFrame:
        self.spark.catalog.refreshTable(f"{self.name}_{kind}")
        return self.spark.table(f"{self.name}_{kind}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Append a batch of (doc_id, digest); returns its digests that were new."""
        per = batch.groupBy("digest").agg(F.max("doc_id").alias("max_id"), F.count(F.lit(1)).alias("n"))
        per = written(per.repartition(self.buckets, "digest"), "digest_batch")
        known = self.rows("keys").select("digest")
        fresh = written(per.join(known.hint("merge"), "digest", "left_anti"), "digest_new")
        old = per.join(known.hint("merge"), "digest", "left_semi")
        self._append("repeats", old.repartition(self.buckets, "digest"))
        self._append("keys", fresh.repartition(self.buckets, "digest"))
        return fresh

    def groups(self) -> DataFrame:
        """(digest, keep_id, group_size) over all batches; no shuffle, both
        tables lie bucketed by digest."""
        more = self.rows("repeats").groupBy("digest").agg(F.max("max_id").alias("id2"), F.sum("n").alias("n2"))
        return (self.rows("keys").join(more.hint("merge"), "digest", "left")
                .select("digest", F.greatest("max_id", "id2").alias("keep_id"),
                        (F.col("n") + F.coalesce("n2", F.lit(0))).alias("group_size")))

    def close(self) -> None:
        """Takes the tables out of the session's catalog; the files stay."""
        for kind in self.KINDS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")

    def delete(self) -> None:
        self.close()
        self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder), True)


def digest_groups(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(digest, keep_id, group_size) of rows(doc_id, digest), which go through a
    digest index in batches."""
    spark = rows.sparkSession
    folder = scratch_path(spark, "digest_index")
    number = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(batches))
    for b in range(batches):
        index = DigestIndex(spark, folder)  # each batch opens what the ones before it left
        index.add(rows.where(number == b))
        index.close()
    index = DigestIndex(spark, folder)
    groups = written(index.groups(), "digest_groups")
    index.delete()
    return groups


def exact_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    # the texts are read and hashed once; everything later moves 40-byte rows
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest")),
                   "doc_digests")
    groups = digest_groups(rows, batches)
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    # a group of one needs no look-up
    joined = join_groups(rows, groups.where("group_size > 1"), "digest", "group_size", total)
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row of each text, all columns as they are: that of the largest doc_id
    (a null one only if the text has no other), also of repeated rows.  The digest
    index says which doc_id stays; the texts then move once, to the index's answer
    for their digest, and of repeats with that doc_id one row is left.  Rows of
    heavy texts are sifted before they move."""
    key, keep, size = (free_name(docs, n) for n in ("_key", "_keep_id", "_group_size"))
    doc_id = F.col("doc_id").cast("long")
    rows = written(docs.select(doc_id.alias("doc_id"), digest_of(F.col("text")).alias("digest")), "doc_digests")
    groups = digest_groups(rows, batches).where("group_size > 1").toDF(key, keep, size)
    parts = join_group_parts(docs.withColumn(key, digest_of(F.col("text"))), groups, key, size, rows.count())
    light, hot = (one_per(p.where(F.col(size).isNull() | doc_id.eqNullSafe(F.col(keep))), key, docs.columns, doc_id).drop(key) for p in parts)
    return light.unionByName(hot)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = f"""WITH h AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)"""
