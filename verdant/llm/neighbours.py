"""Operator 5: nearest neighbours by a permutation index.

A vector is represented by the order of its ``KEPT`` nearest pivots and posted,
with its rank there, in the inverted file of each of them.  A query reads the
files of its own nearest pivots; with both prefixes of length L the footrule
distance (a missing pivot has rank L) is

    L (L + 1) - 2 * sum over shared pivots of (L - max(rank in query, rank in vector))

so it is added up file by file.  The best ``RERANK`` share by footrule distance
is reranked by the exact inner product.

Scale: the index is one table of all distinct vectors (the smallest ids of each
class are kept, as many as a result can show, so a vector that fills a third of
the table costs one posting); the files are built per block of rows, as a search
engine splits its postings by document, so no file grows with the table.  Query
blocks of at most ``QUERY_BLOCK`` vectors (a proven size) go to every index
block; each block hands on only its best k per query.  Pivots are a seeded
sample of ``PIVOTS`` distinct vectors; every row is indexed.

For vectors of unequal length the inner product is turned into a cosine by the
usual extra component sqrt(longest^2 - |v|^2) (0 for queries) before the pivots
are ranked; scores are always those of the original vectors.

Cases: vectors that are null, zero, of another dimension than most, or hold null
or non-finite components take no part, nor do null ids; ties go to the smaller
vec_id; fewer candidates than k give fewer rows; repeated rows count once; a
vec_id with several vectors asks with the smallest of them; an empty table gives
no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, table, written

K = 20
QUERY_EVERY = 20
PIVOTS = 256
KEPT = 64
RERANK = 0.15
MIN_RERANK = 400
QUERY_BLOCK = 4096
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.exists(v, lambda x: x != 0)
          & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("v") == (width.w if width else 0))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """One row per distinct vector: v, ids (its ``most`` smallest, ascending).
    The group limit works before the shuffle too, so a vector with many copies
    sends a few rows per task."""
    first = rows.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    return first.where(F.col("_n") <= most).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest ** 2 - (v * v).sum(axis=1), 0.0))
    return np.column_stack([v, rest])


def permutations(v: np.ndarray, pivots: np.ndarray, kept: int) -> np.ndarray:
    """The kept nearest pivots of each row, nearest first; ties by number."""
    return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :kept].astype(np.int16)


def matrix(col: pa.Array, dtype) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=dtype).reshape(len(col), -1)


def build_index(rows: DataFrame, most: int, pivots: int = PIVOTS, kept: int = KEPT) -> tuple[DataFrame, np.ndarray, float]:
    """The written index (ids, v, perm), the pivots and the longest norm."""
    each = written(classes(rows, most), "ann_classes")
    longest = each.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    sample = each.orderBy(F.xxhash64("ids"), "v").limit(pivots).select("v").collect()
    if not sample:
        return each.withColumn("perm", F.array().cast("array<smallint>")), np.empty((0, 0)), 0.0
    top = float(longest) ** 0.5
    points = lifted(np.array([r.v for r in sample]), top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                perm = permutations(lifted(matrix(b.column(1), np.float64), top), points, kept)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(perm), pa.list_(pa.int16()))], names=["ids", "v", "perm"])

    out = arrow_map(each.select("ids", "v"), run, "ids array<long>, v array<double>, perm array<smallint>")
    return written(out, "ann_index"), points, top


def search_block(index: DataFrame, ids: np.ndarray, queries: np.ndarray, points: np.ndarray, k: int, kept: int,
                 rerank: float, least: int) -> DataFrame:
    """The best k of every index block for each query of one query block."""
    perms = permutations(np.column_stack([queries, np.zeros(len(queries))]), points, kept)

    def block(own_ids: list, v: np.ndarray, perm: np.ndarray) -> Iterator[tuple]:
        n, width = perm.shape
        order = np.argsort(perm.ravel(), kind="stable")
        rows, ranks = order // width, (width - order % width).astype(np.int32)
        bounds = np.searchsorted(perm.ravel()[order], np.arange(len(points) + 1))
        take = min(n, max(least, int(np.ceil(rerank * n))))
        for qid, q, qperm in zip(ids.tolist(), queries, perms.tolist()):
            near = np.zeros(n, dtype=np.int32)
            for rank, p in enumerate(qperm):
                a, b = bounds[p], bounds[p + 1]
                near[rows[a:b]] += np.minimum(ranks[a:b], width - rank)
            chosen = np.argpartition(-near, take - 1)[:take] if take < n else np.arange(n)
            scores = v[chosen] @ q
            few = min(len(chosen), k + 1)  # one class may hold nothing but the query itself
            cut = np.partition(scores, len(scores) - few)[len(scores) - few] - 1e-9
            chosen = chosen[scores >= cut]
            exact = (v[chosen] * q).sum(axis=1)  # the same order of additions for equal vectors
            found = [(-s, i) for s, c in zip(exact.tolist(), chosen.tolist()) for i in own_ids[c] if i != qid]
            found.sort()
            for s, i in found[:k]:
                yield qid, i, -s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = list(block(b.column(0).to_pylist(), matrix(b.column(1), np.float64), matrix(b.column(2), np.int16)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.float64()])],
                                                 names=["query_id", "vec_id", "score"])

    return arrow_map(index.select("ids", "v", "perm"), run, RESULT)


def nearest(vectors: DataFrame, is_query, k: int = K, pivots: int = PIVOTS, kept: int = KEPT, rerank: float = RERANK,
            least: int = MIN_RERANK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row for which the
    condition ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "ann_rows")
    index, points, _ = build_index(rows, k + 1, pivots, kept)
    asked = written(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "ann_queries")
    blocks = -(-asked.count() // (QUERY_BLOCK // 2))
    parts = []
    for at in range(blocks if len(points) else 0):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == at).orderBy("vec_id").collect()
        for lo in range(0, len(own), QUERY_BLOCK):
            some = own[lo:lo + QUERY_BLOCK]
            parts.append(written(search_block(index, np.array([r.vec_id for r in some]), np.array([r.v for r in some]), points,
                                              k, min(kept, len(points)), rerank, least), "ann_found"))
    found = parts[0] if parts else spark.createDataFrame([], RESULT)
    for p in parts[1:]:
        found = found.unionByName(p)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
