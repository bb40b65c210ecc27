"""Operator 12: hard-negative mining with a residue-number-system matrix product.

Components become integers, floor(256 x).  The scores of a block of anchors
against a block of rows are exact integers: for a few primes below 256 the
matrices hold the residues nearest zero, their product is one float32 matrix
product per prime (sums of at most ``CHUNK`` products of two numbers up to 125
stay below 2^24, where float32 counts exactly), and the signed score is put
together from its residues by Chinese remaindering (mixed radix).  As many primes
are used as the longest vectors make necessary.

Two such passes over the grid of (row block, anchor block) cells:

1. positives: per anchor the first ``POSITIVES`` other rows of its label;
2. negatives: per anchor and positive the first ``NEGATIVES`` rows of other labels
   with LOW * positive_score <= 100 * score <= HIGH * positive_score.

Each cell hands on only what its own rows can contribute to that selection, and a
window per anchor (and positive) takes the first of those.

Scale: rows are dealt to row blocks by a hash of the whole row, anchors to anchor
blocks by a hash of their id; a cell holds at most about ROW_BLOCK rows and
ANCHOR_BLOCK anchors, whatever the labels, ids or vectors (a label, an id or a
vector with a third of the rows is spread like any other).  Score matrices are
made for ``AT_ONCE`` anchors at a time.

Cases: rows with a null vec_id, label or vector, or a null or non-finite component
take no part, nor do vectors whose integer length reaches 2^31 (their scores might
not fit a long); vectors of unequal length are compared over their common
components; an empty vector scores 0; rows equal in vec_id, label and vector count
once, and rows of an anchor's own id are never its positives or negatives; an
anchor id with several rows asks with the least of them (by label, then vector);
fewer candidates than asked for give fewer rows; an empty table gives none; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import table, written

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
ROW_BLOCK = 32768
ANCHOR_BLOCK = 8192
#: least rows of a row block: blocks are no smaller to keep more cores busy
LEAST_BLOCK = 1024
#: anchors whose scores are held at once, and components of one float32 product
AT_ONCE = 32
CHUNK = 1024


def primes_below(top: int) -> list[int]:
    """Odd primes below top, largest first."""
    return [p for p in range(top - 1, 2, -1) if all(p % q for q in range(2, int(p ** 0.5) + 1))]


PRIMES = primes_below(SCALE)


def moduli(bound: int) -> list[int]:
    """The primes whose product tells apart all integers of size up to bound."""
    out, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    return out


def residues(v: np.ndarray, p: int) -> np.ndarray:
    """The integers of a float64 matrix modulo p, nearest zero, as float32."""
    r = np.fmod(v, p)  # exact
    r -= p * np.rint(r / p)
    return r.astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p (int64, 0..p-1) of residue matrices, exactly."""
    total = None
    for lo in range(0, max(a.shape[1], 1), CHUNK):
        part = a[:, lo:lo + CHUNK] @ b[:, lo:lo + CHUNK].T
        part -= np.float32(p) * np.rint(part * np.float32(1 / p))  # one off at most, still congruent
        total = part if total is None else residues(total.astype(np.float64) + part, p)
    return np.mod(total.astype(np.int64), p)


def remaindered(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers with these residues (Garner's mixed radix)."""
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        value, radix = np.zeros_like(parts[k]), 1
        for d, q in zip(digits, primes):
            value += d * (radix % p)
            radix = radix * q % p
        digits.append((parts[k] - value) * pow(radix, -1, p) % p)
    # from the last digit down; the upper half of the range stands for negative
    # numbers.  The product may pass 2^64: arithmetic modulo 2^64 is exact for
    # scores that fit a long.
    product = 1
    for p in primes:
        product *= p
    wrap = lambda x: np.array(x % 2 ** 64, dtype=np.uint64)
    out, radix, above = np.zeros(digits[0].shape, np.uint64), 1, np.zeros(digits[0].shape, bool)
    tied = np.ones(digits[0].shape, bool)
    half, halves = product // 2, []
    for p in primes:
        halves.append(half % p)
        half //= p
    for d, p in zip(digits, primes):
        out += d.astype(np.uint64) * wrap(radix)
        radix *= p
    for d, h in zip(reversed(digits), reversed(halves)):  # compared with half the range, highest digit first
        above |= tied & (d > h)
        tied &= d == h
    out[above] -= wrap(product)
    return out.view(np.int64)


def scores(anchors: list[np.ndarray], rows: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact integer inner products from the residue matrices of both sides."""
    return remaindered([residue_product(a, b, p) for a, b, p in zip(anchors, rows, primes)], primes)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (integers as array<double>), distinct."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * SCALE)
    finite = F.col("embedding").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) < 2.0 ** 62
    label = F.col("label").cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                          F.col("embedding"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite).where(small)
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x).cast("double")).alias("v")).distinct()


def blocks(rows: int, most: int, cores: int) -> int:
    """Blocks of at most ``most`` rows, and enough of them for the cores."""
    return max(-(-rows // most), min(cores, -(-rows // LEAST_BLOCK)), 1)


def matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as a float64 matrix, padded with zeros or cut to a width."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


Choose = Callable[[np.ndarray, int, dict], Iterator[tuple]]


def cells(rows: DataFrame, anchors: DataFrame, grid: tuple[int, int], primes: list[int], choose: Choose, schema: str) -> DataFrame:
    """``choose(scores against rows in vec_id order, anchor's place, both sides)``
    for every anchor of every cell of the grid."""
    ship_package(rows.sparkSession)
    across, down = grid
    left = (rows.withColumn("_r", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(across)))
            .withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))))
    right = (anchors.withColumn("_a", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int"))
             .withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long")))))
    names = [x.split()[0] for x in schema.split(",")]

    def run(these: pa.Table, those: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if these.num_rows and those.num_rows:
            these = these.take(pa.array(np.argsort(these.column("vec_id").to_numpy(), kind="stable")))
            width = max(those.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
            v = matrix(these.column("v"), width)
            left_parts = [residues(v, p) for p in primes]
            sides = {"rows": {c: these.column(c).to_numpy() for c in ("vec_id", "label")},
                     "anchors": {c: those.column(c).to_pylist() for c in those.column_names if c not in ("v", "_a", "_r")}}
            asked = matrix(those.column("v"), width)
            for lo in range(0, len(asked), AT_ONCE):
                own = asked[lo:lo + AT_ONCE]
                for i, line in enumerate(scores([residues(own, p) for p in primes], left_parts, primes)):
                    out.extend(choose(line, lo + i, sides))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * len(names))], names=names)

    return left.groupBy("_r", "_a").cogroup(right.groupBy("_r", "_a")).applyInArrow(run, schema)


def first_of(line: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """Of the places ``at`` (ascending) the first ``count`` by score, then place."""
    if len(at) > 8 * count:
        cut = np.partition(line[at], len(at) - count)[len(at) - count]
        at = at[line[at] >= cut]
    return at[np.argsort(-line[at], kind="stable")[:count]]


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "neg_rows")
    least = F.min(F.struct("label", "v")).alias("m")
    anchors = written(rows.where(is_anchor).groupBy("vec_id").agg(least).select("vec_id", "m.*"), "neg_anchors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, longest = rows.agg(F.count(F.lit(1)), F.max(length)).first()
    m, reach = anchors.agg(F.count(F.lit(1)), F.max(length)).first()
    # the scores are at most the product of the lengths; the margin covers the rounding of these figures
    primes = moduli(int((longest or 0.0) * (reach or 0.0) * 1.0001) + 1)
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = blocks(n, ROW_BLOCK, cores), max(-(-m // ANCHOR_BLOCK), 1)

    def positive(line: np.ndarray, i: int, sides: dict) -> Iterator[tuple]:
        one, ids = sides["anchors"], sides["rows"]["vec_id"]
        at = np.flatnonzero((sides["rows"]["label"] == one["label"][i]) & (ids != one["vec_id"][i]))
        for j in first_of(line, at, positives):
            yield one["vec_id"][i], int(ids[j]), int(line[j])

    found = cells(rows, anchors, grid, primes, positive, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = written(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= positives).drop("_n"), "neg_positives")
    # a positive id with several rows of one score is asked for once
    each = F.sort_array(F.collect_set(F.struct("positive_id", "positive_score"))).alias("p")
    asking = anchors.join(first.groupBy(F.col("anchor_id").alias("vec_id")).agg(each), "vec_id").select(
        "vec_id", "label", "v", F.col("p.positive_id").alias("ids"), F.col("p.positive_score").alias("at"))

    def negative(line: np.ndarray, i: int, sides: dict) -> Iterator[tuple]:
        one, ids = sides["anchors"], sides["rows"]["vec_id"]
        windows = [(-(-low * s // 100), high * s // 100) for s in one["at"][i]]
        if all(a > b for a, b in windows):
            return
        floor, top = min(a for a, b in windows if a <= b), max(b for a, b in windows if a <= b)
        at = np.flatnonzero((line >= floor) & (line <= top) & (sides["rows"]["label"] != one["label"][i]) & (ids != one["vec_id"][i]))
        for positive_id, score, (a, b) in zip(one["ids"][i], one["at"][i], windows):
            for j in first_of(line, at[(line[at] >= a) & (line[at] <= b)], negatives):
                yield one["vec_id"][i], positive_id, score, int(ids[j]), int(line[j])

    got = cells(rows, asking, grid, primes, negative,
                "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return (got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % ANCHOR_EVERY == 0)


OP12_SQL = f"""WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id))::INTEGER AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}"""
