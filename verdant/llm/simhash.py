"""Operator 13: SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's words (A-Z lower-cased, cut at white space) make 3-word shingles,
repeats included; bit b of the fingerprint is 1 if it is set in over half of the
shingles' XXH64 values (seed 42).  Fingerprints link at RADIUS = 2 or fewer
differing bits.

Two fingerprints within 2 bits have a common neighbour within 1 bit of each, so
every distinct fingerprint emits its 65 variants within half the radius, one
shuffle brings equal variants together, and what meets there is a colliding
pair.  A variant has 65 neighbours in all, so no group holds more than 65
fingerprints, however many near copies there are; its members are all within 2
bits of one another and are tied to the least of them, which makes the same
components as all their pairs.  The pairs are deduplicated and verified by their
differing bits before they count.

Everything after the fingerprints works on distinct ones: a text that fills a
third of the table emits 65 rows.  Documents find their component through
``join_groups``, which looks heavy fingerprints up in a broadcast of proven size.

Cases: null, empty and blank texts have fingerprint zero and link like any
other; fewer than three words make one shingle; very long texts are hashed a
stretch of shingles at a time; repeated rows each give a row; a null doc_id takes
part by its text and shows the smallest doc_id of its component (null if it has
none); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, join_groups, table, written
from .components import components

WORDS = 3
SEED = 42
#: the ball hashing below is for this radius: variants within RADIUS // 2 bits
RADIUS = 2
#: shingles hashed at once, texts held as Python bytes at once
STRETCH = 1 << 14
ROWS = 256


def shingle_hashes(words: list[bytes], k: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 of the k-word shingles, STRETCH at a time; with fewer words the
    whole sequence is the one shingle, without words there is none."""
    if not words:
        return
    k = min(k, len(words))
    last = len(words) - k + 1
    for lo in range(0, last, STRETCH):
        some = words[lo:min(lo + STRETCH, last) + k - 1]
        line = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some])
        starts = np.concatenate([[0], ends[:-1]])[:len(some) - k + 1].tolist()
        stops = (ends[k - 1:] - 1).tolist()
        yield np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def fingerprint(text: bytes, k: int = WORDS) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    total, ones = 0, np.zeros(64, dtype=np.int64)
    for h in shingle_hashes(text.lower().split(), k):  # bytes: A-Z and ASCII white space only
        total += len(h)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, fp) per row; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                fps = np.array([fingerprint(t or b"", k) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])
            pa.default_memory_pool().release_unused()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")),
                     run, "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """(fp, variant) for each variant of fp within RADIUS // 2 = 1 bit, fp itself among them."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return distinct.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("variant"))


def ball_links(distinct: DataFrame) -> DataFrame:
    """Verified pairs (u, v) of fingerprints that meet at a variant, each member
    with the least of its group.  One shuffle; a group has 65 rows at most."""
    met = variants(distinct).withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).where("fp != least")
    pairs = met.select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def near_duplicates(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, n_same (rows of this fingerprint) per row."""
    rows = written(fingerprints(docs, k), "sim_rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("m")), "sim_classes")
    links = written(ball_links(classes.select("fp")), "sim_links")
    roots = written(components(links), "sim_roots")
    tied = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tied = written(tied, "sim_tied")
    least = tied.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("parts"))
    # a fingerprint of one row without links is its own component
    groups = written(tied.join(least, "root").where("m > 1 or parts > 1").select("fp", "component_id", "m"), "sim_groups")
    out = join_groups(rows, groups, "fp", "m", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.coalesce("component_id", F.when(F.col("m").isNull(), F.col("doc_id"))).alias("component_id"),
                      F.coalesce("m", F.lit(1)).cast("long").alias("n_same"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
