"""Preparation operators: cleaning, label encoding, exact sampling and
deterministic stratified splits.

Splits and samples are defined by one order per stratum: rows sorted by
``md5(seed || ':' || id)`` then ``id``.  A quota per stratum cuts that order
into segments (for example test, validation, train).  The order never depends
on partitioning, so the same seed gives the same split on any cluster.

Scale: a plain ``row_number() over (partition by label ...)`` would sort a
whole class in one task (a class may hold most rows).  Instead the few rows at
the cuts are looked up: histograms of ever longer md5 prefixes narrow each cut
down to a bucket of at most ``FEW`` rows, only these are ranked, and the row at
each cut (one key and id per class and cut) is read.  These passes see ids and
labels alone.  In the output every row compares its own key with its class's
cuts, in the scan: no row moves, and no text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text as _clean_text_col
from ..session import cut_lineage

# Rows of a bucket that are ranked; rows of a histogram that the driver reads.
FEW = 1 << 16
HISTOGRAM_ROWS = 1 << 20
# Classes that are broadcast and ranked in one window at most.
MAX_CLASSES = 100_000
# Classes whose cuts are written into the expression; more are broadcast (one row per class).
LITERAL_STRATA = 64


def require_columns(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; available: {df.columns}")


# --------------------------------------------------------------------------- P1
def clean_text(df: DataFrame, text_col: str = "text", null_token: str | None = None) -> DataFrame:
    require_columns(df, text_col)
    return df.withColumn(text_col, _clean_text_col(F.col(text_col), null_token))


# ------------------------------------------------------------------------ P2/P3
def encode_labels(df: DataFrame, label_col: str = "label", out_col: str = "label_idx",
                  mode: str = "mixed") -> DataFrame:
    """Label encoding.

    ``mixed``: a string label column is replaced by the 0-based rank of the
    label among the sorted distinct labels; a numeric one is kept as it is.
    ``string``: every label is cast to string first, so numbers sort as text
    ("10" before "2").
    The distinct-label table (one row per class) is broadcast while there are at
    most ``MAX_CLASSES`` of them, so the rows aren't shuffled by label; with more the
    classes are ranked in ranges and joined with a shuffle.
    """
    require_columns(df, label_col)
    if mode not in ("mixed", "string"):
        raise ValueError(f"unknown label encoding mode {mode!r}")
    is_string = isinstance(df.schema[label_col].dataType, T.StringType)
    if mode == "mixed" and not is_string:
        return df.withColumn(out_col, F.col(label_col))
    raw = F.col(label_col).cast("string")
    distinct = cut_lineage(df.select(raw.alias("_label_raw")).where(raw.isNotNull()).distinct())
    few = distinct.count() <= MAX_CLASSES
    classes = ranked_classes(distinct, "_label_raw", few)
    return (df.withColumn("_label_raw", raw)
              .join(F.broadcast(classes) if few else classes, on="_label_raw", how="left")
              .withColumnRenamed("_class_idx", out_col)
              .drop("_label_raw"))


def label_classes(df: DataFrame, label_col: str) -> DataFrame:
    """Sorted distinct non-null labels with their 0-based index."""
    distinct = cut_lineage(df.select(F.col(label_col)).where(F.col(label_col).isNotNull()).distinct())
    return ranked_classes(distinct, label_col, distinct.count() <= MAX_CLASSES)


def ranked_classes(distinct: DataFrame, label_col: str, few: bool) -> DataFrame:
    """0-based index of distinct labels in order: by one window of at most
    ``MAX_CLASSES`` rows, else by the range-partitioned rank."""
    if few:
        return distinct.withColumn("_class_idx", (F.row_number().over(Window.orderBy(F.col(label_col))) - 1).cast("int"))
    from .features import rank_rows
    return rank_rows(distinct, [F.col(label_col).asc()], "_class_idx", 0).withColumn("_class_idx", F.col("_class_idx").cast("int"))


# --------------------------------------------------------------------------- P4
def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    require_columns(df, *types)
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ order keys
def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(id_col).cast("string")))


def cut_rows(keyed: DataFrame, id_col: str, strat: str, cuts: dict, sizes: dict) -> dict:
    """{stratum: [(key, id) of the row at each cut]} in hash order; None for a
    cut at or before the first row, the empty tuple for one past the last.

    keyed(id, stratum, _k).  Each round reads one histogram of the prefixes of the
    buckets that are still large, at most ``HISTOGRAM_ROWS`` rows; the last pass
    ranks buckets of at most ``FEW`` rows (of equal keys at least)."""
    spark, strat_type = keyed.sparkSession, keyed.schema[strat].dataType
    open_cuts = {(k, j): {"prefix": "", "below": 0, "rows": sizes[k], "p": p}
                 for k, ps in cuts.items() for j, p in enumerate(ps) if 0 < p < sizes[k]}
    length = 0
    while True:
        wide = {key: c for key, c in open_cuts.items() if c["rows"] > FEW and length < 32}
        if not wide:
            break
        buckets = sorted({(k, c["prefix"]) for (k, _), c in wide.items()}, key=str)
        digits = max(1, int(math.log(max(HISTOGRAM_ROWS // len(buckets), 1), 16)))
        rows = keyed
        if length:
            schema = T.StructType([T.StructField("_cs", strat_type), T.StructField("_p", T.StringType())])
            these = spark.createDataFrame(buckets, schema)
            rows = keyed.join(F.broadcast(these), keyed[strat].eqNullSafe(these["_cs"]) & (F.substring("_k", 1, length) == F.col("_p")), "left_semi")
        length += digits
        hist: dict = {}
        for r in rows.groupBy(strat, F.substring("_k", 1, length).alias("_b")).agg(F.count(F.lit(1)).alias("_n")).collect():
            hist.setdefault((r[0], (r["_b"] or "")[:length - digits]), []).append((r["_b"] or "", r["_n"]))
        for (k, _), c in wide.items():
            for b, n in sorted(hist[k, c["prefix"]]):
                if c["below"] + n > c["p"]:
                    c["prefix"], c["rows"] = b, n
                    break
                c["below"] += n
    found = {}
    if open_cuts:
        wanted: dict = {}
        for (k, _), c in open_cuts.items():
            wanted.setdefault((k, c["prefix"]), []).append(c["p"] - c["below"])
        schema = T.StructType([T.StructField("_cs", strat_type), T.StructField("_p", T.StringType()), T.StructField("_at", T.ArrayType(T.LongType()))])
        these = spark.createDataFrame([(k, p, at) for (k, p), at in wanted.items()], schema)
        near = keyed.join(F.broadcast(these), keyed[strat].eqNullSafe(these["_cs"]) & F.coalesce(F.col("_k").startswith(F.col("_p")), F.col("_p") == ""))
        rank = F.row_number().over(Window.partitionBy("_cs", "_p").orderBy("_k", id_col)) - 1
        for r in near.withColumn("_r", rank).where(F.array_contains("_at", F.col("_r").cast("long"))).select("_cs", "_p", "_r", "_k", id_col).collect():
            found[r["_cs"], r["_p"], r["_r"]] = (r["_k"], r[id_col])
    out: dict = {}
    for k, ps in cuts.items():
        own = []
        for j, p in enumerate(ps):
            c = open_cuts.get((k, j))
            own.append(found[k, c["prefix"], p - c["below"]] if c else None if p <= 0 else ())
        out[k] = own
    return out


def assign_segments(df: DataFrame, id_col: str, strata_col: str | None, seed: int,
                    cuts: dict, sizes: dict, names: Sequence[str], out_col: str = "split") -> DataFrame:
    """Cut each stratum's hash order into consecutive segments.

    ``cuts`` maps each stratum to its ascending cut positions (segment j holds
    order ranks in [p_j, p_(j+1))); ``sizes`` maps strata to row counts;
    ``names`` has one more entry than each cut list.  Both dicts have one
    entry per stratum (class), read from a small aggregate.  Rows that share an
    id share a segment; rows without an id come first.
    """
    strat = strata_col or "_stratum"
    base = df if strata_col else df.withColumn(strat, F.lit(0))
    keyed = base.withColumn("_k", order_key(id_col, seed))
    at = cut_rows(keyed.select(id_col, strat, "_k"), id_col, strat, cuts, sizes)
    always = {k: sum(c is None for c in own) for k, own in at.items()}
    rows = {k: [c for c in own if c] for k, own in at.items()}

    def reached(key: Column, row_id: Column) -> Column:
        return F.coalesce((F.col("_k") > key) | ((F.col("_k") == key) & (F.col(id_col) >= row_id)), F.lit(False))

    if len(at) <= LITERAL_STRATA:
        segment = F.lit(None).cast("int")
        for k in at:
            passed = sum([reached(F.lit(key), F.lit(i)).cast("int") for key, i in rows[k]], F.lit(always[k]))
            segment = F.when(F.col(strat).eqNullSafe(F.lit(k)), passed).otherwise(segment)
        keyed = keyed.withColumn("_seg", segment)
    else:
        schema = T.StructType([
            T.StructField("_cs", df.schema[strat].dataType), T.StructField("_always", T.IntegerType()),
            T.StructField("_cuts", T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("i", df.schema[id_col].dataType)])))])
        table = df.sparkSession.createDataFrame([(k, always[k], rows[k]) for k in at], schema)
        keyed = keyed.join(F.broadcast(table), keyed[strat].eqNullSafe(table["_cs"])).withColumn(
            "_seg", F.col("_always") + F.size(F.filter("_cuts", lambda c: reached(c["k"], c["i"])))).drop(*table.columns)
    out = keyed.withColumn(out_col, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_seg") + 1))
    return out.drop("_k", "_seg", *([] if strata_col else [strat]))


# ------------------------------------------------------------------ quotas
def holdout_allocation(sizes: dict, fraction: float) -> dict:
    """Stratified two-way allocation: {stratum: (keep, hold)}.

    Held-out size = ceil(fraction * n) (product rounded to 9 digits first);
    the kept part is allocated to strata by largest remainder of
    n_c * n_keep / n in exact integers, ties to the smaller label (NULL
    first); the held-out part of each stratum is the rest.
    """
    if not (0.0 < fraction < 1.0):
        raise ValueError("fraction must be in (0, 1)")
    n = sum(sizes.values())
    hold_total = math.ceil(round(fraction * n, 9))
    keep_total = n - hold_total
    base = {k: (c * keep_total) // n if n else 0 for k, c in sizes.items()}
    rem = {k: (c * keep_total) % n if n else 0 for k, c in sizes.items()}
    need = keep_total - sum(base.values())
    order = sorted(sizes, key=lambda k: (-rem[k], k is not None, k))
    keep = {k: base[k] + (1 if i < need else 0) for i, k in enumerate(order)}
    return {k: (keep[k], sizes[k] - keep[k]) for k in sizes}


def class_sizes(df: DataFrame, label_col: str) -> dict:
    """{label: rows}; one small aggregate (one row per class) read once."""
    return {r[0]: int(r[1]) for r in df.groupBy(label_col).count().collect()}


# --------------------------------------------------------------------- P7
def stratified_split(df: DataFrame, label_col: str = "label", fraction: float = 0.1,
                     seed: int = 42, id_col: str = "doc_id", out_col: str = "split",
                     names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Two-way stratified split: ``names[1]`` receives ceil(fraction*n) rows."""
    sizes = class_sizes(df, label_col)
    alloc = holdout_allocation(sizes, fraction)
    cuts = {k: [hold] for k, (_, hold) in alloc.items()}
    return assign_segments(df, id_col, label_col, seed, cuts, sizes, [names[1], names[0]], out_col)


def three_way_quotas(sizes: dict, first_fraction: float, second_fraction: float,
                     second_from_hold: bool) -> dict:
    """{stratum: (test, val)} for the nested splits."""
    q1 = holdout_allocation(sizes, first_fraction)
    if second_from_hold:
        # hold out first_fraction, then halve it: validation = kept half, test = held half
        q2 = holdout_allocation({k: h for k, (_, h) in q1.items()}, second_fraction)
        return {k: (q2[k][1], q2[k][0]) for k in sizes}
    # test first, then the validation share of the rest
    q2 = holdout_allocation({k: kp for k, (kp, _) in q1.items()}, second_fraction)
    return {k: (q1[k][1], q2[k][1]) for k in sizes}


def _three_way(df: DataFrame, label_col: str, seed: int, id_col: str, out_col: str,
               first_fraction: float, second_fraction: float, second_from_hold: bool) -> DataFrame:
    sizes = class_sizes(df, label_col)
    q = three_way_quotas(sizes, first_fraction, second_fraction, second_from_hold)
    cuts = {k: [t, t + v] for k, (t, v) in q.items()}
    return assign_segments(df, id_col, label_col, seed, cuts, sizes, ["test", "val", "train"], out_col)


# --------------------------------------------------------------------- P8
def split_80_10_10(df: DataFrame, label_col: str = "label", seed: int = 42, id_col: str = "doc_id",
                   test_size: float = 0.1, val_size: float = 0.1, out_col: str = "split") -> DataFrame:
    return _three_way(df, label_col, seed, id_col, out_col, test_size, val_size / (1.0 - test_size), False)


# --------------------------------------------------------------------- P9
def split_lstm(df: DataFrame, label_col: str = "label", seed: int = 42, id_col: str = "doc_id",
               out_col: str = "split") -> DataFrame:
    return _three_way(df, label_col, seed, id_col, out_col, 0.1, 0.1111, False)


# --------------------------------------------------------------------- P10
def split_90_5_5(df: DataFrame, label_col: str = "label", seed: int = 42, id_col: str = "doc_id",
                 out_col: str = "split") -> DataFrame:
    return _three_way(df, label_col, seed, id_col, out_col, 0.1, 0.5, True)


# --------------------------------------------------------------------- P11
def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).cast("long").alias("n"))


# --------------------------------------------------------------------- P6
def sample_exact(df: DataFrame, fraction: float, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Exactly round_half_even(fraction * n) rows, chosen by hash order; the
    whole input when fraction is 1."""
    if not (0.0 < fraction <= 1.0):
        raise ValueError("fraction must be in (0, 1]")
    if fraction == 1.0:
        return df
    n = df.count()
    take = round(fraction * n)  # half to even
    marked = assign_segments(df, id_col, None, seed, {0: [take]}, {0: n}, ["in", "out"], "_sampled")
    return marked.where(F.col("_sampled") == "in").drop("_sampled")
