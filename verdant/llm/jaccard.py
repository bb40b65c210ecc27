"""Operator 9: size-aware heavy-light Jaccard join of shingle sets.

Documents link when 100 * |A & B| >= percent * |A | B|; the result is each document's
component.  Shingle length and percent are parameters; the query's are 3 and 90.  Equal sets are one class first (named by a digest), everything after
that works on classes.

* Small sets (up to a boundary size) are joined by subsets: sets of sizes a <= b
  link exactly if they share a subset of the size that the threshold asks for, so
  each enumerates its subsets of those fixed sizes and equal subsets meet.
* Large sets are joined by inverted lists over prefixes: of n shingles in one
  global order the first n - ceil(n * percent / 100) + 1 are posted, and a pair is a
  candidate only if it shares as many posted shingles as its sizes force it to.
* The boundary is the size at which enumerating costs more than scanning, from
  the sizes and list lengths of the data.

Skew.  The global order puts frequent shingles last (a fixed-size bit table of
them, 4 MB at any scale, from counts of the shingles that an Arrow batch holds
twice or more; it may only cost time, never results).  Groups of near copies are first tied to leaders: classes with
one min-hash are checked against the group's leader, and what links is one
component; inverted lists then only pair classes of different components, and
members of big components only meet classes outside them.  Every candidate is
checked on the full sets, so a link is never lost or invented.  In long lists a
pair must pass a sketch first, the parity of a set's shingles in each of 512 cells:
sets differ in at least as many shingles as their sketches in cells, so a pair whose
sketches differ too much is no link.  That keeps a family of many near copies, which share nearly all keys but
mostly don't link, from making candidates of all its pairs.

Cases: texts without words (or null) have the empty set, link with nothing and
are their own component; repeated rows are equal sets; a null doc_id takes part
by its text and shows the smallest doc_id of its component; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .bpe import forget
from .common import arrow_map, discard, free_name, join_groups, one_per, slices, table, written
from .components import components
from .shingles import ROWS, SHINGLE, digest, mixed, sets_of

#: the query's threshold; callers with another one (and shingle length) pass theirs
PERCENT = 90
#: a shingle counted in more documents than this is late in the order
FREQUENT = 16
BITS = 1 << 25
MIN_HASHES = 4
#: largest boundary considered
MOST_SMALL = 27
#: a component of more classes than this is big
BIG = 32
#: longs of a set's sketch: the parity of its shingles' number in each of 64 * SKETCH cells
SKETCH = 8
#: in lists of more classes than this, a pair is taken once, at the least key of those that it shares
LONG = 64


def need(a: int, b: int, percent: int = PERCENT) -> int:
    """Least intersection of sets of sizes a, b that link."""
    return -(-percent * (a + b) // (100 + percent))


def fits(a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * min(a, b) >= percent * max(a, b)


def subset_sizes(n: int, most: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a set of n has to show to partners up to ``most``."""
    return sorted({need(n, b, percent) for b in range(1, most + 1)
                   if fits(n, b, percent) and (b != n or need(n, n, percent) < n)} - {0})


def prefix(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def need_col(a, b, percent: int = PERCENT):
    return F.ceil((F.lit(percent) * (F.col(a) + F.col(b))) / F.lit(100 + percent)).cast("int")


def bit_table(rows: DataFrame, value) -> np.ndarray:
    """A table of BITS bits with the hashed values set; 4 MB at any input."""
    at = F.pmod(value, F.lit(BITS)) + 1
    got = (rows.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k"))
           .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b")).collect())
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in got:
        lo = (r.k - 1) * 4096
        out[lo:lo + len(r.b)] = np.frombuffer(bytes(r.b), dtype=np.uint8)
    return out


def has_bit(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.mod(values, BITS)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def sketch(s: np.ndarray) -> list[int]:
    """Two sets differ in at least as many shingles as their sketches in bits."""
    cells = np.bincount((mixed(s.view(np.uint64)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64).tolist()


def repeats(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values that the parts hold twice or more, ascending, and how often.  The
    parts go into one array that is sorted where it lies; the list is emptied."""
    every, at = np.empty(sum(map(len, parts)), np.int64), 0
    while parts:
        part = parts.pop()
        every[at:at + len(part)] = part
        at += len(part)
    every.sort()
    edge = np.diff((every[1:] == every[:-1]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return every[first], (last - first + 1).astype(np.int32)


def describe(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n, digest, lows (min-hashes), sketch.  Per batch one more
    row (digest null, n -1) with the shingles of several of its documents and
    their counts."""
    salts = mixed(np.arange(1, MIN_HASHES + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["doc_id", "n", "digest", "lows", "sketch", "shingles", "counts"]
        forget()
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for b in batches:
            every: list[np.ndarray] = []
            for lo in range(0, b.num_rows, ROWS):
                rows, part = [], []
                for doc_id, s in zip(b.column(0).slice(lo, ROWS).to_pylist(), sets_of(b.column(1).slice(lo, ROWS), k)):
                    lows, bits = None, None
                    if len(s):
                        bits = sketch(s)
                        with np.errstate(over="ignore"):
                            lows = [int(mixed(s.view(np.uint64) + x).min().view(np.int64)) for x in salts]
                        part.append(s)
                    rows.append((doc_id, len(s), digest(s), lows, bits, None, None))
                if part:
                    every.append(np.concatenate(part))
                yield made(rows)
            if every:
                shingles, counts = repeats(every)
                yield made([(None, -1, None, None, None, shingles, counts)])

    return arrow_map(docs, run, "doc_id long, n int, digest binary, lows array<long>, sketch array<long>, shingles array<long>, counts array<int>")


def set_rows(docs: DataFrame, wanted: DataFrame, name: str, k: int = SHINGLE) -> DataFrame:
    """(digest, s) of the wanted(doc_id, digest).  The text is read once more and
    not shuffled: bit tables pass the wanted ids (null is one of them) and of
    their sets the wanted digests, a join by digest does the rest."""
    bits = bit_table(wanted, F.xxhash64("doc_id"))
    digests = bit_table(wanted, F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wanted_rows = np.flatnonzero(has_bit(bits, b.column(1).to_numpy()))
            seen: set[bytes] = set()  # copies within the batch: many texts may share the null id
            for lo in range(0, len(wanted_rows), ROWS):
                names, sets = [], []
                for x in sets_of(b.column(0).take(pa.array(wanted_rows[lo:lo + ROWS])), k):
                    name = digest(x)
                    if name is not None and name not in seen and has_bit(digests, np.array([int.from_bytes(name[:4], "big")]))[0]:
                        seen.add(name)
                        names.append(name)
                        sets.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "s"])

    found = arrow_map(docs.select("text", F.xxhash64("doc_id").alias("_h")), run, "digest binary, s array<long>")
    return written(found.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]), name)


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose full sets link."""
    a = sets.select(F.col("digest").alias("u"), F.col("s").alias("su"))
    b = sets.select(F.col("digest").alias("v"), F.col("s").alias("sv"))
    both = pairs.select("u", "v").join(a, "u").join(b, "v")
    n = F.size(F.array_intersect("su", "sv"))
    return both.where(100 * n >= percent * (F.size("su") + F.size("sv") - n)).select("u", "v")


def leader_links(classes: DataFrame, described: DataFrame, docs: DataFrame, k: int = SHINGLE,
                 percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links, and the components they make, between classes with one min-hash and the leaders of these groups,
    for three choices of leader; a later choice skips what is one component."""
    lows = (described.where("digest is not null").select("digest", "n", F.posexplode("lows").alias("i", "low"))
            .groupBy("i", "low", "digest").agg(F.min("n").alias("n")))
    lows = written(lows, "jac_lows")
    groups = written(lows.groupBy("i", "low").agg(
        F.min("digest").alias("a"), F.max("digest").alias("b"), F.min_by("digest", F.xxhash64("digest")).alias("c"),
        F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("key", F.xxhash64("i", "low")), "jac_groups")
    members = written(lows.withColumn("key", F.xxhash64("i", "low")).join(groups.drop("m"), ["i", "low", "key"])
                      .select("digest", "n", "a", "b", "c"), "jac_members")
    wanted = classes.join(members.select("digest").distinct(), "digest", "left_semi").select("doc_id", "digest")
    sets = set_rows(docs, wanted, "jac_group_sets", k)
    sizes = written(members.select(F.col("digest").alias("v"), F.col("n").alias("nv")).distinct(), "jac_sizes")
    links, roots = None, None
    for leader in "abc":
        pairs = (members.where(F.col("digest") != F.col(leader)).select(F.col("digest").alias("u"), F.col(leader).alias("v"), "n")
                 .distinct().join(sizes, "v").where(100 * F.least("n", "nv") >= percent * F.greatest("n", "nv")))
        if roots is not None:
            pairs = apart(pairs, roots)
        new = written(linked(written(pairs.select("u", "v"), "jac_leader_pairs"), sets, percent), "jac_leader_links")
        links = new if links is None else written(links.unionByName(new), "jac_links")
        roots = written(components(links), "jac_roots")
    discard(lows, groups, members, sets, sizes)
    return links, roots


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v) that aren't in one component yet."""
    a = roots.select(F.col("node").alias("u"), F.col("root").alias("_ru"))
    b = roots.select(F.col("node").alias("v"), F.col("root").alias("_rv"))
    return (pairs.join(a, "u", "left").join(b, "v", "left")
            .where(F.coalesce("_ru", "u") != F.coalesce("_rv", "v")).drop("_ru", "_rv"))


def boundary(sizes: dict[int, int], list_length: float, percent: int = PERCENT) -> int:
    """The size up to which enumerating subsets costs less than scanning lists:
    a set costs its number of subsets, or its posted shingles times one more
    than the mean length of their lists."""
    enum = lambda n, x: sum(comb(n, c) for c in subset_sizes(n, x, percent)) if n <= x else 0
    scan = lambda n, x: prefix(n, percent) * (1 + list_length) if 100 * n >= percent * (x + 1) else 0
    total = lambda x: sum(m * (enum(n, x) + scan(n, x)) for n, m in sizes.items() if n <= 2 * MOST_SMALL)
    return min(range(MOST_SMALL + 1), key=lambda x: (total(x), x))


def postings(docs: DataFrame, bits: np.ndarray, small: int, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """digest, n, key, c.  c = 0: a posted shingle of a set that may meet a large
    one; c > 0: a subset of that size of a small set."""

    def posted_by(s: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        n = len(s)
        if n and 100 * n >= percent * (small + 1):
            late = has_bit(bits, s)
            yield np.concatenate([s[~late], s[late]])[:prefix(n, percent)], 0
        if n and n <= small:
            with np.errstate(over="ignore"):
                each = mixed(s.view(np.uint64))
                total = each.sum(dtype=np.uint64)
                for c in subset_sizes(n, small, percent):
                    left = np.array([each[list(out)].sum(dtype=np.uint64) for out in combinations(range(n), n - c)], np.uint64)
                    yield mixed(total - left).view(np.int64), c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                names, ns, keys, cs = [], [], [], []
                for s in sets_of(b.column(0).slice(lo, ROWS), k):
                    for key, c in posted_by(s):
                        names += [digest(s)] * len(key)
                        ns.append(np.full(len(key), len(s), np.int32))
                        keys.append(key)
                        cs.append(np.full(len(key), c, np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array(np.concatenate(x)) for x in (ns, keys, cs))],
                                                     names=["digest", "n", "key", "c"])

    rows = arrow_map(docs.select("text"), run, "digest binary, n int, key long, c int")
    # copies of one text meet here, before and after the shuffle
    return rows.groupBy("key", "c", "digest").agg(F.min("n").alias("n"))


def list_pairs(posted: DataFrame, roots: DataFrame, sketches: DataFrame, small: int, percent: int = PERCENT) -> DataFrame:
    """Candidate pairs (u, v) of different components that share enough posted
    shingles, or a subset of the right size; written.  ``posted``, a written
    table, is discarded with what was made of it."""
    sizes = written(roots.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "jac_root_sizes")
    big = written(roots.join(sizes, "root").select(
        F.col("node").alias("digest"), "root", (F.col("m") > BIG).alias("big")), "jac_node_roots")
    # a list of one class has no pair
    shared = written(posted.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
                     .select("key", "c", (F.col("m") > LONG).alias("long")), "jac_shared")
    shared_rows = written(posted.join(shared, ["key", "c"]), "jac_shared_rows")
    discard(posted, shared)
    rows = written(shared_rows.join(big, "digest", "left").select(
        "key", "c", "digest", "n", "long", F.coalesce("root", "digest").alias("root"), F.coalesce("big", F.lit(False)).alias("big")), "jac_rooted")
    discard(shared_rows, sizes, big)
    lists = rows.groupBy("key", "c").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"),
        F.min(F.when(F.col("big"), F.col("root"))).alias("b0"), F.max(F.when(F.col("big"), F.col("root"))).alias("b1"))
    lists = written(lists.where("r0 != r1").select("key", "c", F.coalesce(F.col("b0") != F.col("b1"), F.lit(False)).alias("two")), "jac_lists")
    live = written(rows.join(lists, ["key", "c"]), "jac_live")
    # classes in long lists carry the keys that they share with anyone, and those of their long lists
    longs = live.where("long and c = 0").groupBy("digest").agg(F.collect_list("key").alias("longs"))
    who = written(live.where("long and c = 0").select("digest").distinct(), "jac_long_classes")
    own = rows.where("c = 0").join(who, "digest", "left_semi").groupBy("digest").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    cells = [F.col("sketch")[i].alias(f"b{i}") for i in range(SKETCH)]
    bits = sketches.join(who, "digest", "left_semi").dropDuplicates(["digest"]).select("digest", *cells)
    keys = written(own.join(longs, "digest").join(bits, "digest"), "jac_own_keys")
    full = live.where("long and c = 0").join(keys, "digest")
    short = live.where("not long or c > 0")
    for name, kind in (("keys", "array<bigint>"), ("longs", "array<bigint>"), *((f"b{i}", "bigint") for i in range(SKETCH))):
        short = short.withColumn(name, F.lit(None).cast(kind))

    pre = lambda n: F.col(n) - F.ceil(F.col(n) * percent / 100.0).cast("int") + 1
    o = need_col("nu", "nv", percent)
    forced = F.greatest(F.lit(1), F.least(pre("nu") - F.col("nu") + o, pre("nv") - F.col("nv") + o))

    def meet(side: DataFrame, extra) -> DataFrame:
        """Pairs of one list; rows of big components only meet other components' rows."""
        a, b = (side.select("key", "c", F.col("digest").alias(x), F.col("n").alias("n" + x), F.col("root").alias("r" + x),
                            F.col("big").alias("g" + x), F.col("keys").alias("k" + x), F.col("longs").alias("l" + x), F.col("two").alias("two" + x),
                            *[F.col(f"b{i}").alias(f"b{i}{x}") for i in range(SKETCH)]) for x in "uv")
        cond = (F.col("ru") != F.col("rv")) & (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & extra
        light = a.where("not gu").join(b, ["key", "c"]).where(cond & (F.col("gv") | (F.col("u") < F.col("v"))))
        heavy = a.where("gu and twou").join(b.where("gv"), ["key", "c"]).where(cond & (F.col("u") < F.col("v")))
        return light.unionByName(heavy)

    counted = meet(short, F.when(F.col("c") > 0, F.col("c") == o).otherwise(F.greatest("nu", "nv") > small)).select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "c",
        F.when(F.col("u") < F.col("v"), F.col("nu")).otherwise(F.col("nv")).alias("nu"),
        F.when(F.col("u") < F.col("v"), F.col("nv")).otherwise(F.col("nu")).alias("nv"))
    counted = (counted.groupBy("u", "v", "c", "nu", "nv").agg(F.count(F.lit(1)).alias("k"))
               .where((F.col("c") > 0) | (F.col("k") >= forced)).select("u", "v"))
    # a pair that shares long lists is judged by all keys in the one of the least key, and a pair that shares none by its count above
    both = F.array_intersect("ku", "kv")
    apart_by = sum((F.bit_count(F.col(f"b{i}u").bitwiseXOR(F.col(f"b{i}v"))) for i in range(1, SKETCH)),
                   F.bit_count(F.col("b0u").bitwiseXOR(F.col("b0v"))))
    once = meet(full, (F.greatest("nu", "nv") > small) & (F.col("nu") + F.col("nv") - apart_by >= 2 * o) & (F.col("key") == F.array_min(F.array_intersect("lu", "lv"))) & (F.size(both) >= forced))
    pairs = written(counted.unionByName(once.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct(), "jac_pairs")
    discard(rows, lists, live, who, keys)
    return pairs


def class_roots(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, digest per document, and doc_id (the smallest), m, n, digest, root per class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = written(describe(docs, k), "jac_described")
    rows = described.where("n >= 0").select("doc_id", "n", "digest")
    counts = (described.where("n = -1").select(F.explode(F.arrays_zip("shingles", "counts")).alias("x"))
              .groupBy(F.col("x.shingles").alias("shingle")).agg(F.sum("x.counts").alias("m")))
    bits = bit_table(counts.where(F.col("m") > FREQUENT), F.col("shingle"))
    classes = written(rows.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("m"), F.min("n").alias("n")), "jac_classes")

    links, roots = leader_links(classes, described, docs, k, percent)
    hist = {r.n: r["count"] for r in classes.where(F.col("n") <= 2 * MOST_SMALL).groupBy("n").count().collect()}
    shared = counts.agg(F.sum("m"), F.count(F.lit(1))).first()
    small = boundary(hist, shared[0] / shared[1] if shared[1] else 1.0, percent)
    posted = written(postings(docs, bits, small, k, percent), "jac_postings")
    pairs = list_pairs(posted, roots, described.where("digest is not null").select("digest", "sketch"), small, percent)
    ends = pairs.select(F.col("u").alias("digest")).union(pairs.select("v")).distinct()
    sets = set_rows(docs, classes.join(ends, "digest", "left_semi").select("doc_id", "digest"), "jac_pair_sets", k)
    links = written(links.unionByName(linked(pairs, sets, percent)), "jac_all_links")
    discard(sets, pairs)
    roots = written(components(links), "jac_all_roots")

    tied = classes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    return rows, written(tied, "jac_tied")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id per document, and its class's digest."""
    rows, tied = class_roots(docs, k, percent)
    # every class that has copies or links: its component's smallest doc_id
    least = written(tied.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("parts")), "jac_least")
    groups = written(tied.join(least, "root").where("m > 1 or parts > 1").select("digest", "component_id", "m"), "jac_groups_out")
    total = rows.count()
    out = join_groups(rows, groups, "digest", "m", total)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.coalesce("component_id", "doc_id").alias("component_id"), "digest")


def keep_first(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, all columns as they are: that of the smallest
    doc_id (a null one only if the component has no other), also of repeated
    rows and of texts under one doc_id.  Texts without words stay, each once a
    (doc_id, text)."""
    tied = class_roots(docs, k, percent)[1]
    # the class that stays is its component's first by doc_id, nulls last
    first = tied.groupBy("root").agg(F.min_by("digest", F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first"))
    text, own_set, key = (free_name(docs, x) for x in ("_text", "_set", "_key"))
    gone = written(tied.join(first, "root").where("digest != first").select(F.col("digest").alias(key)), "jac_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            own = [digest(x) for x in sets_of(b.column(at), k)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(own, pa.binary())], names=[*b.schema.names[:width], own_set])

    schema = StructType([*docs.schema.fields, StructField(own_set, BinaryType())])
    # the text goes to the workers once: as it is, or as a string beside it
    width = len(docs.columns)
    at = next(i for i, f in enumerate(docs.schema.fields) if f.name.lower() == "text")
    if docs.schema.fields[at].dataType == StringType():
        marked = arrow_map(docs, run, schema)
    else:
        at = width
        marked = arrow_map(docs.withColumn(text, F.col("text").cast("string")), run, schema)
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.hex("text"), F.lit("-")))
    keyed = marked.withColumn(key, F.coalesce(own_set, F.unhex(F.sha2(own.cast("binary"), 256))))
    # one row a class first, then the classes that go: many rows of a class never meet in one task
    best = one_per(keyed, key, docs.columns, -F.col("doc_id").cast("decimal(20,0)"))
    return best.join(gone, key, "left_anti").drop(key)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("digest")
