"""Text features: TF-IDF in long form ``(doc_id, term, weight)`` and integer
id sequences.

Scale notes
* Text is hash-partitioned by document once; per-document term counts and
  the TF-IDF norm then reuse that partitioning (no shuffle of term rows).
* The vocabulary is one grouped aggregate by term; the partial aggregate
  collapses hot terms map-side before the shuffle.
* A vocabulary capped by ``max_features`` is broadcast (its size is bounded by
  the parameter and checked against ``MAX_BROADCAST_TERMS``); an unlimited
  vocabulary is joined with a shuffle instead.
* Word-to-id look-ups against an unbounded word index split the index: the
  ``HOT_WORDS`` most frequent ids are broadcast, the rest is a shuffled join
  that by construction holds no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import (INDEX_FROM, OOV_ID_ENCODED, START_ID, UNKNOWN_WORD, attention_mask,
                              normalise, pad_ids, sequence_words, word_tokens)
from ..session import cut_lineage, ship_package

MAX_BROADCAST_TERMS = 2_000_000
# a vocabulary of at most so many terms is looked up inside each document
MAX_LOCAL_TERMS = 200_000
HOT_WORDS = 100_000
# words that a task holds as numbers before it hands on their n-grams' counts
HELD_WORDS = 1 << 20
# ``TOKEN_PATTERN`` for ASCII texts
ASCII_WORDS = re.compile(r"[A-Za-z0-9_]{2,}")


def _bounded(df: DataFrame, bound: int | None) -> DataFrame:
    """Broadcast only when the row count is bounded by a parameter."""
    return F.broadcast(df) if bound is not None and bound <= MAX_BROADCAST_TERMS else df


# --------------------------------------------------------------------- T1-T4
def tokens(df: DataFrame, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    return df.withColumn(out_col, word_tokens(normalise(F.col(text_col))))


def with_ngrams(df: DataFrame, text_col: str = "text", ngram_max: int = 2, out_col: str = "_terms") -> DataFrame:
    """Adds ARRAY<STRING> of all 1..ngram_max grams (unigrams first).  Bigrams
    and longer come from the JVM ``NGram`` transformer (a compiled sliding
    window; Spark's interpreted lambdas are much slower for this)."""
    staged = df.withColumn("_tok", word_tokens(normalise(F.col(text_col))))
    parts = [F.col("_tok")]
    for n in range(2, ngram_max + 1):
        staged = NGram(n=n, inputCol="_tok", outputCol=f"_g{n}").transform(staged)
        parts.append(F.col(f"_g{n}"))
    out = staged.withColumn(out_col, F.concat(*parts) if len(parts) > 1 else parts[0])
    return out.drop("_tok", *[f"_g{n}" for n in range(2, ngram_max + 1)])


def doc_terms(df: DataFrame, text_col: str = "text", ngram_max: int = 2,
              keep=("doc_id",)) -> DataFrame:
    """(keep..., term, tf): distinct n-grams of each row with raw counts.

    ``keep`` must start with ``doc_id``; the other kept columns depend on the
    document only.  When the input is hash-partitioned by ``doc_id`` (see
    ``session.by_doc``) the grouped count runs without a shuffle.
    """
    grams = with_ngrams(df.select(*keep, text_col), text_col, ngram_max)
    # explode_outer: an inner explode makes the optimizer add a size() > 0
    # filter that evaluates the whole tokenizer a second time
    return (grams.select(*keep, F.explode_outer("_terms").alias("term")).where(F.col("term").isNotNull())
                 .groupBy(*keep, "term").agg(F.count(F.lit(1)).cast("long").alias("tf")))


# --------------------------------------------------------------------- T5
def fit_vocabulary(train_terms: DataFrame, max_features: int | None = 50000, n_docs: int | None = None) -> DataFrame:
    """(term, count, df, idf[, term_index]) fitted on training rows.

    Keeps the ``max_features`` terms of highest total count (ties by term);
    idf = ln((1 + n) / (1 + df)) + 1 (smoothed); ``term_index`` is the
    alphabetical feature position among kept terms.
    """
    stats = train_terms.groupBy("term").agg(F.sum("tf").cast("long").alias("count"),
                                            F.count(F.lit(1)).cast("long").alias("df"))
    if max_features is not None:
        if max_features <= 0:
            raise ValueError("max_features must be positive or None")
        # read by the threshold, the choice and the index: counted once
        stats = top_k_by_count(cut_lineage(stats), max_features, "count", "term")
    if n_docs is None:
        n_docs = train_terms.select("doc_id").distinct().count()
    n = F.lit(float(n_docs))
    vocab = stats.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    if max_features is not None:
        order = F.col("term").asc()
        if max_features <= MAX_BROADCAST_TERMS:  # so many rows at most
            vocab = vocab.withColumn("term_index", F.row_number().over(Window.orderBy(order)) - 1)
        else:
            vocab = rank_rows(vocab, [order], "term_index", 0)
        vocab = vocab.withColumn("term_index", F.col("term_index").cast("int"))
    return vocab


def readable(df: DataFrame, text_col: str, keep=()) -> DataFrame:
    """(keep..., plain, words): the normalised text if it is ASCII, else its word
    tokens.  For ASCII a word pattern means the same to Java and to Python."""
    low = df.select(*keep, normalise(F.col(text_col)).alias("_low"))
    plain = F.octet_length("_low") == F.length("_low")
    return low.select(*keep, F.when(plain, F.col("_low")).alias("plain"), F.when(~plain, word_tokens(F.col("_low"))).alias("words"))


def words_of(b: pa.RecordBatch) -> Iterator[list[str]]:
    """The words of each row(..., plain, words)."""
    for plain, words in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
        yield ASCII_WORDS.findall(plain) if plain is not None else words or []


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts in one array, the text of each, and how many
    words its text still has from there on."""
    sizes = np.array([len(x) for x in texts], np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *texts])
    return flat, np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))


def few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of a few rows, so that few texts are Python strings at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


class Numbers(dict):
    """Numbers words from 0 on, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def gram_counts(texts: list[np.ndarray], words: list[str], ngram_max: int) -> Iterator[pa.RecordBatch]:
    """(term, n): how often each 1..ngram_max gram is in texts of word numbers.  An
    n-gram is counted as the number of its first n - 1 words and that of its last;
    only distinct ones become strings."""
    flat, _, left = laid_out(texts)
    names = grams = pa.array(words, pa.string())
    code, distinct, counts = flat, np.arange(len(words)), np.bincount(flat, minlength=len(words))
    for n in range(1, ngram_max + 1):
        if n > 1:
            at = np.flatnonzero(left >= n)  # a text ends before its last n - 1 words begin another
            key = code[at] * len(words) + flat[at + n - 1]
            distinct, counts = np.unique(key, return_counts=True)
            grams = pc.binary_join_element_wise(grams.take(pa.array(distinct // max(len(words), 1))), names.take(pa.array(distinct % max(len(words), 1))), " ")
            if n < ngram_max:
                code = np.zeros(len(flat), np.int64)
                code[at] = np.searchsorted(distinct, key)
        yield pa.RecordBatch.from_arrays([grams, pa.array(counts, pa.int64())], names=["term", "n"])


def choose_terms(train: DataFrame, max_features: int, text_col: str = "text", ngram_max: int = 2) -> DataFrame:
    """(term, count, term_index): the terms that ``fit_vocabulary`` keeps.  A
    term's total count needs no counts by document: each task adds up the n-grams
    of ``HELD_WORDS`` words at a time as numbers, and Spark adds up by term."""
    ship_package(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = Numbers(), [], 0
        for b in few(batches):
            for words in words_of(b):
                held.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size >= HELD_WORDS:
                    yield from gram_counts(held, list(number), ngram_max)
                    number, held, size = Numbers(), [], 0
        yield from gram_counts(held, list(number), ngram_max)

    counts = (readable(train, text_col).mapInArrow(run, "term string, n long")
              .groupBy("term").agg(F.sum("n").cast("long").alias("count")))
    kept = top_k_by_count(cut_lineage(counts), max_features, "count", "term")
    return kept.withColumn("term_index", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))  # max_features rows


@dataclass
class Grams:
    """Terms as a tree of words, for look-ups by number.  ``levels``: for each number
    of words, the sorted keys (code of all words but the last x words + number of the last)
    and the term's position, -1 where only longer terms begin so; a code is a place in the keys."""

    number: dict[str, int]
    first: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, terms: list[str], ngram_max: int) -> Grams:
        number = Numbers()
        parts = [[number[w] for w in t.split(" ")] for t in terms]
        first = np.full(len(number), -1, np.int64)
        for i, p in enumerate(parts):
            if len(p) == 1:
                first[p[0]] = i
        levels, code = [], {(w,): w for w in range(len(number))}
        for n in range(2, min(max(map(len, parts), default=1), ngram_max) + 1):
            key = {tuple(p[:n]): code[tuple(p[:n - 1])] * len(number) + p[n - 1] for p in parts if len(p) >= n}
            keys = np.array(sorted(key.values()), np.int64)
            code = {p: int(np.searchsorted(keys, k)) for p, k in key.items()}
            position = np.full(len(keys), -1, np.int64)
            for i, p in enumerate(parts):
                if len(p) == n:
                    position[code[tuple(p)]] = i
            levels.append((keys, position))
        return cls(dict(number), first, levels)

    def found(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The text and the position of every term in the texts, repeats included."""
        flat, row, left = laid_out([np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words)) for words in texts])
        at = np.flatnonzero(flat >= 0)
        code = flat[at]
        rows, terms = [row[at]], [self.first[code]]
        for n, (keys, position) in enumerate(self.levels, 2):
            more = np.flatnonzero(left[at] >= n)
            at, code = at[more], code[more]
            last = flat[at + n - 1]
            key = code * len(self.number) + last
            code = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = np.flatnonzero((last >= 0) & (keys[code] == key))
            at, code = at[known], code[known]
            rows.append(row[at])
            terms.append(position[code])
        row, term = np.concatenate(rows), np.concatenate(terms)
        return row[term >= 0], term[term >= 0]


def count_vectors(df: DataFrame, terms: list[str], text_col: str = "text", ngram_max: int = 2, keep=("doc_id",)) -> DataFrame:
    """(keep..., index, tf): each row's counts of ``terms`` (positions ascending).
    The counting happens inside the row, in a broadcast tree of the terms' words; no term
    row is exploded, grouped or joined, and no n-gram becomes a string."""
    spark = df.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(Grams.of(terms, ngram_max))  # max_features entries
    width = max(len(terms), 1)
    read = readable(df, text_col, keep)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            row, flat = sent.value.found(list(words_of(b)))
            cell, tf = np.unique(row * width + flat, return_counts=True)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(cell // width, minlength=b.num_rows))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.ListArray.from_arrays(offsets, pa.array((cell % width).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))], names=[*b.schema.names[:-2], "index", "tf"])

    return read.mapInArrow(run, f"{kept}, index array<int>, tf array<bigint>")


def document_frequencies(counts: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """(term, count, df, idf, term_index) of chosen ``terms``; ``counts(index)`` holds
    one row per training document."""
    df = counts.select(F.explode("index").alias("term_index")).groupBy("term_index").agg(F.count(F.lit(1)).cast("long").alias("df"))
    n = F.lit(float(n_docs))
    return terms.join(df, "term_index").select(
        "term", "count", "df", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"), "term_index")


def weigh(counts: DataFrame, vocab: DataFrame, keep=("doc_id",)) -> DataFrame:
    """(keep..., index, value): ``tfidf`` weights of counts(index, tf), one row per
    document.  The idf values, as many as the vocabulary has terms, are broadcast."""
    spark = counts.sparkSession
    ship_package(spark)
    rows = vocab.select("term_index", "idf").orderBy("term_index").collect()  # max_features rows
    idf = spark.sparkContext.broadcast(np.array([r["idf"] for r in rows], float))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, tf = b.column("index"), b.column("tf")
            w = tf.flatten().to_numpy() * idf.value[index.flatten().to_numpy()]
            row = np.repeat(np.arange(b.num_rows), index.value_lengths().to_numpy(zero_copy_only=False))
            value = w / np.sqrt(np.bincount(row, weights=w * w, minlength=b.num_rows))[row]
            offsets = np.append(0, np.cumsum(np.bincount(row, minlength=b.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.ListArray.from_arrays(offsets, index.flatten()),
                                              pa.ListArray.from_arrays(offsets, pa.array(value))], names=[*keep, "index", "value"])

    return counts.select(*keep, "index", "tf").mapInArrow(run, f"{kept}, index array<int>, value array<double>")


def rank_rows(df: DataFrame, order: list[Column], out_col: str, start: int) -> DataFrame:
    """Positions in ``order`` + ``start`` by the range-partitioned global rank,
    at every size."""
    return _global_rank(df, order, out_col, start)


def top_k_by_count(df: DataFrame, k: int, count_col: str, key_col: str) -> DataFrame:
    """The ``k`` rows with the highest integer ``count_col`` (ties by
    ascending ``key_col``), exactly, without gathering partitions' top-k lists
    into one task (what ``orderBy().limit(k)`` does).

    A histogram of the count values (one row per distinct count, a table far
    smaller than the input) gives the count of the k-th row; rows above it are
    in, and of the rows that have it the first by key are found by the
    range-partitioned global rank."""
    hist = df.groupBy(count_col).agg(F.count(F.lit(1)).alias("_rows"))
    at_least = F.sum("_rows").over(Window.orderBy(F.col(count_col).desc())
                                   .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reach = F.col("_cum") >= k
    # threshold = count of the k-th row; rows above it
    threshold, above = hist.withColumn("_cum", at_least).agg(
        F.max(F.when(reach, F.col(count_col))), F.min(F.when(reach, F.col("_cum") - F.col("_rows")))).first()
    if threshold is None:
        return df
    tied = rank_rows(df.where(F.col(count_col) == F.lit(threshold)), [F.col(key_col).asc()], "_rank", 1)
    return df.where(F.col(count_col) > F.lit(threshold)).unionByName(tied.where(F.col("_rank") <= k - above).drop("_rank"))


# --------------------------------------------------------------------- T6-T8
def term_counts(doc_terms_df: DataFrame, vocab: DataFrame, max_features: int | None) -> DataFrame:
    """(doc_id, term, tf) restricted to the vocabulary."""
    return doc_terms_df.join(_bounded(vocab.select("term"), max_features), "term")


def tfidf(doc_terms_df: DataFrame, vocab: DataFrame, max_features: int | None,
          keep=("doc_id",)) -> DataFrame:
    """(keep..., term, weight): tf * idf, L2-normalised per document."""
    joined = doc_terms_df.join(_bounded(vocab.select("term", "idf"), max_features), "term")
    raw = joined.withColumn("_w", F.col("tf").cast("double") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("doc_id")))
    return raw.select(*keep, "term", (F.col("_w") / norm).alias("weight"))


def document_vectors(weights: DataFrame, docs: DataFrame, vocab: DataFrame, max_features: int | None,
                     keep=("doc_id", "label", "split")) -> DataFrame:
    """(keep..., index, value): one sparse row per document of ``docs``, indexes
    ascending; a document without a term of the vocabulary has none.  Grouped by
    document like its inputs: tables bucketed by ``doc_id`` don't move."""
    if "term_index" not in vocab.columns:
        vocab = rank_rows(vocab, [F.col("term").asc()], "term_index", 0)
    entries = weights.join(_bounded(vocab.select("term", F.col("term_index").cast("int").alias("term_index")), max_features), "term")
    rows = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_index", "weight"))).alias("_x"))
    return docs.select(*keep).join(rows, "doc_id", "left").select(
        *keep, F.coalesce(F.col("_x.term_index"), F.array().cast("array<int>")).alias("index"),
        F.coalesce(F.col("_x.weight"), F.array().cast("array<double>")).alias("value"))


# --------------------------------------------------------------------- T9
def fit_word_index(train: DataFrame, text_col: str = "text", with_oov: bool = True) -> DataFrame:
    """(word, id, count): words ranked by frequency (ties by word).  With
    ``with_oov`` id 1 is the OOV token and words start at 2; otherwise words
    start at 1.  Ranking runs on the (word, count) aggregate ordered by a
    range partitioning, not in a single task."""
    from ..functions.text import OOV_TOKEN

    counts = (train.select(F.explode_outer(sequence_words(F.col(text_col))).alias("word"))
                   .where(F.col("word").isNotNull())
                   .groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("count")))
    start = 2 if with_oov else 1
    ranked = _global_rank(counts, [F.col("count").desc(), F.col("word").asc()], "id", start)
    if not with_oov:
        return ranked
    spark = train.sparkSession
    oov = spark.createDataFrame([(OOV_TOKEN, 1, 0)], "word string, id long, count long")
    return oov.unionByName(ranked)


def _global_rank(df: DataFrame, order: list[Column], out_col: str, start: int) -> DataFrame:
    """Dense 0..n-1 positions in ``order`` + ``start`` without one-task windows.

    Range-partition and sort; ``monotonically_increasing_id`` evaluated right
    after the sort holds the partition index in its upper bits and the row's
    position inside the partition in its lower 33 bits.  These positions
    depend on the physical layout (sampled range bounds), which a second
    execution of the plan could choose differently, so the positioned rows are
    written once (reliable checkpoint in the shared folder) and everything
    below reads that copy.  A table of partition sizes (one row per partition,
    so its broadcast is bounded by the partition count) supplies each
    partition's offset.  The ranked rows are shuffled once (the range
    exchange); the order is total, so positions are deterministic."""
    from ..session import cut_lineage

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    pos = cut_lineage(ordered.withColumn("_mid", mid).select(
        "*", F.shiftright("_mid", 33).alias("_pid"), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_lr")))
    sizes = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = sizes.select("_pid", F.coalesce(
        F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (pos.join(F.broadcast(offsets), "_pid")
               .withColumn(out_col, (F.col("_off") + F.col("_lr") + F.lit(start)).cast("long"))
               .drop("_mid", "_pid", "_lr", "_off"))


def ordered_lookup(pieces: DataFrame, group: list[str], index: DataFrame, key: str, value: str,
                   default: Column, bound: int | None, hot_limit: int | None = None,
                   rank_col: str = "id") -> DataFrame:
    """(group..., _vals): per group, ``value`` of each piece's ``key`` in
    ``pos`` order; a key missing from the index gives ``default``.

    ``pieces(group..., pos, key)`` may hold one row with NULL ``pos`` for an
    empty group (``posexplode_outer``), which yields an empty array.  The
    ``hot_limit`` first index entries are broadcast, so when ``pieces`` is
    hash-partitioned by the first group column the per-group assembly runs
    without a shuffle; only pieces whose key is outside that set (rare keys,
    so no hot key by construction) are joined with a shuffle, assembled per
    group and merged back with a join on the group.  When the index size is
    bounded by ``bound`` <= ``hot_limit`` a single broadcast join does it all.
    """
    hot_limit = HOT_WORDS if hot_limit is None else hot_limit

    def assemble(df, val):
        item = F.when(F.col("pos").isNotNull(), F.struct("pos", val.alias("v")))
        return df.groupBy(*group).agg(F.collect_list(item).alias("_items"))

    def values(items):
        return F.transform(F.array_sort(items), lambda s: s["v"])

    if bound is not None and bound <= hot_limit:
        found = pieces.join(F.broadcast(index.select(key, F.col(value).alias("_v"))), key, "left")
        return assemble(found, F.coalesce(F.col("_v"), default)).select(*group, values(F.col("_items")).alias("_vals"))
    hot = index.where(F.col(rank_col) <= hot_limit).select(key, F.col(value).alias("_v"))
    cold = index.where(F.col(rank_col) > hot_limit).select(key, F.col(value).alias("_v"))
    first = pieces.join(F.broadcast(hot), key, "left")
    # every piece once, hot values filled, the others marked NULL
    local = assemble(first, F.col("_v"))
    missing = first.where(F.col("_v").isNull() & F.col(key).isNotNull()).drop("_v")
    rare = assemble(missing.join(cold, key, "left"), F.coalesce(F.col("_v"), default)) \
        .withColumnRenamed("_items", "_rare")
    merged = local.join(rare, group, "left")
    known = F.filter("_items", lambda s: s["v"].isNotNull())
    items = F.concat(known, F.coalesce(F.col("_rare"), F.array().cast(merged.schema["_items"].dataType)))
    return merged.select(*group, values(items).alias("_vals"))


# --------------------------------------------------------------------- T10
def text_to_ids(df: DataFrame, word_index: DataFrame, num_words: int | None = None,
                text_col: str = "text", out_col: str = "ids", oov_id: int = 1) -> DataFrame:
    """Word ids per row in text order; unknown words and ids >= num_words
    become ``oov_id``.  The other columns of ``df`` must depend on ``doc_id``
    only (they are carried as grouping keys, so no join back to the input is
    needed).  Input hash-partitioned by ``doc_id`` is not shuffled again."""
    others = [c for c in df.columns if c != text_col]
    if "doc_id" not in others:
        raise ValueError("text_to_ids needs a doc_id column")
    group = ["doc_id"] + [c for c in others if c != "doc_id"]
    pieces = df.select(*group, F.posexplode_outer(sequence_words(F.col(text_col))).alias("pos", "word"))
    idx = word_index.select("word", "id")
    bounded = num_words is not None and num_words > 0
    if bounded:
        idx = idx.where(F.col("id") < num_words)
    out = ordered_lookup(pieces, group, idx, "word", "id", F.lit(oov_id), num_words if bounded else None)
    return out.select(*others, F.col("_vals").cast("array<int>").alias(out_col))


# --------------------------------------------------------------------- T11
def pad_sequences(df: DataFrame, max_len: int, ids_col: str = "ids", out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or ids_col, pad_ids(F.col(ids_col), max_len))


# --------------------------------------------------------------------- T12
def vocab_size(word_index: DataFrame, max_words: int | None) -> DataFrame:
    """max_words when positive, else the number of index entries + 1."""
    if max_words is not None and max_words > 0:
        return word_index.sparkSession.range(1).select(F.lit(max_words).cast("long").alias("vocab_size"))
    return word_index.agg((F.count(F.lit(1)) + 1).cast("long").alias("vocab_size"))


# --------------------------------------------------------------------- T13
def encode_fixed(df: DataFrame, max_length: int = 256, ids_col: str = "ids") -> DataFrame:
    """input_ids padded/truncated to ``max_length`` plus the attention mask."""
    return df.select(*[c for c in df.columns if c != ids_col],
                     pad_ids(F.col(ids_col), max_length).alias("input_ids"),
                     attention_mask(F.col(ids_col), max_length).alias("attention_mask"))


# --------------------------------------------------------------------- T14
def encode_dynamic(df: DataFrame, ids_col: str = "ids", max_length: int = 256) -> DataFrame:
    """Pad to the longest row of the input (capped at ``max_length``); the
    length is a scalar aggregate, read once."""
    longest = df.agg(F.max(F.size(ids_col))).first()[0] or 0
    return encode_fixed(df, min(int(longest), max_length), ids_col)


# --------------------------------------------------------------------- S2-S4
def encode_reviews(df: DataFrame, word_index: DataFrame, text_col: str = "text") -> DataFrame:
    """Integer-encoded reviews: start id, then word index + 3 (index from 1)."""
    seq = text_to_ids(df, word_index, None, text_col, "_ids", oov_id=-INDEX_FROM)
    shifted = F.transform("_ids", lambda i: i + F.lit(INDEX_FROM))
    return seq.withColumn("ids", F.concat(F.array(F.lit(START_ID)), shifted)).drop("_ids")


def cap_vocabulary(df: DataFrame, max_words: int | None, ids_col: str = "ids") -> DataFrame:
    """Ids >= max_words become the out-of-vocabulary id 2; ``None`` or <= 0
    keeps every id."""
    if max_words is None or max_words <= 0:
        return df
    return df.withColumn(ids_col, F.transform(ids_col, lambda i: F.when(i >= max_words, F.lit(OOV_ID_ENCODED)).otherwise(i)))


def decode_reviews(df: DataFrame, word_index: DataFrame, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Text from ids: word of (id - 3), '?' when absent, joined by spaces.
    The other columns must depend on ``doc_id`` only; input partitioned by
    ``doc_id`` is not shuffled again."""
    others = [c for c in df.columns if c != ids_col]
    group = ["doc_id"] + [c for c in others if c != "doc_id"]
    pieces = df.select(*group, F.posexplode_outer(ids_col).alias("pos", "_id")) \
               .withColumn("id", F.col("_id") - F.lit(INDEX_FROM)).drop("_id")
    out = ordered_lookup(pieces, group, word_index.select("id", "word"), "id", "word", F.lit(UNKNOWN_WORD), None)
    return out.select(*others, F.array_join("_vals", " ").alias(out_col))


def union_partitions(first: DataFrame, second: DataFrame) -> DataFrame:
    """UNION ALL of two parts with the same columns (train + test)."""
    return first.unionByName(second)
