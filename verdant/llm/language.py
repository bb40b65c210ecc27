"""Operator 7: language by rank-order profiles.

A text's 1- to 3-grams of letters (lower case, words padded with a blank) are
ranked by frequency; the most frequent ``PROFILE`` of them are its profile.  A
language's profile is that of all its training documents together.  A document
gets the language with the least out-of-place distance: the sum over its profile
of the rank difference, or ``PROFILE`` where the language lacks the n-gram.

Counting covers all training documents: each task sums counts per language over
its rows, Spark adds the sums up by (language, n-gram).  Profiles are the only
thing that reaches the driver: ``PROFILE`` rows per language.

Cases: a text that is null or has no letter gets ``und`` and score 0; ties in
frequency go by n-gram code, ties in distance by language name; without any
training document every prediction is ``und``; null or empty lang isn't learned;
repeated rows count each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import forget
from .common import arrow_map, crc_bucket, slices, table

PROFILE = 300
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: a language's counts are handed on when so many distinct n-grams are held
FLUSH = 1 << 18
SHIFT = 21  # bits of a code point


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-gram codes of a text and their counts."""
    words = LETTERS.findall(text.lower())
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    blank = c == 32
    one = c[~blank]
    # pairs and triples inside one padded word: no two blanks side by side
    apart = blank[:-1] & blank[1:]
    two = (c[:-1] << SHIFT | c[1:])[~apart]
    three = (c[:-2] << 2 * SHIFT | c[1:-1] << SHIFT | c[2:])[~(apart[:-1] | apart[1:])]
    codes = np.concatenate([one, two, three])
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent codes in rank order; ties by code."""
    if len(codes) > 4 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:k]]


def profiles(docs: DataFrame, k: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's k most frequent n-grams over docs(lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[str, dict[int, int]] = {}

        def flush(lang: str) -> pa.RecordBatch:
            sums = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(list(sums), pa.int64()),
                                               pa.array(list(sums.values()), pa.int64())], names=["lang", "gram", "n"])

        for b in slices(batches):  # the n-grams of a few texts at a time
            parts: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                parts.setdefault(lang, []).append(grams(text.as_py() or ""))
            for lang, each in parts.items():
                codes, at = np.unique(np.concatenate([x for x, _ in each]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([x for _, x in each]), minlength=len(codes)).astype(np.int64)
                sums = held.setdefault(lang, {})
                for code, n in zip(codes.tolist(), counts.tolist()):
                    sums[code] = sums.get(code, 0) + n
                if len(sums) > FLUSH:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)

    src = docs.select(F.col("lang").cast("string"), F.col("text")).where("lang is not null")
    sums = arrow_map(src, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    out: dict[str, list] = {}
    for r in ranked.where(F.col("rank") <= k).orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(x, dtype=np.int64) for lang, x in out.items()}


class Profiles:
    """Learned rank tables, ready to compare a text with."""

    def __init__(self, learned: dict[str, np.ndarray], k: int = PROFILE):
        self.k, self.langs = k, sorted(learned)
        self.every = np.unique(np.concatenate([learned[x] for x in self.langs])) if self.langs else np.empty(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.every) + 1), -1, dtype=np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.every, learned[lang])] = np.arange(len(learned[lang]))

    def language(self, text: str) -> tuple[str, float]:
        """The nearest language, and how much nearer it is than the second (or
        than no match at all)."""
        mine = top(*grams(text), self.k)
        if not len(mine) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.every, mine)
        at[at == len(self.every)] = 0
        at[self.every[at] != mine] = len(self.every)
        theirs = self.ranks[:, at]
        away = np.where(theirs < 0, self.k, np.abs(theirs - np.arange(len(mine)))).sum(axis=1)
        best = int(away.argmin())
        second = min([self.k * len(mine), *np.delete(away, best).tolist()])
        return self.langs[best], float(1 - away[best] / second) if second else 1.0


def predict(docs: DataFrame, learned: dict[str, np.ndarray], k: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score of docs(doc_id, text)."""
    known = Profiles(learned, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [known.language(text.as_py() or "") for text in b.column(1)]
            cols = list(zip(*out)) if out else [(), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return arrow_map(src, run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, k: int = PROFILE) -> DataFrame:
    """The rows of docs whose language is known, all columns as they are: texts
    predicted ``und`` go (while no language could be learned: texts without letters)."""
    known = Profiles(profiles(docs.where(crc_bucket() != 0), k), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            keep = [known.language(t or "")[0] != UNKNOWN if known.langs else bool(LETTERS.search(t or "")) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def identify(docs: DataFrame, k: int = PROFILE) -> DataFrame:
    """Learn from the rows that aren't held out, predict all rows."""
    learned = profiles(docs.where(crc_bucket() != 0), k)
    return (predict(docs, learned, k).withColumn("held_out", crc_bucket() == 0)
            .select("doc_id", "held_out", "lang_pred", "score"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
