"""The skew- and scale-specific code paths, checked against brute force on
small inputs: the hot/rare split of index look-ups (forced by a tiny hot
set), global ranks over several range partitions, the regex tokenizer and the
ASCII guard of the accent map, and naive-Bayes probabilities."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdant.functions import text as TX
from verdant.operators import classifiers as C
from verdant.operators import features as FT
from verdant.sources import tables as TB

SF = "/root/testdata/sf0.001"


def _rows(df, key="doc_id"):
    return {r[key]: tuple(r) for r in df.collect()}


def test_rare_word_branch_equals_broadcast(spark, monkeypatch):
    docs = TB.table(spark, SF, "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, ""), (-2, None)], "doc_id long, text string"))
    index = FT.fit_word_index(docs, with_oov=False).cache()
    enc = FT.encode_reviews(docs, index).cache()
    plain_ids = _rows(enc)
    plain_text = _rows(FT.decode_reviews(enc.select("doc_id", "ids"), index))
    monkeypatch.setattr(FT, "HOT_WORDS", 3)   # almost every word goes the rare (shuffled) way
    assert _rows(FT.encode_reviews(docs, index)) == plain_ids
    assert _rows(FT.decode_reviews(enc.select("doc_id", "ids"), index)) == plain_text
    assert plain_ids[-1][1] == [1] and plain_ids[-2][1] == [1]   # empty texts keep their row


def test_decoder_reads_written_ids(spark):
    from verdant.plans.queries import QUERIES
    read = QUERIES["cap_vocabulary"](spark, SF).inputFiles()
    assert read and not any("documents.parquet" in x for x in read)   # no text is encoded again


def test_bounded_ids_equal_unbounded_with_cap(spark, monkeypatch):
    docs = TB.table(spark, SF, "documents").select("doc_id", "text")
    index = FT.fit_word_index(docs).cache()
    bounded = _rows(FT.text_to_ids(docs, index, 50))
    monkeypatch.setattr(FT, "HOT_WORDS", 5)
    capped = FT.text_to_ids(docs, index.where(F.col("id") < 50), None)
    assert _rows(capped) == bounded


def test_global_rank_equals_window(spark):
    words = spark.range(0, 5000).select((F.col("id") % 37).alias("count"),
                                        F.concat(F.lit("w"), (F.col("id") * 7919 % 5000).cast("string")).alias("word"))
    order = [F.col("count").desc(), F.col("word").asc()]
    # several range partitions, with AQE coalescing on (as in a real session)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        ranked = FT._global_rank(words.repartition(5), order, "id", 2)
        got = {r["word"]: r["id"] for r in ranked.collect()}
        parts = ranked.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert parts > 1
    want = {r["word"]: r["id"] for r in
            words.withColumn("id", F.row_number().over(Window.orderBy(*order)) + 1).collect()}
    assert got == want


def test_sequence_words_equal_translate_definition(spark):
    filters = TX.SEQUENCE_FILTERS
    texts = ["a^b&&c [x]\\y-z", "  Hello,World!  ", "tab\there\nnew", filters, "", "ÉTÉ été_ok", "a--b..c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spaced = F.translate(F.lower(F.col("text")), filters, " " * len(filters))
    ref = F.filter(F.split(spaced, " "), lambda w: w != "")
    out = df.select(TX.sequence_words(F.col("text")).alias("a"), ref.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in out)


def test_ascii_guard_equals_full_accent_map(spark):
    texts = ["plain ascii", "Café Crème", "ÀÉÎÕÜ ß ø", "naïve", "", None, "x" * 1000 + "é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    full = TX.strip_accents(F.lower(F.col("text")))
    out = df.select(TX.normalise(F.col("text")).alias("a"), full.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in out)


def test_naive_bayes_probabilities_sum_to_one(spark):
    w = spark.createDataFrame([(1, 0, "a", 0.6), (1, 0, "b", 0.8), (2, 1, "b", 1.0), (3, 1, "c", 1.0)],
                              "doc_id long, label int, term string, weight double")
    docs = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, label int")
    vocab = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "term string")
    lp, prior = C.fit_naive_bayes(w, docs, vocab, [0, 1])
    sums = {r["class"]: r["s"] for r in lp.groupBy("class").agg(F.sum(F.exp("flp")).alias("s")).collect()}
    assert sums[0] == pytest.approx(1.0) and sums[1] == pytest.approx(1.0)
    got = {(r["class"], r["term"]): r["flp"] for r in lp.collect()}
    # class 0: weights a 0.6, b 0.8; total 1.4 + alpha * V (4)
    assert got[(0, "a")] == pytest.approx(math.log(1.6 / 5.4))
    assert got[(0, "d")] == pytest.approx(math.log(1.0 / 5.4))
    pri = {r["class"]: r["prior"] for r in prior.collect()}
    assert pri[1] == pytest.approx(math.log(2 / 3))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_table_keeps_rows_and_layout(spark):
    from verdant.session import bucketed_table
    df = spark.range(0, 3000).select((F.col("id") % 211).alias("doc_id"), F.col("id").alias("v"))
    t = bucketed_table(df, "doc_id", "test rows")
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, df.collect()))
    other = bucketed_table(df.select("doc_id", (F.col("v") * 2).alias("w")), "doc_id", "test other")
    per_doc = t.groupBy("doc_id").agg(F.sum("v").alias("s"))
    joined = per_doc.join(other.groupBy("doc_id").agg(F.sum("w").alias("sw")), "doc_id")
    shuffle = "Exchange hashpartitioning"   # broadcasts are fine, shuffles are not
    assert shuffle not in _plan(per_doc) and shuffle not in _plan(joined)
    assert joined.where(F.col("sw") != 2 * F.col("s")).count() == 0


@pytest.mark.parametrize("k", [1, 7, 50, 333, 5000])
def test_top_k_by_count_equals_sort_limit(spark, k):
    df = spark.range(0, 1200).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"),
                                     (F.floor(F.col("id") % 13 / 4) + (F.col("id") % 5 == 0).cast("long") * 40).cast("long").alias("count"))
    want = [r["term"] for r in df.orderBy(F.col("count").desc(), F.col("term").asc()).limit(k).collect()]
    got = FT.top_k_by_count(df, k, "count", "term")
    assert sorted(r["term"] for r in got.collect()) == sorted(want)


def test_top_k_distributed_rank_path(spark, monkeypatch):
    monkeypatch.setattr(FT, "MAX_BROADCAST_TERMS", 10)   # candidates above the bound: range rank
    df = spark.range(0, 900).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"),
                                    (F.col("id") % 7).alias("count"))
    want = [r["term"] for r in df.orderBy(F.col("count").desc(), F.col("term").asc()).limit(200).collect()]
    got = FT.top_k_by_count(df, 200, "count", "term")
    assert sorted(r["term"] for r in got.collect()) == sorted(want)


def test_uncapped_naive_bayes_hot_split_equals_broadcast(spark):
    w = spark.createDataFrame([(d, d % 2, t, float((d * 7 + len(t)) % 5 + 1) / 5.0)
                               for d in range(1, 41) for t in ("the", "a", f"w{d % 6}", f"x{d % 11}")],
                              "doc_id long, label int, term string, weight double")
    docs = w.select("doc_id", "label").distinct()
    counts = w.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    lp, prior = C.fit_naive_bayes(w, docs, counts, [0, 1])
    capped = C.predict_naive_bayes(w, docs, lp, prior, [0, 1], 1000)
    split = C.predict_naive_bayes(w, docs, lp, prior, [0, 1], None, term_counts=counts, hot_terms=2)
    plain = C.predict_naive_bayes(w, docs, lp, prior, [0, 1], None)
    want = {r["doc_id"]: (r["y_pred"], round(r["prob"], 12)) for r in capped.collect()}
    assert {r["doc_id"]: (r["y_pred"], round(r["prob"], 12)) for r in split.collect()} == want
    assert {r["doc_id"]: (r["y_pred"], round(r["prob"], 12)) for r in plain.collect()} == want


def test_accents_of_every_character(spark):
    """Compatibility decomposition without combining marks, for every character."""
    import sys
    import unicodedata
    every = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[i:i + 256]) for i in range(0, len(every), 256)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", TX.strip_accents(F.col("t")).alias("s")).collect()
    for r in got:
        assert r["s"] == "".join(c for c in unicodedata.normalize("NFKD", r["t"]) if not unicodedata.combining(c))


def test_weights_by_document_match_the_long_table(spark, monkeypatch):
    """Counting inside the row, also for ids that repeat or are missing, gives what grouping the term rows gives."""
    from verdant.operators import features as FT
    from verdant.plans import classic

    words = ["alpha", "beta", "Gamma", "d\u00e9lta", "epsilon", "zeta"]
    rows = [(i, " ".join(words[(i * k) % 6] for k in range(1, 3 + i % 5)), i % 2) for i in range(60)]
    rows += [(3, "alpha beta", 1), (3, "beta zeta zeta", 1), (4, None, 0), (None, "alpha zeta", 0), (None, "alpha", 0), (70, None, 1), (71, "", 0), (72, "!?", 1)]
    where = ["train", "train", "train", "val", "test"]
    split = spark.createDataFrame([(d, t, y, where[i % 5]) for i, (d, t, y) in enumerate(rows)], "doc_id long, text string, label int, split string")

    def made(split, materialize):
        p = classic.prepare(None, max_features=12, materialize=materialize, split=split)
        show = lambda df: sorted(([round(x, 9) if isinstance(x, float) else x for x in r] for r in df.collect()), key=repr)
        entries = classic.vector_rows(p)[0].select("doc_id", "label", "split", "y", F.explode(F.arrays_zip("index", "value")).alias("e"))
        return [show(p.vocab.select("term", "count", "df", "idf", "term_index")), show(p.weights.select("doc_id", "label", "split", "term", "weight")),
                show(entries.select("doc_id", "label", "split", "y", "e.index", "e.value")), classic.vector_rows(p)[0].count()]

    assert made(split, True) == made(split.fillna("", ["text"]), False)
    calls = []
    plain = FT.doc_terms
    monkeypatch.setattr(FT, "doc_terms", lambda *a, **k: calls.append(1) or plain(*a, **k))
    once = split.where("doc_id < 60 and doc_id not in (3, 4)")
    assert made(once, True)[1] and not calls  # no term rows grouped by document
