"""Registered queries: one per operator of the inventory, over the given
tables (or views Spark derives from them), plus the DuckDB SQL that checks it.

Every Spark query rounds DOUBLE outputs to six digits; the SQL does the same
through ``oracle.wrap``.  Arrays are returned joined into strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.math import argmax, softmax_at
from ..operators import classifiers as C
from ..operators import ensemble as E
from ..operators import features as FT
from ..operators import history as H
from ..operators import metrics as M
from ..operators import prepare as P
from ..operators import scoring as SC
from ..operators import summary as L
from ..sources import checkpoints as CK
from ..sources import emissions as EM
from ..sources import reviews as RV
from ..sources import sinks as K
from ..sources import tables as TB
from ..session import bucketed_table, by_doc, cut_lineage, scratch_path, ship_package
from . import oracle as O
from .classic import Prepared, nb_scores, prepare, prepare_split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODELS = TB.SIM_MODELS
PAIR = ("m0", "m1")
MEMBER_SETS = (("max_trio", "m0"), ("max_trio", "m1"), ("max_trio", "m2"),
               ("green_pair", "m1"), ("green_pair", "m2"))


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: round_doubles(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- shared inputs
_PREPARED: dict = {}


def _source(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return TB.reviews(spark, sf_dir) if label == "quality" else TB.lang_reviews(spark, sf_dir)


def prepared_split(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """The checkpointed 80/10/10 split alone (for flows without TF-IDF)."""
    key = (spark.sparkContext.applicationId, sf_dir, label, "split")
    if key not in _PREPARED:
        _PREPARED[key] = prepare_split(_source(spark, sf_dir, label))
    return _PREPARED[key]


def prepared(spark: SparkSession, sf_dir: str, label: str = "quality") -> Prepared:
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _PREPARED:
        _PREPARED[key] = prepare(_source(spark, sf_dir, label), split=prepared_split(spark, sf_dir, label))
    return _PREPARED[key]


def scores(spark, sf_dir):
    """The shared scores table, materialised once per session and scale: every
    metric, vote and leaderboard reads it (checkpointed, not recomputed)."""
    key = (spark.sparkContext.applicationId, sf_dir, "scores")
    if key not in _PREPARED:
        # bucketed by document: every vote (grouped by split and document) and
        # the meta features run without a shuffle
        _PREPARED[key] = bucketed_table(TB.model_scores(spark, sf_dir), "doc_id", "scores")
    return _PREPARED[key]


def member_sets(spark) -> DataFrame:
    return spark.createDataFrame(list(MEMBER_SETS), "ensemble string, model string")


def emissions(spark, sf_dir):
    return EM.emissions_lookup(TB.emission_log(spark, sf_dir), ("ts", "event_id"))


SC_CTE = O.model_scores_ctes()
MS_VALUES = ", ".join(f"('{e}', '{m}')" for e, m in MEMBER_SETS)


def W(body, cols, doubles=()):
    return O.wrap(body, cols, set(doubles))


# =========================================================== sources / sinks
@query("read_reviews", W(f"WITH {O.REVIEWS} SELECT doc_id, text, label FROM reviews", ["doc_id", "text", "label"]))
def q_read_reviews(spark, sf):
    path = scratch_path(spark, "reviews-csv")
    K.write_csv(TB.reviews(spark, sf), path)
    return RV.read_reviews(spark, path, schema="doc_id long, text string, label int")


@query("csv_roundtrip", W("SELECT doc_id, text, lang, source, n_chars FROM documents",
                          ["doc_id", "text", "lang", "source", "n_chars"]))
def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "documents-csv")
    K.write_csv(TB.table(spark, sf, "documents"), path)
    return (spark.read.schema("doc_id long, text string, lang string, source string, n_chars long")
                 .option("header", True).option("multiLine", True).option("escape", '"').csv(path))


@query("read_polarity", W(f"WITH {O.REVIEWS} SELECT doc_id, text, label FROM reviews", ["doc_id", "text", "label"]))
def q_read_polarity(spark, sf):
    path = scratch_path(spark, "polarity-json")
    K.write_json(TB.reviews(spark, sf), path)
    return RV.read_polarity(spark, path, fmt="json")


_SW = (f"sw AS (SELECT doc_id, list_filter(string_split(translate(lower(text), {O.SEQ_FILTERS_SQL}, "
       f"repeat(' ', 34)), ' '), lambda x: x <> '') AS ws FROM documents)")
_WI = ("wc AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(ws) AS word FROM sw) GROUP BY word), "
       "wi AS (SELECT word, row_number() OVER (ORDER BY cnt DESC, word ASC) AS id FROM wc)")


def _decode_sql(cap: int | None) -> str:
    word = "CASE WHEN wi.id + 3 >= %d THEN '?' ELSE x.word END" % cap if cap else "x.word"
    return (f"WITH {_SW}, {_WI}, x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM sw), "
            f"j AS (SELECT x.doc_id, string_agg({word}, ' ' ORDER BY x.pos) AS t FROM x JOIN wi ON x.word = wi.word GROUP BY x.doc_id) "
            "SELECT d.doc_id, CASE WHEN j.t IS NULL THEN '?' ELSE '? ' || j.t END AS text FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id")


def _encoded(spark, sf):
    # the index needs no order by document, so it reads the table as it lies; the ranked
    # rows are written once inside the rank, so each later read is a scan of that
    # copy plus a broadcast of partition offsets
    raw = TB.table(spark, sf, "documents").select("doc_id", "text")
    index = FT.fit_word_index(raw, with_oov=False)
    # text shuffled once by document: the id sequences are then assembled without
    # shuffling the (much larger) word rows, and written, for the decoder reads
    # them for its hot and its rare words
    return bucketed_table(FT.encode_reviews(by_doc(raw), index), "doc_id", "encoded"), index


@query("decode_reviews", W(_decode_sql(None), ["doc_id", "text"]))
def q_decode_reviews(spark, sf):
    enc, index = _encoded(spark, sf)
    return FT.decode_reviews(enc.select("doc_id", "ids"), index).select("doc_id", "text")


@query("cap_vocabulary", W(_decode_sql(200), ["doc_id", "text"]))
def q_cap_vocabulary(spark, sf):
    enc, index = _encoded(spark, sf)
    capped = FT.cap_vocabulary(enc.select("doc_id", "ids"), 200)
    return FT.decode_reviews(capped, index).select("doc_id", "text")


@query("union_partitions", W(f"WITH {O.REVIEWS}, src AS (SELECT doc_id, label FROM reviews), "
                             f"{O.split_ctes('src', 'sp', '2way')} SELECT doc_id, label, split FROM sp",
                             ["doc_id", "label", "split"]))
def q_union_partitions(spark, sf):
    s = P.stratified_split(TB.reviews(spark, sf).select("doc_id", "label"), fraction=0.1)
    return FT.union_partitions(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"))


@query("emissions_lookup", W(f"WITH {O.EMISSIONS} SELECT model, emissions FROM elookup", ["model", "emissions"],
                             {"emissions"}))
def q_emissions_lookup(spark, sf):
    return emissions(spark, sf)


@query("emissions_csv", SQL["emissions_lookup"])
def q_emissions_csv(spark, sf):
    """The log as CSV files in time order, read back: the last row in file order wins."""
    path = scratch_path(spark, "emissions-csv")
    log = TB.emission_log(spark, sf).orderBy("ts", "event_id").select("project_name", "emissions")
    K.write_csv(log, path)
    return EM.emissions_lookup(EM.read_emission_log(spark, path))


_PATHS_SQL = ("paths AS (SELECT event_id, 'outputs/' || CASE event_type WHEN 'click' THEN 'roberta-base' "
              "WHEN 'view' THEN 'distilbert-base-uncased' WHEN 'error' THEN 'albert-base-v2' ELSE event_type END AS model_dir, "
              "'outputs/' || CASE event_type WHEN 'click' THEN 'roberta-base' WHEN 'view' THEN 'distilbert-base-uncased' "
              "WHEN 'error' THEN 'albert-base-v2' ELSE event_type END || CASE WHEN user_id % 7 = 0 THEN '/logs' "
              "ELSE '/checkpoint-' || event_id::VARCHAR END AS path FROM events)")


def _paths(spark, sf):
    ev = TB.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    name = (F.when(F.col("event_type") == "click", "roberta-base").when(F.col("event_type") == "view", "distilbert-base-uncased")
             .when(F.col("event_type") == "error", "albert-base-v2").otherwise(F.col("event_type")))
    d = F.concat(F.lit("outputs/"), name)
    tail = F.when(F.col("user_id") % 7 == 0, F.lit("/logs")).otherwise(
        F.concat(F.lit("/checkpoint-"), F.col("event_id").cast("string")))
    return ev.select("event_id", d.alias("model_dir"), F.concat(d, tail).alias("path"))


@query("latest_checkpoint", W(f"WITH {_PATHS_SQL} SELECT model_dir, arg_max(path, "
                              "TRY_CAST(regexp_extract(path, 'checkpoint-(\\d+)$', 1) AS BIGINT)) AS latest_path, "
                              "max(TRY_CAST(regexp_extract(path, 'checkpoint-(\\d+)$', 1) AS BIGINT)) AS step FROM paths "
                              "WHERE regexp_matches(path, 'checkpoint-\\d+$') GROUP BY model_dir",
                              ["model_dir", "latest_path", "step"]))
def q_latest_checkpoint(spark, sf):
    return CK.latest_checkpoint(_paths(spark, sf))


@query("base_model_from_path", W(f"WITH {_PATHS_SQL} SELECT event_id, path, CASE "
                                 "WHEN contains(path, 'roberta-base') THEN 'roberta-base' "
                                 "WHEN contains(path, 'distilbert-base-uncased') THEN 'distilbert-base-uncased' "
                                 "WHEN contains(path, 'albert-base-v2') THEN 'albert-base-v2' ELSE 'roberta-base' END AS base_model "
                                 "FROM paths", ["event_id", "path", "base_model"]))
def q_base_model_from_path(spark, sf):
    return CK.base_model_from_path(_paths(spark, sf).select("event_id", "path"))


# ================================================================ preparation
@query("clean_text", W("SELECT conv_id, turn, coalesce(text::VARCHAR, '') AS text FROM conversations",
                       ["conv_id", "turn", "text"]))
def q_clean_text(spark, sf):
    return P.clean_text(TB.table(spark, sf, "conversations").select("conv_id", "turn", "text"))


@query("encode_labels", W("SELECT doc_id, lang AS label, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS label_idx "
                          "FROM documents", ["doc_id", "label", "label_idx"]))
def q_encode_labels(spark, sf):
    return P.encode_labels(TB.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label")))


@query("encode_labels_str", W("SELECT event_id, (user_id % 12)::VARCHAR AS label, "
                              "(dense_rank() OVER (ORDER BY (user_id % 12)::VARCHAR) - 1)::INT AS label_idx FROM events",
                              ["event_id", "label", "label_idx"]))
def q_encode_labels_str(spark, sf):
    ev = TB.table(spark, sf, "events").select("event_id", (F.col("user_id") % 12).alias("label"))
    return P.encode_labels(ev, mode="string").select("event_id", F.col("label").cast("string").alias("label"), "label_idx")


@query("cast_columns", W("SELECT doc_id, n_chars::INT AS n_chars, lang FROM documents", ["doc_id", "n_chars", "lang"]))
def q_cast_columns(spark, sf):
    return P.cast_columns(TB.table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), {"n_chars": "int"})


@query("sample_exact", W(f"WITH {O.REVIEWS}, n AS (SELECT round_even(0.25::DOUBLE * count(*), 0) AS k FROM reviews), "
                         "r AS (SELECT doc_id, label, row_number() OVER (ORDER BY md5(concat('42', ':', doc_id::VARCHAR)), doc_id) AS rn FROM reviews) "
                         "SELECT doc_id, label FROM r, n WHERE rn <= k", ["doc_id", "label"]))
def q_sample_exact(spark, sf):
    return P.sample_exact(TB.reviews(spark, sf).select("doc_id", "label"), 0.25)


def _split_sql(kind):
    return W(f"WITH {O.REVIEWS}, src AS (SELECT doc_id, label FROM reviews), {O.split_ctes('src', 'sp', kind)} "
             "SELECT doc_id, label, split FROM sp", ["doc_id", "label", "split"])


@query("stratified_split", _split_sql("2way"))
def q_stratified_split(spark, sf):
    return P.stratified_split(TB.reviews(spark, sf).select("doc_id", "label"), fraction=0.1)


@query("split_80_10_10", _split_sql("80_10_10"))
def q_split_80(spark, sf):
    return P.split_80_10_10(TB.reviews(spark, sf).select("doc_id", "label"))


@query("split_lstm", _split_sql("lstm"))
def q_split_lstm(spark, sf):
    return P.split_lstm(TB.reviews(spark, sf).select("doc_id", "label"))


@query("split_90_5_5", _split_sql("90_5_5"))
def q_split_90(spark, sf):
    return P.split_90_5_5(TB.reviews(spark, sf).select("doc_id", "label"))


@query("split_sizes", W(f"WITH {O.REVIEWS}, src AS (SELECT doc_id, label FROM reviews), "
                        f"{O.split_ctes('src', 'sp', '80_10_10')} SELECT split, count(*)::BIGINT AS n FROM sp GROUP BY split",
                        ["split", "n"]))
def q_split_sizes(spark, sf):
    return P.split_sizes(P.split_80_10_10(TB.reviews(spark, sf).select("doc_id", "label")))


@query("short_name", W(f"WITH {_PATHS_SQL} SELECT event_id, split_part(replace(model_dir, 'outputs/', ''), '-', 1) AS short "
                       "FROM paths", ["event_id", "short"]))
def q_short_name(spark, sf):
    p = _paths(spark, sf)
    return p.select("event_id", TX.short_name(F.replace(F.col("model_dir"), F.lit("outputs/"), F.lit(""))).alias("short"))


@query("safe_name", W("SELECT event_id, replace('org/' || event_type || '/base', '/', '_') AS safe FROM events",
                      ["event_id", "safe"]))
def q_safe_name(spark, sf):
    ev = TB.table(spark, sf, "events").select("event_id", "event_type")
    return ev.select("event_id", TX.safe_name(F.concat(F.lit("org/"), "event_type", F.lit("/base"))).alias("safe"))


@query("text_preview", W("SELECT conv_id, turn, substring(text, 1, 120) AS preview FROM conversations",
                         ["conv_id", "turn", "preview"]))
def q_text_preview(spark, sf):
    c = TB.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", TX.preview(F.col("text")).alias("preview"))


# ============================================================== text features
@query("lowercase_text", W("SELECT doc_id, lower(text) AS text FROM documents", ["doc_id", "text"]))
def q_lowercase(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", TX.lowercase(F.col("text")).alias("text"))


@query("normalise_text", W("SELECT doc_id, strip_accents(lower(text)) AS text FROM documents", ["doc_id", "text"]))
def q_normalise(spark, sf):
    return TB.table(spark, sf, "documents").select("doc_id", TX.normalise(F.col("text")).alias("text"))


@query("tokenize", W(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM "
                     f"(SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '{O.TOKEN_RE}', 1) AS t FROM documents)",
                     ["doc_id", "n_tokens", "tokens"]))
def q_tokenize(spark, sf):
    t = FT.tokens(TB.table(spark, sf, "documents"))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query("ngrams", W(f"SELECT doc_id, len(g)::BIGINT AS n_grams, array_to_string(g, '|') AS grams FROM (SELECT doc_id, "
                   "list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) "
                   f"ELSE [] END) AS g FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '{O.TOKEN_RE}', 1) AS t "
                   "FROM documents))", ["doc_id", "n_grams", "grams"]))
def q_ngrams(spark, sf):
    g = FT.with_ngrams(by_doc(TB.table(spark, sf, "documents").select("doc_id", "text")), ngram_max=2)
    return g.select("doc_id", F.size("_terms").cast("long").alias("n_grams"), F.array_join("_terms", "|").alias("grams"))


_TF = (f"WITH {O.REVIEWS}, src AS (SELECT doc_id, text, label FROM reviews), {O.split_ctes('src', 'sp', '80_10_10')}, "
       f"{O.tfidf_ctes('sp')} ")


@query("tfidf_vocabulary", W(_TF + "SELECT term, cnt AS count, df, idf, (row_number() OVER (ORDER BY term) - 1)::INT AS term_index "
                             "FROM vidf", ["term", "count", "df", "idf", "term_index"], {"idf"}))
def q_vocab(spark, sf):
    return prepared(spark, sf).vocab.select("term", "count", "df", "idf", "term_index")


@query("term_counts", W(_TF + "SELECT doc_id, term, tf FROM w", ["doc_id", "term", "tf"]))
def q_term_counts(spark, sf):
    p = prepared(spark, sf)
    terms = FT.doc_terms(p.split, keep=("doc_id",))
    return FT.term_counts(terms, p.vocab, p.max_features).select("doc_id", "term", "tf")


@query("tfidf_idf", W(_TF + "SELECT term, idf FROM vidf", ["term", "idf"], {"idf"}))
def q_idf(spark, sf):
    return prepared(spark, sf).vocab.select("term", "idf")


@query("tfidf", W(_TF + "SELECT doc_id, term, weight FROM w", ["doc_id", "term", "weight"], {"weight"}))
def q_tfidf(spark, sf):
    return prepared(spark, sf).weights.select("doc_id", "term", "weight")


_WORDS = (f"WITH {O.REVIEWS}, src AS (SELECT doc_id, text, label FROM reviews), {O.split_ctes('src', 'sp', '80_10_10')}, "
          f"sw AS (SELECT doc_id, split, list_filter(string_split(translate(lower(text), {O.SEQ_FILTERS_SQL}, repeat(' ', 34)), ' '), "
          "lambda x: x <> '') AS ws FROM sp), "
          "wc AS (SELECT word, count(*)::BIGINT AS cnt FROM (SELECT unnest(ws) AS word FROM sw WHERE split = 'train') GROUP BY word), "
          "wi AS (SELECT '<OOV>' AS word, 1::BIGINT AS id, 0::BIGINT AS cnt UNION ALL "
          "SELECT word, (row_number() OVER (ORDER BY cnt DESC, word ASC) + 1)::BIGINT AS id, cnt FROM wc)")


def _ids_sql(num_words, pad=None, mask=False, dynamic=False):
    idexpr = f"CASE WHEN wi.id IS NULL OR wi.id >= {num_words} THEN 1 ELSE wi.id END" if num_words else \
        "coalesce(wi.id, 1)"
    seq = (f"x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM sw), "
           f"j AS (SELECT x.doc_id, list({idexpr}::INT ORDER BY x.pos) AS ids FROM x LEFT JOIN wi ON x.word = wi.word GROUP BY x.doc_id), "
           "s AS (SELECT sw.doc_id, sw.split, coalesce(j.ids, []::INT[]) AS ids FROM sw LEFT JOIN j ON sw.doc_id = j.doc_id)")
    return seq


def _pad_sql(length_expr):
    return (f"(CASE WHEN len(ids) >= {length_expr} THEN ids[1:{length_expr}] "
            f"ELSE list_concat(ids, list_transform(range(len(ids), {length_expr}), lambda i: 0)) END)")


@query("word_index", W(_WORDS + " SELECT word, id, cnt AS count FROM wi", ["word", "id", "count"]))
def q_word_index(spark, sf):
    split = prepared_split(spark, sf)
    return FT.fit_word_index(split.where(F.col("split") == "train")).select("word", "id", "count")


def _seq(spark, sf, num_words=20000):
    split = prepared_split(spark, sf)
    index = FT.fit_word_index(split.where(F.col("split") == "train"))
    return FT.text_to_ids(split.select("doc_id", "split", "text"), index, num_words)


@query("text_to_ids", W(_WORDS + ", " + _ids_sql(20000) + " SELECT doc_id, array_to_string(ids, ' ') AS ids FROM s",
                        ["doc_id", "ids"]))
def q_text_to_ids(spark, sf):
    return _seq(spark, sf).select("doc_id", F.array_join("ids", " ").alias("ids"))


@query("pad_sequences", W(_WORDS + ", " + _ids_sql(20000) + f" SELECT doc_id, array_to_string({_pad_sql(128)}, ' ') AS ids FROM s",
                          ["doc_id", "ids"]))
def q_pad(spark, sf):
    return FT.pad_sequences(_seq(spark, sf), 128).select("doc_id", F.array_join("ids", " ").alias("ids"))


@query("vocab_size", W(_WORDS + " SELECT (count(*) + 1)::BIGINT AS vocab_size FROM wi", ["vocab_size"]))
def q_vocab_size(spark, sf):
    split = prepared_split(spark, sf)
    return FT.vocab_size(FT.fit_word_index(split.where(F.col("split") == "train")), 0)


def _mask_sql(length_expr):
    return f"list_transform(range(1, {length_expr} + 1), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END)"


@query("encode_fixed", W(_WORDS + ", " + _ids_sql(20000) + f" SELECT doc_id, array_to_string({_pad_sql(256)}, ' ') AS input_ids, "
                         f"array_to_string({_mask_sql(256)}, ' ') AS attention_mask FROM s",
                         ["doc_id", "input_ids", "attention_mask"]))
def q_encode_fixed(spark, sf):
    e = FT.encode_fixed(_seq(spark, sf), 256)
    return e.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                    F.array_join("attention_mask", " ").alias("attention_mask"))


@query("encode_dynamic", W(_WORDS + ", " + _ids_sql(20000) + ", t AS (SELECT * FROM s), "
                           "L AS (SELECT least(max(len(ids)), 256) AS l FROM t) "
                           f"SELECT doc_id, array_to_string({_pad_sql('l')}, ' ') AS input_ids, "
                           f"array_to_string({_mask_sql('l')}, ' ') AS attention_mask FROM t, L",
                           ["doc_id", "input_ids", "attention_mask"]))
def q_encode_dynamic(spark, sf):
    e = FT.encode_dynamic(_seq(spark, sf))
    return e.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                    F.array_join("attention_mask", " ").alias("attention_mask"))


@query("encode_udf", W("SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)), ' ') AS ids "
                       "FROM documents", ["doc_id", "ids"]))
def q_encode_udf(spark, sf):
    ship_package(spark)
    enc = SC.encode_udf(SC.word_length_tokenizer)
    d = TB.table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(enc(F.col("text")), " ").alias("ids"))


# ============================================================== classifiers
@query("class_weights", W(f"WITH {O.REVIEWS}, src AS (SELECT doc_id, label FROM reviews), {O.split_ctes('src', 'sp', '80_10_10')}, "
                          "c AS (SELECT label, count(*)::BIGINT AS n_c FROM sp WHERE split = 'train' GROUP BY label) "
                          "SELECT label, n_c, (sum(n_c) OVER ())::DOUBLE / (count(*) OVER () * n_c) AS weight FROM c",
                          ["label", "n_c", "weight"], {"weight"}))
def q_class_weights(spark, sf):
    split = prepared_split(spark, sf)
    return C.class_weights(split.where(F.col("split") == "train"))


@query("clf_nb", W(_TF + ", " + O.nb_ctes("sp", "'val', 'test'") + " SELECT doc_id, split, y_true, y_pred, prob FROM nbpred",
                   ["doc_id", "split", "y_true", "y_pred", "prob"], {"prob"}))
def q_clf_nb(spark, sf):
    return nb_scores(prepared(spark, sf), ("val", "test")).select("doc_id", "split", "y_true", "y_pred", "prob")


@query("classification_report", W(_TF + ", " + O.nb_ctes("sp", "'test'") + ", sc AS (SELECT 'nb' AS model, y_true, y_pred FROM nbpred), "
                                  + O.cells_ctes("sc", "model", "rp") + " " + O.report_select("rp", "model"),
                                  ["model", "label", "precision", "recall", "f1", "support"],
                                  {"precision", "recall", "f1", "support"}))
def q_report(spark, sf):
    return M.classification_report(nb_scores(prepared(spark, sf), ("test",)), ("model",))


@query("report_csv", SQL["classification_report"])
def q_report_csv(spark, sf):
    """K2: the report written as CSV and read back."""
    path = scratch_path(spark, "report-csv")
    report = q_report(spark, sf)
    K.write_csv(report, path)
    return spark.read.schema(report.schema).csv(path, header=True, escape='"')


_TF_LANG = (f"WITH src AS (SELECT doc_id, text, lang AS label FROM documents), {O.split_ctes('src', 'sp', '80_10_10')}, "
            f"{O.tfidf_ctes('sp')} ")


@query("classification_report_lang", W(_TF_LANG + ", " + O.nb_ctes("sp", "'test'").replace(
    "r.label::INT AS y_true, r.class::INT AS y_pred", "r.label AS y_true, r.class AS y_pred") +
    ", sc AS (SELECT 'nb' AS model, y_true, y_pred FROM nbpred), " + O.cells_ctes("sc", "model", "rp") + " " +
    O.report_select("rp", "model"), ["model", "label", "precision", "recall", "f1", "support"],
    {"precision", "recall", "f1", "support"}))
def q_report_lang(spark, sf):
    p = prepared(spark, sf, "lang")
    train_w = p.weights.where(F.col("split") == "train")
    train_docs = p.split.where(F.col("split") == "train").select("doc_id", "label")
    lp, prior = C.fit_naive_bayes(train_w, train_docs, p.vocab, p.classes)
    docs = p.split.where(F.col("split") == "test").select("doc_id", "label", "split")
    pred = C.predict_naive_bayes(p.weights.where(F.col("split") == "test"), docs, lp, prior, p.classes,
                                 p.max_features, keep=("doc_id", "label", "split"))
    sc = pred.select(F.lit("nb").alias("model"), F.col("label").alias("y_true"), "y_pred")
    return M.classification_report(sc, ("model",))


# ------------------------------------------------- history (C7, C8, M9)
@query("early_stopping", W(f"WITH {O.HISTORY}, "
                           "a AS (SELECT *, max(val_accuracy) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hist), "
                           "b AS (SELECT *, CASE WHEN prev IS NULL OR val_accuracy > prev THEN epoch END AS imp FROM a), "
                           "c AS (SELECT *, epoch - max(imp) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wait FROM b), "
                           "s AS (SELECT run, min(CASE WHEN wait >= 2 THEN epoch END) AS stopped_epoch, max(epoch) AS last_epoch FROM c GROUP BY run) "
                           "SELECT c.run, max(imp)::INT AS best_epoch, max(val_accuracy) AS best_value, s.stopped_epoch::INT AS stopped_epoch, "
                           "coalesce(s.stopped_epoch, s.last_epoch)::INT AS epochs_run FROM c JOIN s ON c.run = s.run "
                           "WHERE s.stopped_epoch IS NULL OR c.epoch <= s.stopped_epoch GROUP BY c.run, s.stopped_epoch, s.last_epoch",
                           ["run", "best_epoch", "best_value", "stopped_epoch", "epochs_run"], {"best_value"}))
def q_early_stopping(spark, sf):
    return H.early_stopping(TB.history(spark, sf))


@query("best_checkpoint", W(f"WITH {O.HISTORY} SELECT run, epoch::INT AS best_epoch, val_accuracy AS best_value FROM "
                            "(SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_accuracy DESC, epoch ASC) AS rk FROM hist) WHERE rk = 1",
                            ["run", "best_epoch", "best_value"], {"best_value"}))
def q_best_checkpoint(spark, sf):
    return H.best_checkpoint(TB.history(spark, sf))


@query("learning_curves", W(f"WITH {O.HISTORY} UNPIVOT hist ON accuracy, val_accuracy, loss, val_loss INTO NAME curve VALUE value",
                            ["run", "epoch", "curve", "value"], {"value"}))
def q_learning_curves(spark, sf):
    return M.learning_curves(TB.history(spark, sf))


# ----------------------------------------------------- scoring (C9-C12)
def _fixed_weights(d=64, k=2):
    i = np.arange(d, dtype=np.float64)
    return np.stack([np.sin(i + 1.0) / 8.0, np.cos(i + 1.0) / 8.0], axis=1)[:, :k]


def _weights_sql(col):
    w = _fixed_weights()
    return "[" + ", ".join(repr(float(x)) for x in w[:, col]) + "]::DOUBLE[]"


_LOGITS_SQL = (f"lg AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], {_weights_sql(0)}) AS l0, "
               f"list_dot_product(embedding::DOUBLE[], {_weights_sql(1)}) AS l1 FROM embeddings)")


@query("score_batch", W(f"WITH {_LOGITS_SQL} SELECT vec_id, l0 AS logit0, l1 AS logit1 FROM lg",
                        ["vec_id", "logit0", "logit1"], {"logit0", "logit1"}))
def q_score_batch(spark, sf):
    ship_package(spark)
    udf = SC.batch_logits_udf(SC.linear_model_fn(_fixed_weights()), 2, batch_size=16, input_dim=64)
    emb = TB.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = emb.withColumn("logits", udf("x"))
    return out.select("vec_id", F.col("logits")[0].alias("logit0"), F.col("logits")[1].alias("logit1"))


@query("softmax_prob", W(f"WITH {_LOGITS_SQL} SELECT vec_id, exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + "
                         "exp(l1 - greatest(l0, l1))) AS prob, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS y_pred FROM lg",
                         ["vec_id", "prob", "y_pred"], {"prob"}))
def q_softmax(spark, sf):
    w = _fixed_weights()
    emb = TB.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    def dot(col):
        ws = F.array(*[F.lit(float(v)) for v in w[:, col]])
        return F.aggregate(F.zip_with("x", ws, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    lg = emb.select("vec_id", F.array(dot(0), dot(1)).alias("logits"))
    return SC.score_logits(lg).select("vec_id", "prob", "y_pred")


def _class_weights(k: int, d: int = 64) -> list[float]:
    """Fixed weights of logit k over all d components."""
    return [float(x) for x in np.sin((np.arange(d, dtype=np.float64) + 1.0) * (k + 1)) / 8.0]


@query("argmax_class", W("SELECT vec_id, label, (list_position(l, list_max(l)) - 1)::INT AS y_pred FROM (SELECT vec_id, label, ["
                         + ", ".join(f"list_dot_product(embedding::DOUBLE[], {_class_weights(k)}::DOUBLE[])" for k in range(10))
                         + "] AS l FROM embeddings)", ["vec_id", "label", "y_pred"]))
def q_argmax(spark, sf):
    """Ten logits over all components of the vector, then the largest."""
    emb = TB.table(spark, sf, "embeddings").withColumn("_x", F.col("embedding").cast("array<double>"))

    def logit(k):
        ws = F.array(*[F.lit(v) for v in _class_weights(k)])
        return F.aggregate(F.zip_with("_x", ws, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    return emb.select("vec_id", "label", argmax(F.array(*[logit(k) for k in range(10)])).alias("y_pred"))


_CONV_SQL = (_TF + ", " + O.nb_ctes("sp", "'test'") + ", "
             f"ctok AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, text, regexp_extract_all(strip_accents(lower(text)), '{O.TOKEN_RE}', 1) AS t FROM conversations), "
             "cg AS (SELECT doc_id, list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END) AS g FROM ctok), "
             "cdt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM cg) GROUP BY ALL), "
             "cw0 AS (SELECT doc_id, term, tf * idf AS w FROM cdt JOIN vidf USING (term)), "
             "cw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM cw0), "
             "csums AS (SELECT doc_id, class, sum(weight * flp) AS s FROM cw JOIN flp USING (term) GROUP BY ALL), "
             "cgrid AS (SELECT c.doc_id, c.conv_id, c.turn, c.text, k.class FROM ctok c CROSS JOIN classes k), "
             "cscored AS (SELECT g.*, p.prior + coalesce(x.s, 0.0) AS score FROM cgrid g JOIN prior p ON p.class = g.class "
             "LEFT JOIN csums x ON x.doc_id = g.doc_id AND x.class = g.class), "
             "cl AS (SELECT doc_id, max(score) AS m, max(CASE WHEN class = 1 THEN score END) AS s1 FROM cscored GROUP BY doc_id), "
             "cl2 AS (SELECT c.doc_id, l.m + ln(sum(exp(c.score - l.m))) AS lse, max(l.s1) AS s1 FROM cscored c JOIN cl l USING (doc_id) GROUP BY c.doc_id, l.m), "
             "cp AS (SELECT DISTINCT c.doc_id, c.conv_id, c.turn, c.text, exp(l.s1 - l.lse) AS prob FROM cgrid c JOIN cl2 l USING (doc_id)) "
             "SELECT conv_id, turn, CASE WHEN prob >= 0.5 THEN 'pos' ELSE 'neg' END AS sentiment, prob, substring(text, 1, 120) AS preview FROM cp")


@query("score_texts", W(_CONV_SQL, ["conv_id", "turn", "sentiment", "prob", "preview"], {"prob"}))
def q_score_texts(spark, sf):
    """Conversation turns scored by the naive Bayes model fitted on reviews."""
    p = prepared(spark, sf)
    raw = TB.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    # one document per turn: conv_id * (largest turn + 1) + turn is unique for
    # any number of turns (one scalar aggregate)
    width = int(raw.agg(F.max("turn")).first()[0] or 0) + 1
    conv = raw.select((F.col("conv_id") * F.lit(width) + F.col("turn")).alias("doc_id"), "conv_id", "turn", "text")
    conv = by_doc(conv)
    terms = FT.doc_terms(conv, keep=("doc_id",))
    w = FT.tfidf(terms, p.vocab, p.max_features)
    train_w = p.weights.where(F.col("split") == "train")
    train_docs = p.split.where(F.col("split") == "train").select("doc_id", "label")
    lp, prior = C.fit_naive_bayes(train_w, train_docs, p.vocab, p.classes)
    pred = C.predict_naive_bayes(w, conv.select("doc_id", "conv_id", "turn", "text"), lp, prior, p.classes,
                                 p.max_features, keep=("doc_id", "conv_id", "turn", "text"))
    return SC.label_texts(pred).select("conv_id", "turn", "sentiment", "prob", "preview")


# ============================================================== metrics
_S = f"WITH {SC_CTE}, "


@query("accuracy", W(_S + "x AS (SELECT 1) SELECT model, split, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy, "
                     "count(*)::BIGINT AS n FROM scores GROUP BY model, split", ["model", "split", "accuracy", "n"], {"accuracy"}))
def q_accuracy(spark, sf):
    return M.accuracy(scores(spark, sf))


@query("prf_by_class", W(_S + O.cells_ctes("scores", "model, split", "m") + " SELECT model, split, class, precision, recall, f1, support FROM m_prf",
                         ["model", "split", "class", "precision", "recall", "f1", "support"], {"precision", "recall", "f1"}))
def q_prf(spark, sf):
    return M.prf_by_class(scores(spark, sf))


@query("macro_prf", W(_S + O.cells_ctes("scores", "model, split", "m") + " SELECT model, split, precision, recall, f1 FROM m_macro",
                      ["model", "split", "precision", "recall", "f1"], {"precision", "recall", "f1"}))
def q_macro(spark, sf):
    return M.macro_prf(scores(spark, sf))


@query("confusion_matrix", W(_S + "c AS (SELECT model, split, y_true, y_pred, count(*) AS n FROM scores GROUP BY ALL), "
                             "lab AS (SELECT DISTINCT model, split, v FROM (SELECT model, split, y_true AS v FROM c UNION ALL SELECT model, split, y_pred FROM c)) "
                             "SELECT a.model, a.split, a.v AS y_true, b.v AS y_pred, coalesce(c.n, 0)::BIGINT AS n FROM lab a "
                             "JOIN lab b ON a.model = b.model AND a.split = b.split LEFT JOIN c ON c.model = a.model AND c.split = a.split "
                             "AND c.y_true = a.v AND c.y_pred = b.v", ["model", "split", "y_true", "y_pred", "n"]))
def q_confusion(spark, sf):
    return M.confusion_matrix(scores(spark, sf))


@query("log_loss", W(_S + "x AS (SELECT 1) SELECT model, split, avg(-(y_true * ln(least(greatest(prob, 1e-7), 1 - 1e-7)) + "
                     "(1 - y_true) * ln(1 - least(greatest(prob, 1e-7), 1 - 1e-7)))) AS loss FROM scores GROUP BY model, split",
                     ["model", "split", "loss"], {"loss"}))
def q_log_loss(spark, sf):
    return M.log_loss(scores(spark, sf))


@query("metrics_by_split", W(_S + "v AS (SELECT * FROM scores WHERE split IN ('val', 'test')), " + O.cells_ctes("v", "model, split", "m") +
                             " SELECT a.model, a.split, a.accuracy, a.n, b.precision, b.recall, b.f1 FROM m_acc a JOIN m_macro b "
                             "ON a.model = b.model AND a.split = b.split",
                             ["model", "split", "accuracy", "n", "precision", "recall", "f1"], {"accuracy", "precision", "recall", "f1"}))
def q_metrics_by_split(spark, sf):
    return M.metrics_by_split(scores(spark, sf))


@query("run_summary_json", W(_S + O.cells_ctes("scores", "model, split", "m") + ", ms AS (SELECT a.model, a.split, a.accuracy, a.n, "
                             "b.f1, b.precision, b.recall FROM m_acc a JOIN m_macro b ON a.model = b.model AND a.split = b.split) "
                             "SELECT model, max(CASE WHEN split = 'val' THEN accuracy END) AS val_accuracy, "
                             "max(CASE WHEN split = 'val' THEN f1 END) AS val_f1, max(CASE WHEN split = 'test' THEN accuracy END) AS test_accuracy, "
                             "max(CASE WHEN split = 'test' THEN f1 END) AS test_f1, max(CASE WHEN split = 'train' THEN n END)::BIGINT AS n_train, "
                             "max(CASE WHEN split = 'val' THEN n END)::BIGINT AS n_val, max(CASE WHEN split = 'test' THEN n END)::BIGINT AS n_test, "
                             "50000 AS max_features, 2 AS ngram_max FROM ms GROUP BY model",
                             ["model", "val_accuracy", "val_f1", "test_accuracy", "test_f1", "n_train", "n_val", "n_test",
                              "max_features", "ngram_max"], {"val_accuracy", "val_f1", "test_accuracy", "test_f1"}))
def q_run_summary(spark, sf):
    ms = M.summary_metrics(scores(spark, sf), ("model", "split"))
    s = K.run_summary(ms, None, {"max_features": 50000, "ngram_max": 2})
    return s.select("model", F.col("val.accuracy").alias("val_accuracy"), F.col("val.f1").alias("val_f1"),
                    F.col("test.accuracy").alias("test_accuracy"), F.col("test.f1").alias("test_f1"),
                    "n_train", "n_val", "n_test", F.col("params.max_features").alias("max_features"),
                    F.col("params.ngram_max").alias("ngram_max"))


_FIELDS = ("accuracy", "f1", "precision", "recall")


@query("run_summary_document", _S + O.cells_ctes("scores", "model, split", "m") + ", ms AS (SELECT a.model, a.split, a.n, "
       "round(a.accuracy, 6) AS accuracy, round(b.f1, 6) AS f1, round(b.precision, 6) AS precision, round(b.recall, 6) AS recall "
       "FROM m_acc a JOIN m_macro b ON a.model = b.model AND a.split = b.split), "
       "s AS (SELECT model, " + ", ".join(f"max(CASE WHEN split = '{x}' THEN {c} END) AS {x}_{c}" for x in ("val", "test") for c in _FIELDS)
       + ", " + ", ".join(f"max(CASE WHEN split = '{x}' THEN n END) AS n_{x}" for x in ("train", "val", "test")) + " FROM ms GROUP BY model) "
       "SELECT model, json_object('model', model, " + ", ".join(f"'{x}', json_object(" + ", ".join(f"'{c}', {x}_{c}" for c in _FIELDS) + ")" for x in ("val", "test"))
       + ", 'n_train', n_train, 'n_val', n_val, 'n_test', n_test, 'label_map', json_object('neg', 0, 'pos', 1), "
       "'params', json_object('max_features', 50000, 'ngram_max', 2))::VARCHAR AS json FROM s")
def q_run_summary_document(spark, sf):
    """K3: one JSON document per model."""
    ms = M.summary_metrics(scores(spark, sf), ("model", "split"))
    rounded = ms.select("model", "split", "n", *[F.round(c, 6).alias(c) for c in _FIELDS])
    return K.summary_json(K.run_summary(rounded, {"neg": 0, "pos": 1}, {"max_features": 50000, "ngram_max": 2}))


@query("label_mapping", W("SELECT lang AS label, (dense_rank() OVER (ORDER BY lang) - 1)::INT AS label_idx FROM "
                          "(SELECT DISTINCT lang FROM documents)", ["label", "label_idx"]))
def q_label_mapping(spark, sf):
    d = TB.table(spark, sf, "documents").select(F.col("lang").alias("label"))
    return P.label_classes(d, "label").select("label", F.col("_class_idx").alias("label_idx"))


@query("label_mapping_json", "SELECT '{\"classes_\":[\"' || string_agg(lang, '\",\"' ORDER BY lang) || '\"]}' AS json FROM "
                             "(SELECT DISTINCT lang FROM documents)")
def q_label_mapping_json(spark, sf):
    return K.label_mapping_json(q_label_mapping(spark, sf))


_EPOCH_VALUES = "(VALUES (1), (2), (3)) AS e(epoch)"


def _epoch_scores(spark, sf):
    s = scores(spark, sf).where(F.col("split") == "val")
    s = s.withColumn("epoch", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    h = TB.unit_hash(F.col("doc_id").cast("string"), F.lit(":"), F.col("model"), F.lit(":"), F.col("epoch").cast("string"))
    p = F.lit(0.65) * h + F.lit(0.35) * F.col("y_true").cast("double")
    return s.select(F.col("model").alias("run"), "epoch", "doc_id", "y_true",
                    F.when(p > 0.5, 1).otherwise(0).cast("int").alias("y_pred"))


@query("metrics_by_epoch", W(_S + f"es AS (SELECT model AS run, e.epoch, doc_id, y_true, (CASE WHEN 0.65::DOUBLE * "
                             "((('0x' || substr(md5(concat(doc_id::VARCHAR, ':', model, ':', e.epoch::VARCHAR)), 1, 8))::BIGINT)::DOUBLE / 4294967296.0) "
                             f"+ 0.35::DOUBLE * y_true::DOUBLE > 0.5 THEN 1 ELSE 0 END)::INT AS y_pred FROM scores, {_EPOCH_VALUES} WHERE split = 'val'), "
                             + O.cells_ctes("es", "run, epoch", "m") + " SELECT a.run, a.epoch, a.accuracy, a.n, b.precision, b.recall, b.f1 "
                             "FROM m_acc a JOIN m_macro b ON a.run = b.run AND a.epoch = b.epoch",
                             ["run", "epoch", "accuracy", "n", "precision", "recall", "f1"], {"accuracy", "precision", "recall", "f1"}))
def q_metrics_by_epoch(spark, sf):
    return M.metrics_by_epoch(_epoch_scores(spark, sf))


@query("custom_metric", W(_S + "x AS (SELECT 1) SELECT model, split, avg(y_pred::DOUBLE) AS pos_rate, avg(prob) AS mean_prob, "
                          "count(*)::BIGINT AS n FROM scores GROUP BY model, split",
                          ["model", "split", "pos_rate", "mean_prob", "n"], {"pos_rate", "mean_prob"}))
def q_custom_metric(spark, sf):
    return M.custom_metric(scores(spark, sf), ("model", "split"), {
        "pos_rate": F.avg(F.col("y_pred").cast("double")), "mean_prob": F.avg("prob"),
        "n": F.count(F.lit(1)).cast("long")})


# ============================================================== ensembles
def _f1_sql(split, models):
    ml = ", ".join(f"'{m}'" for m in models)
    return (f"wsrc AS (SELECT * FROM scores WHERE split = '{split}' AND model IN ({ml})), "
            + O.cells_ctes("wsrc", "model", "wt") + ", wts AS (SELECT model, f1 FROM wt_macro)")


def _vote_sql(models, weight_split, split, op):
    ml = ", ".join(f"'{m}'" for m in models)
    order = "CASE s.model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(models)) + " END"
    return (_S + _f1_sql(weight_split, models) +
            f", v AS (SELECT s.split, s.doc_id, arg_min(s.y_true, {order}) AS y_true, sum(w.f1 * s.prob) / sum(w.f1) AS prob "
            f"FROM scores s JOIN wts w ON s.model = w.model WHERE s.split = '{split}' AND s.model IN ({ml}) GROUP BY s.split, s.doc_id) "
            f"SELECT split, doc_id, y_true, prob, (CASE WHEN prob {op} 0.5 THEN 1 ELSE 0 END)::INT AS y_pred FROM v")


_VCOLS = ["split", "doc_id", "y_true", "prob", "y_pred"]


@query("soft_vote_pair", W(_vote_sql(PAIR, "test", "test", ">="), _VCOLS, {"prob"}))
def q_soft_vote_pair(spark, sf):
    return E.soft_vote_pair(scores(spark, sf), *PAIR).select(*_VCOLS)


@query("soft_vote_mean", W(_S + "v AS (SELECT split, doc_id, arg_min(y_true, model) AS y_true, avg(prob) AS prob FROM scores "
                           "WHERE split = 'test' GROUP BY split, doc_id) SELECT split, doc_id, y_true, prob, "
                           "(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END)::INT AS y_pred, CASE WHEN prob >= 0.5 THEN 'pos' ELSE 'neg' END AS sentiment FROM v",
                           _VCOLS + ["sentiment"], {"prob"}))
def q_soft_vote_mean(spark, sf):
    return E.soft_vote_mean(scores(spark, sf)).select(*_VCOLS, "sentiment")


@query("weighted_vote_val", W(_vote_sql(MODELS, "val", "test", ">"), _VCOLS, {"prob"}))
def q_weighted_vote_val(spark, sf):
    return E.weighted_vote_val(scores(spark, sf), MODELS).select(*_VCOLS)


@query("weighted_vote_f1", W(_vote_sql(MODELS, "test", "test", ">="), _VCOLS, {"prob"}))
def q_weighted_vote_f1(spark, sf):
    return E.weighted_vote_f1(scores(spark, sf), MODELS).select(*_VCOLS)


def _majority_sql(models, kind):
    ml = ", ".join(f"'{m}'" for m in models)
    order = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(models)) + " END"
    if kind == "mode":
        return (_S + f"c AS (SELECT split, doc_id, y_pred, count(*) AS k FROM scores WHERE split = 'test' AND model IN ({ml}) GROUP BY ALL), "
                "m AS (SELECT split, doc_id, y_pred FROM (SELECT *, row_number() OVER (PARTITION BY split, doc_id ORDER BY k DESC, y_pred ASC) AS rk FROM c) WHERE rk = 1), "
                f"t AS (SELECT split, doc_id, arg_min(y_true, {order}) AS y_true FROM scores WHERE split = 'test' AND model IN ({ml}) GROUP BY ALL) "
                "SELECT t.split, t.doc_id, t.y_true, m.y_pred::INT AS y_pred FROM t JOIN m ON t.doc_id = m.doc_id AND t.split = m.split")
    return (_S + f"v AS (SELECT split, doc_id, arg_min(y_true, {order}) AS y_true, avg(y_pred) AS vote FROM scores "
            f"WHERE split = 'test' AND model IN ({ml}) GROUP BY ALL) "
            "SELECT split, doc_id, y_true, (CASE WHEN vote >= 0.5 THEN 1 ELSE 0 END)::INT AS y_pred FROM v")


_MCOLS = ["split", "doc_id", "y_true", "y_pred"]


@query("majority_mode", W(_majority_sql(PAIR, "mode"), _MCOLS))
def q_majority_mode(spark, sf):
    return E.majority_mode(scores(spark, sf), models=PAIR).select(*_MCOLS)


@query("majority_mean", W(_majority_sql(PAIR, "mean"), _MCOLS))
def q_majority_mean(spark, sf):
    return E.majority_mean(scores(spark, sf), models=PAIR).select(*_MCOLS)


@query("majority_mode_trio", W(_majority_sql(MODELS, "mode"), _MCOLS))
def q_majority_mode3(spark, sf):
    return E.majority_mode(scores(spark, sf), models=MODELS).select(*_MCOLS)


def _meta_sql(conf):
    p = ", ".join(f"max(CASE WHEN model = '{m}' THEN prob END) AS p_{m}" for m in MODELS)
    body = (_S + f"b AS (SELECT split, doc_id, arg_min(y_true, model) AS y_true, {p} FROM scores GROUP BY split, doc_id) SELECT split, doc_id, y_true, "
            + ", ".join(f"p_{m}" for m in MODELS))
    if conf:
        body += ", " + ", ".join(f"abs(p_{m} - 0.5) AS conf_{m}" for m in MODELS)
        body += ", " + ", ".join(f"-(p_{m} * ln(p_{m} + 1e-9) + (1 - p_{m}) * ln(1 - p_{m} + 1e-9)) AS ent_{m}" for m in MODELS)
    return body + " FROM b"


_META = E.meta_feature_names(MODELS)


@query("meta_features", W(_meta_sql(True), ["split", "doc_id", "y_true", *_META], set(_META)))
def q_meta(spark, sf):
    return E.meta_features(scores(spark, sf), MODELS)


@query("prob_matrix", W(_meta_sql(False), ["split", "doc_id", "y_true", *[f"p_{m}" for m in MODELS]],
                        {f"p_{m}" for m in MODELS}))
def q_prob_matrix(spark, sf):
    return E.prob_matrix(scores(spark, sf), MODELS)


@query("alignment_check", W(_S + "x AS (SELECT 1) SELECT split, doc_id, count(DISTINCT y_true)::BIGINT AS n_labels, "
                            "count(DISTINCT model)::BIGINT AS n_models, CASE WHEN count(DISTINCT y_true) > 1 OR count(DISTINCT model) < 3 "
                            "THEN 0 ELSE 1 END AS aligned FROM scores GROUP BY split, doc_id",
                            ["split", "doc_id", "n_labels", "n_models", "aligned"]))
def q_alignment(spark, sf):
    return E.alignment_check(scores(spark, sf), n_models=3)


@query("vote_weights", W(_S + _f1_sql("val", MODELS) + " SELECT model, f1, f1 / sum(f1) OVER () AS weight FROM wts",
                         ["model", "f1", "weight"], {"f1", "weight"}))
def q_vote_weights(spark, sf):
    return E.vote_weights(scores(spark, sf), "val", MODELS)


_GRID_SQL = (_S + _f1_sql("test", MODELS) + f", ms AS (SELECT * FROM (VALUES {MS_VALUES}) AS t(ensemble, model)), "
             "v AS (SELECT m.ensemble, s.split, s.doc_id, arg_min(s.y_true, s.model) AS y_true, avg(s.y_pred) AS majority, "
             "sum(w.f1 * s.prob) / sum(w.f1) AS weighted FROM scores s JOIN ms m ON s.model = m.model JOIN wts w ON w.model = s.model "
             "WHERE s.split = 'test' GROUP BY ALL), "
             "vv AS (SELECT ensemble, 'majority' AS method, doc_id, y_true, (CASE WHEN majority >= 0.5 THEN 1 ELSE 0 END) AS y_pred FROM v "
             "UNION ALL SELECT ensemble, 'weighted', doc_id, y_true, (CASE WHEN weighted >= 0.5 THEN 1 ELSE 0 END) FROM v), "
             + O.cells_ctes("vv", "ensemble, method", "g") +
             ", grid AS (SELECT a.ensemble, a.method, a.accuracy AS acc, b.f1, b.precision, b.recall FROM g_acc a JOIN g_macro b "
             "ON a.ensemble = b.ensemble AND a.method = b.method), "
             + O.EMISSIONS + ", mem AS (SELECT m.ensemble, coalesce(e.emissions, 0.0) AS emissions FROM ms m LEFT JOIN elookup e ON e.model = lower(m.model)), "
             "ee AS (SELECT ensemble, sum(emissions) AS emissions FROM mem GROUP BY ensemble) ")


@query("ensemble_grid", W(_GRID_SQL + "SELECT g.*, ee.emissions, CASE WHEN ee.emissions > 0 THEN g.acc / ee.emissions ELSE 0.0 END AS efficiency "
                          "FROM grid g JOIN ee ON g.ensemble = ee.ensemble",
                          ["ensemble", "method", "acc", "f1", "precision", "recall", "emissions", "efficiency"],
                          {"acc", "f1", "precision", "recall", "emissions", "efficiency"}))
def q_ensemble_grid(spark, sf):
    ms = member_sets(spark)
    grid = E.ensemble_grid(scores(spark, sf), ms)
    ee = L.ensemble_emissions(ms, emissions(spark, sf))
    return L.efficiency(grid.join(ee, "ensemble"))


@query("model_emissions", W(f"WITH {O.EMISSIONS}, m AS (SELECT * FROM (VALUES ('m0'), ('m1'), ('m2'), ('M3'), ('m9')) AS t(model)) "
                            "SELECT m.model, coalesce(e.emissions, 0.0) AS emissions FROM m LEFT JOIN elookup e ON e.model = lower(m.model)",
                            ["model", "emissions"], {"emissions"}))
def q_model_emissions(spark, sf):
    models = spark.createDataFrame([("m0",), ("m1",), ("m2",), ("M3",), ("m9",)], "model string")
    return EM.model_emissions(models, emissions(spark, sf))


@query("ensemble_emissions", W(_GRID_SQL + "SELECT ensemble, emissions FROM ee", ["ensemble", "emissions"], {"emissions"}))
def q_ensemble_emissions(spark, sf):
    return L.ensemble_emissions(member_sets(spark), emissions(spark, sf))


@query("efficiency", W(_GRID_SQL + "SELECT g.ensemble, g.method, g.acc, ee.emissions, CASE WHEN ee.emissions > 0 THEN g.acc / ee.emissions "
                       "ELSE 0.0 END AS efficiency FROM grid g JOIN ee ON g.ensemble = ee.ensemble",
                       ["ensemble", "method", "acc", "emissions", "efficiency"], {"acc", "emissions", "efficiency"}))
def q_efficiency(spark, sf):
    ms = member_sets(spark)
    grid = E.ensemble_grid(scores(spark, sf), ms)
    return L.efficiency(grid.join(L.ensemble_emissions(ms, emissions(spark, sf)), "ensemble")).select(
        "ensemble", "method", "acc", "emissions", "efficiency")


@query("tradeoff_ensembles", W(_GRID_SQL + "SELECT g.ensemble || ' (' || g.method || ')' AS label, ee.emissions, g.acc, "
                               "CASE WHEN contains(lower(g.ensemble), 'max') THEN 1 ELSE 0 END AS is_max FROM grid g JOIN ee ON g.ensemble = ee.ensemble",
                               ["label", "emissions", "acc", "is_max"], {"emissions", "acc"}))
def q_tradeoff_ensembles(spark, sf):
    ms = member_sets(spark)
    grid = E.ensemble_grid(scores(spark, sf), ms).join(L.ensemble_emissions(ms, emissions(spark, sf)), "ensemble")
    return L.ensemble_points(grid)


def board_ctes() -> str:
    """CTE board(model, acc, f1, emissions) after a CTE scores: members and votes."""
    return (O.EMISSIONS + ", t AS (SELECT * FROM scores WHERE split = 'test'), " + O.cells_ctes("t", "model", "b") +
            ", base AS (SELECT a.model, a.accuracy AS acc, m.f1, coalesce(e.emissions, 0.0) AS emissions FROM b_acc a JOIN b_macro m "
            "ON a.model = m.model LEFT JOIN elookup e ON e.model = lower(a.model)), "
            + _f1_sql("val", MODELS) +
            ", mv AS (SELECT doc_id, arg_min(y_true, model) AS y_true, CASE WHEN avg(y_pred) >= 0.5 THEN 1 ELSE 0 END AS maj FROM t GROUP BY doc_id), "
            "mc AS (SELECT doc_id, y_pred, count(*) AS k FROM t GROUP BY ALL), "
            "mm AS (SELECT doc_id, y_pred FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, y_pred) AS rk FROM mc) WHERE rk = 1), "
            "wv AS (SELECT t.doc_id, CASE WHEN sum(w.f1 * t.prob) / sum(w.f1) > 0.5 THEN 1 ELSE 0 END AS wpred FROM t JOIN wts w ON t.model = w.model GROUP BY t.doc_id), "
            "ens AS (SELECT 'majority_voting' AS model, mv.y_true, mm.y_pred FROM mv JOIN mm ON mv.doc_id = mm.doc_id "
            "UNION ALL SELECT 'weighted_voting', mv.y_true, wv.wpred FROM mv JOIN wv ON mv.doc_id = wv.doc_id), "
            + O.cells_ctes("ens", "model", "en") +
            ", board AS (SELECT model, acc, f1, emissions FROM base UNION ALL SELECT a.model, a.accuracy, m.f1, "
            "(SELECT sum(emissions) FROM base) FROM en_acc a JOIN en_macro m ON a.model = m.model) ")


_BOARD_SQL = _S + board_ctes()


def _board(spark, sf):
    s = scores(spark, sf)
    test = s.where(F.col("split") == "test")
    base = M.summary_metrics(test, ("model",)).select("model", F.col("accuracy").alias("acc"), "f1")
    maj = E.majority_mode(s, "test", MODELS).withColumn("name", F.lit("majority_voting"))
    wv = E.weighted_vote_val(s, MODELS).withColumn("name", F.lit("weighted_voting"))
    ens = maj.select("name", "y_true", "y_pred").unionByName(wv.select("name", "y_true", "y_pred"))
    ens_rows = M.summary_metrics(ens, ("name",)).select("name", F.col("accuracy").alias("acc"), "f1")
    return L.leaderboard(base, ens_rows, emissions(spark, sf))


@query("leaderboard", W(_BOARD_SQL + "SELECT model, acc, f1, emissions FROM board", ["model", "acc", "f1", "emissions"],
                        {"acc", "f1", "emissions"}))
def q_leaderboard(spark, sf):
    return _board(spark, sf)


@query("leaderboard_csv", SQL["leaderboard"])
def q_leaderboard_csv(spark, sf):
    path = scratch_path(spark, "leaderboard")
    K.write_csv(_board(spark, sf), path)
    return spark.read.schema("model string, acc double, f1 double, emissions double").csv(path, header=True, escape='"')


@query("tradeoff_points", W(_BOARD_SQL + "SELECT model, emissions, acc, split_part(model, '-', 1) AS label, "
                            "CASE WHEN contains(lower(model), 'max') THEN 1 ELSE 0 END AS is_max FROM board",
                            ["model", "emissions", "acc", "label", "is_max"], {"emissions", "acc"}))
def q_tradeoff(spark, sf):
    return L.tradeoff_points(_board(spark, sf))


@query("leaderboard_rounded", W(_BOARD_SQL + "SELECT model, round(acc, 4) AS acc, round(f1, 4) AS f1, round(emissions, 6) AS emissions FROM board",
                                ["model", "acc", "f1", "emissions"], {"acc", "f1", "emissions"}))
def q_board_rounded(spark, sf):
    return L.rounded(_board(spark, sf))
