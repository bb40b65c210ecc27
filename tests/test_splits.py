"""Split quotas (FIXTURES.md) and split properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from verdant.operators import prepare as P
from verdant.sources.tables import reviews

EXPECTED = {
    "0.001": {"90_5_5": {"train": (10, 68), "val": (0, 4), "test": (1, 4)},
              "80_10_10": {"train": (9, 60), "val": (1, 8), "test": (1, 8)}},
    "0.01": {"90_5_5": {"train": (52, 307), "val": (3, 17), "test": (3, 17)},
             "80_10_10": {"train": (46, 273), "val": (6, 34), "test": (6, 34)}},
    "0.1": {"90_5_5": {"train": (514, 3068), "val": (29, 170), "test": (28, 171)},
            "80_10_10": {"train": (457, 2727), "val": (57, 341), "test": (57, 341)}},
}


def _counts(df):
    got = {}
    for r in df.groupBy("split", "label").count().collect():
        got.setdefault(r["split"], [0, 0])[r["label"]] = r["count"]
    return {k: tuple(v) for k, v in got.items()}


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_quotas(spark, sf):
    r = reviews(spark, f"/root/testdata/sf{sf}").select("doc_id", "label")
    for kind, fn in (("90_5_5", P.split_90_5_5), ("80_10_10", P.split_80_10_10)):
        got = _counts(fn(r))
        exp = {k: v for k, v in EXPECTED[sf][kind].items()}
        for k in exp:
            assert got.get(k, (0, 0)) == exp[k], (sf, kind, k)
    lstm = _counts(P.split_lstm(r))
    assert lstm == {k: v for k, v in EXPECTED[sf]["80_10_10"].items() if v != (0, 0)}


def test_split_independent_of_partitioning(spark):
    r = reviews(spark, "/root/testdata/sf0.01").select("doc_id", "label")
    a = {x["doc_id"]: x["split"] for x in P.split_80_10_10(r.repartition(1)).collect()}
    b = {x["doc_id"]: x["split"] for x in P.split_80_10_10(r.repartition(13, "label")).collect()}
    assert a == b and len(a) == r.count()


@settings(max_examples=8, deadline=None)
@given(n=st.integers(min_value=1, max_value=300), k=st.integers(min_value=1, max_value=4),
       frac=st.sampled_from([0.1, 0.25, 0.5]), few=st.sampled_from([1, 9, 1000]), literal=st.sampled_from([0, 64]))
def test_split_is_partition_with_quotas(spark, n, k, frac, few, literal):
    df = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % k).cast("int").alias("label"))
    sizes = P.class_sizes(df, "label")
    q = P.holdout_allocation(sizes, frac)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(P, "FEW", few)
        patch.setattr(P, "HISTOGRAM_ROWS", 64)
        patch.setattr(P, "LITERAL_STRATA", literal)
        out = P.assign_segments(df, "doc_id", "label", 7, {k: [h] for k, (_, h) in q.items()}, sizes, ["test", "train"])
        rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    import math
    assert sum(h for _, h in q.values()) == math.ceil(round(frac * n, 9))
    for lab, (keep, hold) in q.items():
        assert sum(1 for r in rows if r["label"] == lab and r["split"] == "test") == hold
        assert sum(1 for r in rows if r["label"] == lab and r["split"] == "train") == keep


def test_sample_exact_size(spark):
    df = spark.range(87).withColumnRenamed("id", "doc_id")
    assert P.sample_exact(df, 0.25).count() == round(0.25 * 87)
    assert P.sample_exact(df, 0.5, seed=1).count() == round(0.5 * 87)
    with pytest.raises(ValueError):
        P.sample_exact(df, 0.0)


@pytest.mark.parametrize("few, literal", [(1 << 16, 64), (40, 64), (3, 0)])
def test_cuts_equal_one_window(spark, monkeypatch, few, literal):
    """Narrowing by prefixes gives exactly the ranks of one window per class."""
    monkeypatch.setattr(P, "FEW", few)
    monkeypatch.setattr(P, "HISTOGRAM_ROWS", 64)
    monkeypatch.setattr(P, "LITERAL_STRATA", literal)
    r = reviews(spark, "/root/testdata/sf0.1").select("doc_id", "label")
    sizes = P.class_sizes(r, "label")
    cuts = {k: [0, v // 10, v // 3, v] for k, v in sizes.items()}
    out = P.assign_segments(r, "doc_id", "label", 42, cuts, sizes, ["z", "a", "b", "c", "d"], "seg")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(P.order_key("doc_id", 42), "doc_id")) - 1
    plain = {x["doc_id"]: sum(x["r"] >= c for c in cuts[x["label"]]) for x in r.withColumn("r", rank).collect()}
    assert {x["doc_id"]: "zabcd".index(x["seg"]) for x in out.collect()} == plain


def test_no_text_moves(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.col("lang").alias("label"))
    plan = P.split_80_10_10(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_rows_without_or_with_one_id(spark):
    df = spark.createDataFrame([(i if i < 30 else 7 if i < 34 else None, "x" if i % 2 else None) for i in range(40)], "doc_id long, label string")
    out = P.split_80_10_10(df)
    assert out.count() == 40 and out.where("split is null").count() == 0
    assert out.where("doc_id = 7").groupBy("label").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    assert P.split_80_10_10(df.where("false")).count() == 0


def test_content_ids_give_one_split_whatever_the_files(spark, tmp_path):
    """The same rows as one file or seven parts: the same ids and splits, also of repeated rows."""
    from verdant.sources import reviews as RV
    rows = [(f"text {i % 150}", i % 3) for i in range(400)] + [("the same", 1)] * 200 + [(None, 0), (None, 0), ("", 0)]
    df = spark.createDataFrame(rows, "text string, label int")
    got = []
    for parts in (1, 7):
        path = str(tmp_path / f"p{parts}")
        df.repartition(parts).write.option("header", True).option("escape", '"').csv(path)
        read = RV.load_source("csv", spark, path, schema="text string, label int")  # by name
        out = P.split_80_10_10(read).collect()
        assert len(out) == len({r["doc_id"] for r in out}) == len(rows)
        got.append({(r["doc_id"], r["label"], r["split"]) for r in out})
    assert got[0] == got[1]
    df.write.parquet(str(tmp_path / "polarity"))
    half = RV.load_source("polarity", spark, str(tmp_path / "polarity"), fraction=0.5)
    assert half.count() == round(0.5 * len(rows)) and half.columns == ["doc_id", "text", "label"]
    assert {r["doc_id"] for r in half.collect()} == {r["doc_id"] for r in RV.load_source("polarity", spark, str(tmp_path / "polarity"), fraction=0.5).collect()}


def test_many_classes_give_the_same_encoding(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 17 == 0 else f"c{i % 40}") for i in range(300)], "doc_id long, label string")
    want = {(r["doc_id"], r["label_idx"]) for r in P.encode_labels(df).collect()}
    monkeypatch.setattr(P, "MAX_CLASSES", 5)
    assert {(r["doc_id"], r["label_idx"]) for r in P.encode_labels(df).collect()} == want
