"""Model-fitting queries: logistic regression, linear SVM, all classic models,
the neural classifier, model comparison, stacked ensembles, feature
importances, stored models.  What SQL can't check is tested in
``tests/test_linear.py``, ``test_boosting.py``, ``test_neural.py`` and
``test_models.py``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import classifiers as C
from ..operators import ensemble as E
from ..operators import history as H
from ..operators import metrics as M
from ..operators import neural as N
from ..operators import stored as ST
from ..operators import summary as L
from ..operators.score_registry import ScoreRegistry
from ..session import scratch_path
from ..sources.model_store import ModelStore
from . import oracle as O
from .classic import linear_scores, nb_scores
from .queries import _TF, MODELS, QUERIES, W, board_ctes, emissions, prepared, prepared_split, query, scores

# the sequence model's embedding and layer sizes and epochs are the reference's
NEURAL = N.Settings(size=128, filters=128, epochs=6, patience=2)
_FITTED: dict = {}


@query("clf_logreg")
def q_logreg(spark, sf):
    return linear_scores(prepared(spark, sf), ["logreg"])


@query("clf_svm")
def q_svm(spark, sf):
    return linear_scores(prepared(spark, sf), ["svm"])


def compare(spark, sf, names) -> DataFrame:
    """Metrics by model and split; the linear models are fitted together."""
    p = prepared(spark, sf)
    parts = []
    linear = [n for n in names if n in ("logreg", "svm")]
    if linear:
        parts.append(linear_scores(p, linear))
    if "nb" in names:
        parts.append(nb_scores(p, ("val", "test")))
    if "neural" in names:
        parts.append(neural_scores(spark, sf))
    return M.summary_metrics(reduce(DataFrame.unionByName, parts), ("model", "split"))


@query("clf_all")
def q_all(spark, sf):
    return compare(spark, sf, C.resolve_models("all"))


@query("compare_models")
def q_compare(spark, sf):
    return compare(spark, sf, [*C.resolve_models("all"), "neural"]).where(F.col("split") == "test")


def trained(spark, sf) -> N.Trained:
    """The neural classifier of the split, trained once per session and data;
    its epochs are versions in a model store under the shared folder."""
    key = (spark.sparkContext.applicationId, sf, "neural")
    if key not in _FITTED:
        split = prepared_split(spark, sf)
        classes = sorted(r["label"] for r in split.where(F.col("split") == "train").select("label").distinct().collect())  # one row per class
        store = ModelStore(spark, scratch_path(spark, "models"))
        _FITTED[key] = N.train(split, classes, store, "neural", NEURAL)
    return _FITTED[key]


def neural_scores(spark, sf) -> DataFrame:
    model = trained(spark, sf).model
    docs = prepared_split(spark, sf).where(F.col("split").isin("val", "test"))
    y = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("choice") + 1)
    return model.score(docs, ["split", "doc_id", "label"]).select(
        F.lit("neural").alias("model"), "split", "doc_id", F.col("label").alias("y_true"), y.cast("int").alias("y_pred"), "prob")


@query("clf_neural")
def q_neural(spark, sf):
    return neural_scores(spark, sf)


@query("neural_history")
def q_neural_history(spark, sf):
    """Learning curves of the trained run, its early stopping and the metrics of each epoch."""
    run = trained(spark, sf)
    per_epoch = M.metrics_of_cells(run.cells, ("run", "epoch"))
    return (run.history.join(per_epoch.select("run", "epoch", "f1", "precision", "recall"), ["run", "epoch"])
            .join(H.early_stopping(run.history, patience=NEURAL.patience).select("run", "best_epoch", "stopped_epoch"), "run"))


def stacked_logreg(s: DataFrame) -> DataFrame:
    """Test predictions of the meta logistic regression over the members' probabilities."""
    cols = E.meta_feature_names(MODELS, False)
    data = C.deterministic_order(C.stack_features(E.prob_matrix(s, MODELS), cols), "doc_id")
    val = data.where(F.col("split") == "val")
    out = C.meta_logreg(val.count()).fit(val).transform(data.where(F.col("split") == "test"))
    return out.select("doc_id", "y_true", F.col("prediction").cast("int").alias("y_pred"))


@query("stack_logreg")
def q_stack_lr(spark, sf):
    return stacked_logreg(scores(spark, sf))


# the reference's two meta models: trees that split by mean gradient, and
# second-order trees that see 80% of the columns each
GRADIENT_TREES = B.Settings(gain="variance", row_fraction=0.8)
SECOND_ORDER_TREES = B.Settings(gain="newton", row_fraction=0.8, column_fraction=0.8)


def boosted(spark, sf, settings: B.Settings) -> tuple[B.BoostedTrees, DataFrame]:
    """The meta model fitted on the validation scores, and all meta features.
    Fitted once per session, data and settings."""
    key = (spark.sparkContext.applicationId, sf, settings)
    if key not in _FITTED:
        _FITTED[key] = stacked_trees(scores(spark, sf), settings)
    return _FITTED[key]


def stacked_trees(s: DataFrame, settings: B.Settings) -> tuple[B.BoostedTrees, DataFrame]:
    meta = E.meta_features(s, MODELS)
    return B.fit(meta.where(F.col("split") == "val"), E.meta_feature_names(MODELS), settings=settings), meta


def boosted_predictions(model: B.BoostedTrees, meta: DataFrame) -> DataFrame:
    return model.score(meta.where(F.col("split") == "test")).select("doc_id", "y_true", "y_pred")


@query("stack_gbt")
def q_stack_gbt(spark, sf):
    return boosted_predictions(*boosted(spark, sf, GRADIENT_TREES))


@query("stack_gbt_colsample")
def q_stack_gbt_cs(spark, sf):
    return boosted_predictions(*boosted(spark, sf, SECOND_ORDER_TREES))


@query("feature_importances")
def q_importances(spark, sf):
    model, _ = boosted(spark, sf, SECOND_ORDER_TREES)
    rows = [(i, c, float(v)) for i, (c, v) in enumerate(zip(model.features, model.importances()))][:10]
    return spark.createDataFrame(rows, "position int, feature string, importance double")


# one level's sums of a tree in the making, for SQL: twenty equal bins, one
# finished tree (a cut of p_m0), and a second one cut at conf_m1 so far
LEVEL_CUTS = [round(0.05 * i, 2) for i in range(1, 20)]
_LEVEL_SQL = (f"WITH {O.model_scores_ctes()}, t AS (SELECT doc_id, any_value(y_true) AS y, "
              + ", ".join(f"max(CASE WHEN model = '{m}' THEN prob END) AS p_{m}" for m in MODELS)
              + " FROM scores WHERE split = 'train' GROUP BY doc_id), f AS (SELECT doc_id, y, "
              + ", ".join([f"p_{m}" for m in MODELS] + [f"abs(p_{m} - 0.5) AS conf_{m}" for m in MODELS]
                          + [f"-(p_{m} * ln(p_{m} + 1e-9) + (1 - p_{m}) * ln(1 - p_{m} + 1e-9)) AS ent_{m}" for m in MODELS])
              + f""" FROM t),
g AS (SELECT *, 1 / (1 + exp(-(CASE WHEN p_m0 >= 0.5 THEN 0.2 ELSE -0.1 END))) AS p, (conf_m1 >= 0.25)::INTEGER AS node FROM f),
x AS (SELECT node, y, p, unnest(range(9))::INTEGER AS feature, unnest([{', '.join(E.meta_feature_names(MODELS))}]) AS v FROM g)
SELECT node, feature, len(list_filter({LEVEL_CUTS}, lambda c: c <= v))::INTEGER AS bin, count(*) AS n,
  sum(round((p - y) * 1073741824)::BIGINT)::BIGINT AS g, sum(round(p * (1 - p) * 1073741824)::BIGINT)::BIGINT AS h
FROM x GROUP BY ALL""")


@query("boosting_level", _LEVEL_SQL)
def q_boosting_level(spark, sf):
    meta = E.meta_features(scores(spark, sf), MODELS).where(F.col("split") == "train")
    names = E.meta_feature_names(MODELS)
    done, growing = B.Tree.empty(3), B.Tree.empty(3)
    done.feature[0], done.cut[0], done.value[1], done.value[2] = names.index("p_m0"), LEVEL_CUTS.index(0.5), -0.1, 0.2
    growing.feature[0], growing.cut[0] = names.index("conf_m1"), LEVEL_CUTS.index(0.25)
    model = B.BoostedTrees(names, [LEVEL_CUTS] * len(names), B.Settings(), 0.0, [done])
    rows = B.binned_rows(meta, model, "y_true", "doc_id")
    return B.level_sums(rows, model, growing, 1, range(len(names)), 1, 0, 2.0 ** 30)


@query("stored_model", W(_TF + ", " + O.nb_ctes("sp", "'test'") + " SELECT doc_id, y_true, y_pred, prob FROM nbpred",
                         ["doc_id", "y_true", "y_pred", "prob"], {"prob"}))
def q_stored_model(spark, sf):
    """Naive Bayes saved as two versions, a third one left unfinished; the scores
    are those of the newest complete version, read from the store."""
    p = prepared(spark, sf)
    train = p.split.where(F.col("split") == "train")
    log_prob, prior = C.fit_naive_bayes(p.weights.where(F.col("split") == "train"), train.select("doc_id", "label"), p.vocab, p.classes)
    root = scratch_path(spark, "models")
    store = ModelStore(spark, root)
    flat_prior = prior.withColumn("prior", F.lit(0.0))
    ST.save_naive_bayes(store, "nb", log_prob, flat_prior, p.vocab, p.classes, p.max_features, p.ngram_max)
    ST.save_naive_bayes(store, "nb", log_prob, prior, p.vocab, p.classes, p.max_features, p.ngram_max)
    prior.write.parquet(f"{root}/nb/10/prior")  # a writer that died
    docs = p.split.where(F.col("split") == "test")
    scored = ST.newest_scorer(store, "nb")(docs.select("doc_id", "text"))
    return docs.select("doc_id", F.col("label").cast("int").alias("y_true")).join(scored, "doc_id").select("doc_id", "y_true", "y_pred", "prob")


# ------------------------------------------------- ensembles of fitted models
# members: naive Bayes with different smoothing, under the names of the emission log
SMOOTHING = dict(zip(MODELS, (1.0, 0.1, 0.01)))


def fitted_members(spark, sf) -> ScoreRegistry:
    """The members' validation and test scores in a registry, appended one by one."""
    key = (spark.sparkContext.applicationId, sf, "members")
    if key not in _FITTED:
        registry = ScoreRegistry(spark, scratch_path(spark, "scores"))
        for name, alpha in SMOOTHING.items():
            registry.append(name, nb_scores(prepared(spark, sf), ("val", "test"), alpha))
        _FITTED[key] = registry
    return _FITTED[key]


def board_of(spark, sf, more: dict[str, DataFrame]) -> DataFrame:
    """The leaderboard of the fitted members: their rows from the registry's
    cells, the votes, and further ensembles' test predictions by name."""
    registry = fitted_members(spark, sf)
    s = registry.scores(MODELS)
    base = registry.metrics(MODELS).where(F.col("split") == "test").select("model", F.col("accuracy").alias("acc"), "f1")
    votes = {**more, "majority_voting": E.majority_mode(s, "test", MODELS), "weighted_voting": E.weighted_vote_val(s, MODELS)}
    named = [v.select(F.lit(n).alias("name"), "y_true", "y_pred") for n, v in votes.items()]
    rows = M.summary_metrics(reduce(DataFrame.unionByName, named), ("name",)).select("name", F.col("accuracy").alias("acc"), "f1")
    return L.leaderboard(base, rows, emissions(spark, sf))


_MEMBERS_SQL = (_TF + ", " + O.nb_ctes("sp", "'val', 'test'") + ", "
                + "alphas AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE)" for m, a in SMOOTHING.items()) + ") AS t(model, alpha)), "
                + """mflp AS (SELECT model, class, term, ln((fc + alpha) / (sum(fc) OVER p + alpha * count(*) OVER p)) AS flp
  FROM dense, alphas WINDOW p AS (PARTITION BY model, class)),
msums AS (SELECT model, doc_id, class, sum(weight * flp) AS s FROM w JOIN mflp USING (term) WHERE split IN ('val', 'test') GROUP BY ALL),
mscored AS (SELECT a.model, g.doc_id, g.split, g.label, g.class, p.prior + coalesce(x.s, 0.0) AS score FROM grid g CROSS JOIN alphas a
  JOIN prior p ON p.class = g.class LEFT JOIN msums x ON x.doc_id = g.doc_id AND x.class = g.class AND x.model = a.model),
scores AS (SELECT model, doc_id, split, label::INT AS y_true, (CASE WHEN s1 > s0 THEN 1 ELSE 0 END)::INT AS y_pred, 1 / (1 + exp(s0 - s1)) AS prob
  FROM (SELECT model, doc_id, split, label, max(CASE WHEN class = 0 THEN score END) AS s0, max(CASE WHEN class = 1 THEN score END) AS s1
        FROM mscored GROUP BY ALL)), """)


@query("fitted_board", W(_MEMBERS_SQL + board_ctes() + "SELECT model, acc, f1, emissions FROM board", ["model", "acc", "f1", "emissions"],
                         {"acc", "f1", "emissions"}))
def q_fitted_board(spark, sf):
    return board_of(spark, sf, {})


@query("full_board")
def q_full_board(spark, sf):
    """With the two stacked models."""
    s = fitted_members(spark, sf).scores(MODELS)
    return board_of(spark, sf, {"meta_ensemble_gb": boosted_predictions(*stacked_trees(s, GRADIENT_TREES)), "stacked_ensemble_lr": stacked_logreg(s)})


@query("registry_metrics", W(_MEMBERS_SQL + O.cells_ctes("scores", "model, split", "m") + " SELECT a.model, a.split, a.accuracy, a.n, b.f1, b.precision, b.recall "
                             "FROM m_acc a JOIN m_macro b ON a.model = b.model AND a.split = b.split",
                             ["model", "split", "accuracy", "n", "f1", "precision", "recall"], {"accuracy", "f1", "precision", "recall"}))
def q_registry_metrics(spark, sf):
    return fitted_members(spark, sf).metrics().select("model", "split", "accuracy", "n", "f1", "precision", "recall")
