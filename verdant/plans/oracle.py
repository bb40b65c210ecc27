"""DuckDB SQL for the registered queries (the correctness oracle).

The SQL is written independently of the Spark code: the same definitions
(hash order, quotas, formulas), expressed as plain window functions over whole
classes.  The builders return CTE text; ``wrap`` rounds DOUBLE outputs to six
digits exactly like the Spark side does.
"""

from __future__ import annotations

SEED = 42
TOKEN_RE = r"([\p{L}\p{N}_]{2,})"
SEQ_FILTERS_SQL = "'!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10)"


def wrap(body: str, cols: list[str], doubles: set[str]) -> str:
    sel = ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in cols)
    return f"SELECT {sel} FROM ({body}) AS q"


REVIEWS = ("reviews AS (SELECT d.doc_id, d.text, l.quality::INT AS label "
           "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")


def holdout(name: str, src: str, count_col: str, frac: float, keep: str, hold: str) -> str:
    f = repr(float(frac))
    return f"""{name}_a AS (SELECT label, {count_col}::BIGINT AS c, (sum({count_col}) OVER ())::BIGINT AS n FROM {src}),
{name}_b AS (SELECT label, c, n, CAST(ceil(round({f}::DOUBLE * n, 9)) AS BIGINT) AS hold_t FROM {name}_a),
{name}_c AS (SELECT label, c, n, n - hold_t AS keep_t,
  CASE WHEN n > 0 THEN (c * (n - hold_t)) // n ELSE 0 END AS base,
  CASE WHEN n > 0 THEN (c * (n - hold_t)) % n ELSE 0 END AS rem FROM {name}_b),
{name}_d AS (SELECT label, c, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label ASC NULLS FIRST)
  <= keep_t - (sum(base) OVER ())::BIGINT THEN 1 ELSE 0 END AS k FROM {name}_c),
{name} AS (SELECT label, k::BIGINT AS {keep}, (c - k)::BIGINT AS {hold} FROM {name}_d)"""


def split_ctes(src: str, out: str, kind: str = "80_10_10", seed: int = SEED, cols: str = "*") -> str:
    """CTEs ending in ``out`` = rows of ``src`` plus ``split``."""
    cnt = f"{out}_cnt AS (SELECT label, count(*) AS c FROM {src} GROUP BY label)"
    if kind == "80_10_10":
        q = [holdout(f"{out}_q1", f"{out}_cnt", "c", 0.1, "keep1", "hold1"),
             holdout(f"{out}_q2", f"{out}_q1", "keep1", 0.1 / 0.9, "train_keep", "val")]
        quota = (f"{out}_q AS (SELECT a.label, a.hold1 AS test, b.val AS val FROM {out}_q1 a "
                 f"JOIN {out}_q2 b ON a.label IS NOT DISTINCT FROM b.label)")
    elif kind == "lstm":
        q = [holdout(f"{out}_q1", f"{out}_cnt", "c", 0.1, "keep1", "hold1"),
             holdout(f"{out}_q2", f"{out}_q1", "keep1", 0.1111, "train_keep", "val")]
        quota = (f"{out}_q AS (SELECT a.label, a.hold1 AS test, b.val AS val FROM {out}_q1 a "
                 f"JOIN {out}_q2 b ON a.label IS NOT DISTINCT FROM b.label)")
    elif kind == "90_5_5":
        q = [holdout(f"{out}_q1", f"{out}_cnt", "c", 0.1, "keep1", "hold1"),
             holdout(f"{out}_q2", f"{out}_q1", "hold1", 0.5, "val", "test")]
        quota = f"{out}_q AS (SELECT label, test, val FROM {out}_q2)"
    elif kind == "2way":
        q = [holdout(f"{out}_q1", f"{out}_cnt", "c", 0.1, "keep1", "hold1")]
        quota = f"{out}_q AS (SELECT label, hold1 AS test, 0::BIGINT AS val FROM {out}_q1)"
    else:
        raise ValueError(kind)
    rank = (f"{out}_r AS (SELECT s.*, row_number() OVER (PARTITION BY s.label ORDER BY "
            f"md5(concat('{seed}', ':', s.doc_id::VARCHAR)), s.doc_id) - 1 AS r FROM {src} s)")
    if kind == "2way":
        lab = f"CASE WHEN r < q.test THEN 'test' ELSE 'train' END"
    else:
        lab = "CASE WHEN r < q.test THEN 'test' WHEN r < q.test + q.val THEN 'val' ELSE 'train' END"
    final = (f"{out} AS (SELECT r.* EXCLUDE (r), {lab} AS split FROM {out}_r r "
             f"JOIN {out}_q q ON r.label IS NOT DISTINCT FROM q.label)")
    return ",\n".join([cnt, *q, quota, rank, final])


def model_scores_ctes(models=("m0", "m1", "m2")) -> str:
    vals = ", ".join(f"('{m}')" for m in models)
    return ",\n".join([
        REVIEWS,
        "ms_src AS (SELECT doc_id, label FROM reviews)",
        split_ctes("ms_src", "ms_split", "90_5_5"),
        f"""ms_p AS (SELECT m.model, s.split, s.doc_id, s.label,
  0.65::DOUBLE * ((('0x' || substr(md5(concat(s.doc_id::VARCHAR, ':', m.model)), 1, 8))::BIGINT)::DOUBLE / 4294967296.0)
  + 0.35::DOUBLE * s.label::DOUBLE AS p FROM ms_split s, (VALUES {vals}) AS m(model))""",
        """scores AS (SELECT model, split, doc_id, label::INT AS y_true,
  (CASE WHEN p > 0.5 THEN 1 ELSE 0 END)::INT AS y_pred, p AS prob FROM ms_p)""",
    ])


EMISSIONS = """elog AS (SELECT 'M' || (user_id % 5)::VARCHAR || '_experiment' AS project_name, value / 1e6 AS emissions,
  ts, event_id FROM events),
elookup AS (SELECT model, emissions FROM (SELECT lower(replace(project_name, '_experiment', '')) AS model, emissions,
  row_number() OVER (PARTITION BY lower(replace(project_name, '_experiment', '')) ORDER BY ts DESC, event_id DESC) AS rn
  FROM elog) WHERE rn = 1)"""

HISTORY = """hist AS (SELECT user_id AS run,
  (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS epoch,
  (json_extract_string(props, '$.k'))::DOUBLE / 100.0 AS accuracy,
  value / 500.0 AS val_accuracy,
  1.0 - (json_extract_string(props, '$.k'))::DOUBLE / 100.0 AS loss,
  1.0 - value / 500.0 AS val_loss FROM events)"""


def cells_ctes(src: str, group: str, out: str) -> str:
    """Per-class precision / recall / F1 / support from a scores-like CTE."""
    g = group + ", " if group else ""
    return f"""{out}_cells AS (SELECT {g}y_true, y_pred, count(*) AS n FROM {src} GROUP BY ALL),
{out}_cls AS (SELECT {g}class, sum(tp) AS tp, sum(pred) AS pred, sum(support) AS support FROM (
  SELECT {g}y_true AS class, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, 0 AS pred, n AS support FROM {out}_cells
  UNION ALL SELECT {g}y_pred AS class, 0 AS tp, n AS pred, 0 AS support FROM {out}_cells) GROUP BY ALL),
{out}_prf AS (SELECT {g}class,
  CASE WHEN pred > 0 THEN tp::DOUBLE / pred ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0.0 END AS recall,
  CASE WHEN pred + support > 0 THEN 2.0 * tp / (pred + support) ELSE 0.0 END AS f1,
  support::BIGINT AS support FROM {out}_cls),
{out}_acc AS (SELECT {g}sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END)::DOUBLE / sum(n) AS accuracy,
  sum(n)::BIGINT AS n FROM {out}_cells GROUP BY ALL),
{out}_macro AS (SELECT {g}avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM {out}_prf GROUP BY ALL)"""


def report_select(out: str, group: str) -> str:
    g = group + ", " if group else ""
    return f"""SELECT {g}class::VARCHAR AS label, precision, recall, f1, support::DOUBLE AS support FROM {out}_prf
UNION ALL SELECT {g}'accuracy', accuracy, accuracy, accuracy, accuracy FROM {out}_acc
UNION ALL SELECT {g}'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::DOUBLE FROM {out}_prf GROUP BY ALL
UNION ALL SELECT {g}'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support)::DOUBLE FROM {out}_prf GROUP BY ALL"""


def tfidf_ctes(src: str, max_features: int | None = 50000, ngram_max: int = 2) -> str:
    """CTEs dt(doc_id,label,split,term,tf), vocab(term,cnt,df), vidf(term,idf), w(...weight)."""
    assert ngram_max in (1, 2)
    grams = ("list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) "
             "ELSE [] END)") if ngram_max == 2 else "t"
    limit = f"ORDER BY cnt DESC, term ASC LIMIT {max_features}" if max_features else ""
    return f"""tok AS (SELECT doc_id, label, split, regexp_extract_all(strip_accents(lower(text)), '{TOKEN_RE}', 1) AS t FROM {src}),
grams AS (SELECT doc_id, label, split, {grams} AS g FROM tok),
dt AS (SELECT doc_id, label, split, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, label, split, unnest(g) AS term FROM grams) GROUP BY ALL),
ntrain AS (SELECT count(*)::DOUBLE AS n FROM {src} WHERE split = 'train'),
vocab AS (SELECT term, sum(tf)::BIGINT AS cnt, count(*)::BIGINT AS df FROM dt WHERE split = 'train' GROUP BY term {limit}),
vidf AS (SELECT term, cnt, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocab, ntrain),
w0 AS (SELECT doc_id, label, split, term, tf, tf * idf AS w FROM dt JOIN vidf USING (term)),
w AS (SELECT doc_id, label, split, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""


def nb_ctes(src: str, eval_splits: str = "'test'") -> str:
    """CTE nbpred(doc_id, split, y_true, y_pred, prob) after tfidf_ctes."""
    return f"""classes AS (SELECT DISTINCT label AS class FROM {src} WHERE split = 'train'),
fc AS (SELECT label AS class, term, sum(weight) AS fc FROM w WHERE split = 'train' GROUP BY ALL),
dense AS (SELECT c.class, v.term, coalesce(fc.fc, 0.0) AS fc FROM vocab v CROSS JOIN classes c
  LEFT JOIN fc ON fc.class = c.class AND fc.term = v.term),
flp AS (SELECT class, term, ln((fc + 1.0) / (sum(fc) OVER (PARTITION BY class) + count(*) OVER (PARTITION BY class))) AS flp FROM dense),
prior AS (SELECT label AS class, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM {src} WHERE split = 'train' GROUP BY label),
sums AS (SELECT doc_id, class, sum(weight * flp) AS s FROM w JOIN flp USING (term) WHERE split IN ({eval_splits}) GROUP BY ALL),
grid AS (SELECT s.doc_id, s.split, s.label, c.class FROM {src} s CROSS JOIN classes c WHERE s.split IN ({eval_splits})),
scored AS (SELECT g.doc_id, g.split, g.label, g.class, p.prior + coalesce(x.s, 0.0) AS score FROM grid g
  JOIN prior p ON p.class = g.class LEFT JOIN sums x ON x.doc_id = g.doc_id AND x.class = g.class),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class ASC) AS rk,
  max(score) OVER (PARTITION BY doc_id) AS m FROM scored),
lse AS (SELECT doc_id, max(m) + ln(sum(exp(score - m))) AS lse, max(CASE WHEN class = 1 THEN score END) AS s1 FROM ranked GROUP BY doc_id),
nbpred AS (SELECT r.doc_id, r.split, r.label::INT AS y_true, r.class::INT AS y_pred, exp(l.s1 - l.lse) AS prob
  FROM ranked r JOIN lse l USING (doc_id) WHERE r.rk = 1)"""
