"""Oracle SQL for model preparation and evaluation operators (DuckDB dialect).

The bodies run after the fixture CTEs of ``oracle_sql``.  Medians use
``quantile_cont``; cumulative ROC counts use a window over distinct scores.
"""

from __future__ import annotations

_LAB = "(SELECT * FROM observations WHERE outbreak_label IS NOT NULL)"
_MED = {c: (f"(SELECT quantile_cont({c}, 0.5) FROM {_LAB} l WHERE {c} IS NOT NULL AND NOT isnan({c}))")
        for c in ("feat_chars", "feat_spaces")}
_MODE = (f"(SELECT feat_lang FROM {_LAB} l WHERE feat_lang IS NOT NULL GROUP BY feat_lang "
         "ORDER BY count(*) DESC, feat_lang LIMIT 1)")

_GROUPED = """(SELECT score, count(*) FILTER (WHERE y_bin = 1) AS pos, count(*) FILTER (WHERE y_bin = 0) AS neg
  FROM evaluated GROUP BY score)"""
_CUM = f"""(SELECT score, pos, neg,
         coalesce(sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_before,
         coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before,
         sum(pos) OVER () AS P, sum(neg) OVER () AS N
  FROM {_GROUPED} g)"""
_BIN = """(SELECT count(*) FILTER (WHERE y_hat = y_bin) AS correct, count(*) AS total,
         count(*) FILTER (WHERE y_bin = 1 AND y_hat = 1) AS tp, count(*) FILTER (WHERE y_bin <> 1 AND y_hat = 1) AS fp,
         count(*) FILTER (WHERE y_bin = 1 AND y_hat <> 1) AS fn
  FROM (SELECT y_bin, CAST(score >= CAST(0.5 AS DOUBLE) AS INTEGER) AS y_hat FROM evaluated) e)"""
_CLS = """(SELECT label, support, predicted, tp,
         CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS recall,
         CASE WHEN support + predicted > 0 THEN CAST(2 * tp AS DOUBLE) / (support + predicted) ELSE 0 END AS f1_score
  FROM (SELECT label, sum(t) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (
          SELECT y_true AS label, 1 AS t, 0 AS p, CAST(y_true = y_pred AS INTEGER) AS tp FROM evaluated
          UNION ALL SELECT y_pred, 0, 1, 0 FROM evaluated) u GROUP BY label) c)"""




def _split_rows(source: str, label: str, test_size: float = 0.2, seed: int = 42) -> str:
    """``source`` with ``split``: rows rank by 60 bits of an md5; quotas by largest remainder, ties in class order."""
    return f"""(
  SELECT r.*, CASE WHEN place <= train_c THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY CAST('0x' || substr(md5('{seed}|' || row_seq), 1, 15) AS BIGINT), row_seq) AS place
        FROM {source} s1) r
  JOIN (SELECT c, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, CAST(c AS VARCHAR)) <= n_train - sum(fl) OVER () THEN 1 ELSE 0 END AS train_c
        FROM (SELECT c, n_train, floor(CAST(n_c AS DOUBLE) / n * n_train) AS fl,
                     CAST(n_c AS DOUBLE) / n * n_train - floor(CAST(n_c AS DOUBLE) / n * n_train) AS rem
              FROM (SELECT {label} AS c, count(*) AS n_c FROM {source} s2 GROUP BY 1) k,
                   (SELECT count(*) AS n, count(*) - CAST(ceil(CAST({test_size} AS DOUBLE) * count(*)) AS BIGINT) AS n_train
                    FROM {source} s3) z) f) a ON a.c = r.{label})"""


#: The outbreak model solved in SQL: accelerated gradient descent on the log loss plus half the squared coefficients,
#: over the training rows prepared in SQL.  ``solved`` holds the coefficients, the intercept last.
_LOGISTIC = f"""
WITH RECURSIVE t AS (SELECT * FROM {_split_rows(_LAB, 'outbreak_label')} s WHERE split = 'train'),
mid AS (SELECT quantile_cont(feat_chars, 0.5) FILTER (NOT isnan(feat_chars)) AS mc, quantile_cont(feat_spaces, 0.5) FILTER (NOT isnan(feat_spaces)) AS ms,
               (SELECT feat_lang FROM t WHERE feat_lang IS NOT NULL GROUP BY feat_lang ORDER BY count(*) DESC, feat_lang LIMIT 1) AS ml FROM t),
st AS (SELECT any_value(mc) AS mc, any_value(ms) AS ms, any_value(ml) AS ml, avg(coalesce(feat_chars, mc)) AS ac, avg(coalesce(feat_spaces, ms)) AS asp,
              coalesce(nullif(stddev_pop(coalesce(feat_chars, mc)), 0), 1) AS dc, coalesce(nullif(stddev_pop(coalesce(feat_spaces, ms)), 0), 1) AS ds FROM t, mid),
ls AS (SELECT list(v ORDER BY v) AS vs FROM (SELECT DISTINCT coalesce(feat_lang, ml) AS v FROM t, mid) x),
named AS (SELECT list_concat(['feat_chars', 'feat_spaces'], list_transform(vs, lambda v: 'feat_lang_' || v), ['(intercept)']) AS names FROM ls),
every_x AS (SELECT row_seq, list_concat([(coalesce(feat_chars, mc) - ac) / dc, (coalesce(feat_spaces, ms) - asp) / ds],
                list_transform(vs, lambda v: CAST(v = coalesce(feat_lang, ml) AS DOUBLE)), [CAST(1 AS DOUBLE)]) AS xs FROM observations, st, ls),
x AS MATERIALIZED (SELECT xs, CAST(outbreak_label AS DOUBLE) AS y FROM t JOIN every_x USING (row_seq)),
step AS (SELECT sum(list_dot_product(xs, xs)) / 4 + 1 AS steep, max(len(xs)) AS d FROM x),
gd(it, w, v) AS (
  SELECT 0, list_transform(range(d), lambda i: CAST(0 AS DOUBLE)), list_transform(range(d), lambda i: CAST(0 AS DOUBLE)) FROM step
  UNION ALL
  SELECT it + 1, list(nw ORDER BY j), list(nw + (sqrt(steep) - 1) / (sqrt(steep) + 1) * (nw - ow) ORDER BY j) FROM (
    SELECT it, j, any_value(steep) AS steep, any_value(w[j]) AS ow,
           any_value(v[j]) - (sum((1 / (1 + exp(-list_dot_product(xs, v))) - y) * xs[j]) + CASE WHEN j < any_value(d) THEN any_value(v[j]) ELSE 0 END)
             / any_value(steep) AS nw
    FROM gd, step, x, (SELECT unnest(range(1, d + 1)) AS j FROM step) js WHERE it < 2000 GROUP BY it, j) g GROUP BY it, steep),
solved AS (SELECT w FROM gd WHERE it = 2000)"""


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["stratified_split"] = f"SELECT row_seq, outbreak_label, split FROM {_split_rows(_LAB, 'outbreak_label')} s"
    q["impute_median"] = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round({m}, 6) AS median" for c, m in _MED.items())
    q["standard_scale"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg(coalesce({c}, {m})), 6) AS mean,
               round(CASE WHEN coalesce(stddev_pop(coalesce({c}, {m})), 0) = 0 THEN 1
                          ELSE stddev_pop(coalesce({c}, {m})) END, 6) AS scale FROM {_LAB} l"""
        for c, m in _MED.items())
    q["impute_mode"] = f"SELECT 'feat_lang' AS feature, {_MODE} AS mode"
    q["one_hot_ignore_unknown"] = f"""
SELECT o.row_seq, coalesce(o.feat_lang, {_MODE}) AS feat_lang_filled, CAST(c.idx AS INTEGER) AS feat_lang_hot_index
FROM observations o LEFT JOIN (
  SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx
  FROM (SELECT DISTINCT coalesce(feat_lang, {_MODE}) AS v FROM {_LAB} l) x) c
  ON coalesce(o.feat_lang, {_MODE}) = c.v"""
    slots = ", ".join(
        f"round((coalesce({c}, {m}) - (SELECT avg(coalesce({c}, {m})) FROM {_LAB} l)) / "
        f"(SELECT CASE WHEN coalesce(stddev_pop(coalesce({c}, {m})), 0) = 0 THEN 1 ELSE stddev_pop(coalesce({c}, {m})) END "
        f"FROM {_LAB} l), 6)" for c, m in _MED.items())
    cats = f"(SELECT DISTINCT coalesce(feat_lang, {_MODE}) AS v FROM {_LAB} l)"
    q["assemble_features"] = f"""
SELECT o.row_seq, list_concat([{slots}], list_transform(c.vs, lambda v: CAST(v = o.filled AS DOUBLE))) AS features
FROM (SELECT *, coalesce(feat_lang, {_MODE}) AS filled FROM observations) o, (SELECT list(v ORDER BY v) AS vs FROM {cats} x) c"""
    typed = """(SELECT * FROM observations WHERE fever_type IS NOT NULL AND (
      (SELECT count(*) FROM observations WHERE outbreak_label = 1 AND fever_type IS NOT NULL) < 20 OR outbreak_label = 1))"""
    parts = f"""SELECT row_seq, fever_type AS class, split, CASE WHEN split = 'test' THEN true END AS from_nodes
FROM {_split_rows(typed, 'fever_type')} s"""
    q["train_outbreak_model"] = f"""
SELECT m.feature, true AS at_optimum, round(m.coefficient, 3) + 0 AS coefficient FROM ({_LOGISTIC}
  SELECT unnest(names) AS feature, unnest(w) AS coefficient FROM solved, named) m"""
    q["score_outbreak"] = f"""
SELECT o.row_seq, round(o.p, 3) AS p_outbreak, true AS logistic, true AS at_optimum FROM ({_LOGISTIC}
  SELECT row_seq, 1 / (1 + exp(-list_dot_product(xs, w))) AS p FROM every_x, solved) o"""
    q["train_type_forest"] = f"SELECT p.*, true AS consistent FROM ({parts}) p"
    q["train_type_boosted"] = parts
    q["run_two_stage_scoring"] = "SELECT row_seq, Region, true AS in_range, true AS gated, true AS product FROM observations"
    q["save_model"] = "SELECT row_seq, true AS same_outbreak, true AS same_type FROM observations"
    q["write_metrics"] = """
SELECT stage, metric, true AS agrees FROM (VALUES ('stage1', 'roc_auc'), ('stage1', 'f1'), ('stage1', 'accuracy'),
  ('stage2', 'accuracy'), ('stage2', 'f1_macro'), ('stage2', 'f1_weighted')) m(stage, metric)"""
    features = f"""(SELECT 'feat_chars' AS feature UNION ALL SELECT 'feat_spaces'
  UNION ALL SELECT DISTINCT 'feat_lang_' || coalesce(feat_lang, (SELECT feat_lang FROM {typed} t WHERE feat_lang IS NOT NULL
    GROUP BY feat_lang ORDER BY count(*) DESC, feat_lang LIMIT 1)) FROM {typed} u)"""
    q["feature_importances"] = f"SELECT feature, true AS in_range, true AS sum_is_one, true AS from_nodes FROM {features} f"
    q["top20_feature_importances"] = f"SELECT feature, true AS in_place FROM {features} f"
    q["score_type"] = """
SELECT row_seq, Region, P_Outbreak,
       CASE WHEN P_Outbreak >= CAST(0.5 AS DOUBLE)
            THEN ['Dengue', 'Typhoid', 'Viral'][list_position(probs, list_max(probs))] ELSE 'None' END AS Fever_Type,
       CASE WHEN P_Outbreak >= CAST(0.5 AS DOUBLE) THEN list_max(probs) ELSE CAST(0 AS DOUBLE) END AS P_Type,
       P_Outbreak * CASE WHEN P_Outbreak >= CAST(0.5 AS DOUBLE) THEN list_max(probs) ELSE CAST(0 AS DOUBLE) END
           AS Severity_Index
FROM (SELECT row_seq, Region, P_Outbreak, [a / t, b / t, c / t] AS probs
      FROM (SELECT event_id AS row_seq, 'R' || CAST(user_id AS VARCHAR) AS Region,
                   least(value / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) AS P_Outbreak,
                   CAST(1 + event_id % 3 AS DOUBLE) AS a, CAST(1 + event_id % 5 AS DOUBLE) AS b,
                   CAST(1 + event_id % 2 AS DOUBLE) AS c,
                   CAST(1 + event_id % 3 AS DOUBLE) + CAST(1 + event_id % 5 AS DOUBLE)
                       + CAST(1 + event_id % 2 AS DOUBLE) AS t
            FROM events) e) p"""
    q["threshold_predict"] = ("SELECT row_id, y_bin, score, CAST(score >= CAST(0.5 AS DOUBLE) AS INTEGER) AS y_hat "
                              "FROM evaluated")
    q["roc_auc"] = f"""
SELECT round(CASE WHEN max(P) > 0 AND max(N) > 0 THEN 1 - sum(CAST(neg AS DOUBLE) * pos_before
             + CAST(neg AS DOUBLE) * pos * CAST(0.5 AS DOUBLE)) / (CAST(max(P) AS DOUBLE) * max(N)) END, 6) AS roc_auc
FROM {_CUM} c"""
    q["roc_curve_points"] = f"""
SELECT score AS threshold,
       CASE WHEN N > 0 THEN CAST(N - neg_before AS DOUBLE) / N ELSE 0 END AS fpr,
       CASE WHEN P > 0 THEN CAST(P - pos_before AS DOUBLE) / P ELSE 0 END AS tpr
FROM {_CUM} c"""
    q["accuracy"] = f"SELECT round(CAST(correct AS DOUBLE) / total, 6) AS accuracy FROM {_BIN} b"
    q["f1_binary"] = (f"SELECT round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) "
                      f"ELSE 0 END, 6) AS f1 FROM {_BIN} b")
    q["f1_macro"] = f"SELECT round(avg(f1_score), 6) AS f1_macro FROM {_CLS} c"
    q["f1_weighted"] = f"SELECT round(sum(f1_score * support) / sum(support), 6) AS f1_weighted FROM {_CLS} c"
    q["classification_report"] = f"""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM {_CLS} c
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6), CAST(sum(support) AS BIGINT)
FROM {_CLS} c
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
                 CAST(sum(support) AS BIGINT) FROM {_CLS} c
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM {_CLS} c"""
    q["confusion_matrix"] = "SELECT y_true, y_pred, count(*) AS n FROM evaluated GROUP BY 1, 2"
    return q
