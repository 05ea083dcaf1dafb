"""Registered metric queries on ``scored``."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators import split as P
from riskloom.plans.common import Registry, fx, r6, with_fixtures

R = Registry()
T = 0.5  # decision threshold parameter for the fixed-threshold metrics


def sql(body, ctes=()):
    return with_fixtures(["scored"], body, list(ctes))


def scored(spark, sf):
    return fx(spark, sf, "scored")


PRED = ("pr", f"SELECT *, CASE WHEN score > {T} THEN 1 ELSE 0 END AS y_pred FROM scored")
CNT = ("cnt", """SELECT CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM pr""")


def curve_ctes(source, end=""):
    """Score curve of ``source``: totals by threshold (st), running totals (cv), precision and recall (pts)."""
    return [
        (f"st{end}", f"SELECT score AS threshold, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {source} GROUP BY score"),
        (f"cv{end}", f"""SELECT threshold, pos, neg,
  sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tps,
  sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fps,
  sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM st{end}"""),
        (f"pts{end}", f"""SELECT threshold, pos, neg, tps, fps, P, N,
  CASE WHEN tps + fps = 0 THEN 0.0 ELSE CAST(tps AS DOUBLE) / (tps + fps) END AS prec,
  CASE WHEN tps - pos + fps - neg = 0 THEN 1.0 ELSE CAST(tps - pos AS DOUBLE) / (tps - pos + fps - neg) END AS prev_prec,
  CASE WHEN P = 0 THEN 1.0 ELSE CAST(tps AS DOUBLE) / P END AS rec FROM cv{end}"""),
    ]


CURVE = curve_ctes("scored")


def sd(a, b, default="0.0"):
    return f"CASE WHEN ({b}) = 0 THEN {default} ELSE CAST({a} AS DOUBLE) / ({b}) END"


@R.add("apply_threshold", sql("SELECT row_id, y_true, score, y_pred FROM pr", [PRED]))
def q_apply_threshold(spark, sf):
    return M.with_prediction(scored(spark, sf), T).select("row_id", "y_true", "score", "y_pred")


@R.add("m_confusion", sql("""SELECT 0 AS y_true, 0 AS y_pred, tn AS n FROM cnt UNION ALL
SELECT 0, 1, fp FROM cnt UNION ALL SELECT 1, 0, fn FROM cnt UNION ALL SELECT 1, 1, tp FROM cnt""", [PRED, CNT]))
def q_m_confusion(spark, sf):
    return M.confusion(M.with_prediction(scored(spark, sf), T))


@R.add("m_accuracy", sql("SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pr",
                         [PRED]))
def q_m_accuracy(spark, sf):
    return r6(M.accuracy(M.with_prediction(scored(spark, sf), T)))


@R.add("m_f1", sql(f"""SELECT round({sd('tp', 'tp + fp')}, 6) AS precision, round({sd('tp', 'tp + fn')}, 6) AS recall,
  round({sd('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM cnt""", [PRED, CNT]))
def q_m_f1(spark, sf):
    return r6(M.f1(M.with_prediction(scored(spark, sf), T)))


@R.add("m_report", sql(f"""SELECT '0' AS label, round({sd('tn', 'tn + fn')}, 6) AS precision,
  round({sd('tn', 'tn + fp')}, 6) AS recall, round({sd('2 * tn', '2 * tn + fn + fp')}, 6) AS f1, tn + fp AS support FROM cnt
UNION ALL SELECT '1', round({sd('tp', 'tp + fp')}, 6), round({sd('tp', 'tp + fn')}, 6),
  round({sd('2 * tp', '2 * tp + fp + fn')}, 6), tp + fn FROM cnt
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6), tp + fp + fn + tn FROM cnt
UNION ALL SELECT 'macro avg', round(({sd('tn', 'tn + fn')} + {sd('tp', 'tp + fp')}) / 2, 6),
  round(({sd('tn', 'tn + fp')} + {sd('tp', 'tp + fn')}) / 2, 6),
  round(({sd('2 * tn', '2 * tn + fn + fp')} + {sd('2 * tp', '2 * tp + fp + fn')}) / 2, 6), tp + fp + fn + tn FROM cnt
UNION ALL SELECT 'weighted avg',
  round(({sd('tn', 'tn + fn')} * (tn + fp) + {sd('tp', 'tp + fp')} * (tp + fn)) / (tp + fp + fn + tn), 6),
  round(({sd('tn', 'tn + fp')} * (tn + fp) + {sd('tp', 'tp + fn')} * (tp + fn)) / (tp + fp + fn + tn), 6),
  round(({sd('2 * tn', '2 * tn + fn + fp')} * (tn + fp) + {sd('2 * tp', '2 * tp + fp + fn')} * (tp + fn))
    / (tp + fp + fn + tn), 6), tp + fp + fn + tn FROM cnt""", [PRED, CNT]))
def q_m_report(spark, sf):
    return r6(M.report(M.with_prediction(scored(spark, sf), T)))


@R.add("m_roc_curve", sql(f"""SELECT threshold, round({sd('fps', 'N')}, 6) AS fpr, round({sd('tps', 'P')}, 6) AS tpr FROM cv
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""", CURVE[:2]))
def q_m_roc_curve(spark, sf):
    return r6(M.roc_curve(scored(spark, sf)))


@R.add("m_roc_auc", sql("""SELECT round(sum(pos * (N - fps + 0.5 * neg)) / (max(P) * max(N)), 6) AS roc_auc FROM cv""",
                        CURVE[:2]))
def q_m_roc_auc(spark, sf):
    return r6(M.roc_auc(scored(spark, sf)))


@R.add("m_pr_curve", sql("""SELECT threshold, round(prec, 6) AS precision, round(rec, 6) AS recall FROM pts
UNION ALL SELECT NULL, 1.0, 0.0""", CURVE))
def q_m_pr_curve(spark, sf):
    return r6(M.pr_curve(scored(spark, sf)))


@R.add("m_avg_precision", sql("SELECT round(sum(CAST(pos AS DOUBLE) / P * prec), 6) AS average_precision FROM pts", CURVE))
def q_m_avg_precision(spark, sf):
    return r6(M.average_precision(scored(spark, sf)))


@R.add("m_pr_auc", sql("SELECT round(sum(CAST(pos AS DOUBLE) / P * (prec + prev_prec) / 2), 6) AS pr_auc FROM pts", CURVE))
def q_m_pr_auc(spark, sf):
    return r6(M.pr_auc(scored(spark, sf)))


F1C = ("f1c", "SELECT threshold, prec, rec, 2 * prec * rec / (prec + rec + 1e-6) AS f1 FROM pts")


@R.add("m_f1_curve", sql("""SELECT threshold, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1
FROM f1c""", CURVE + [F1C]))
def q_m_f1_curve(spark, sf):
    return r6(M.f1_curve(scored(spark, sf)))


@R.add("m_best_threshold", sql("SELECT threshold, round(f1, 6) AS f1 FROM f1c ORDER BY f1 DESC, threshold ASC LIMIT 1",
                               CURVE + [F1C]))
def q_m_best_threshold(spark, sf):
    return r6(M.best_threshold(scored(spark, sf)))


H = "CAST(('0x' || substr(md5('42|' || CAST(row_id AS VARCHAR)), 1, 15)) AS BIGINT)"
# a tenth of each class tunes the threshold, the rest is scored with it
PARTS = [("parts", f"""SELECT *, rn < ceil(n * 0.1) AS holdout FROM (
  SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY {H}, row_id) - 1 AS rn, count(*) OVER (PARTITION BY y_true) AS n FROM scored)"""),
         ("val", "SELECT * FROM parts WHERE holdout"), ("rest", "SELECT * FROM parts WHERE NOT holdout"),
         *curve_ctes("val", "_v"), *curve_ctes("rest", "_r"),
         ("bt", """SELECT threshold AS t FROM (SELECT threshold, 2 * prec * rec / (prec + rec + 1e-6) AS f1 FROM pts_v)
ORDER BY f1 DESC, threshold ASC LIMIT 1"""),
         ("c", """SELECT sum(CASE WHEN y_true = 1 AND score > t THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y_true = 0 AND score > t THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 1 AND score <= t THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN y_true = 0 AND score <= t THEN 1 ELSE 0 END) AS tn FROM rest CROSS JOIN bt""")]


@R.add("eval_on_test", sql(f"""SELECT (SELECT t FROM bt) AS threshold, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy,
  round({sd('tp', 'tp + fp')}, 6) AS precision, round({sd('tp', 'tp + fn')}, 6) AS recall,
  round({sd('2 * tp', '2 * tp + fp + fn')}, 6) AS f1,
  (SELECT round(sum(pos * (N - fps + 0.5 * neg)) / (max(P) * max(N)), 6) FROM cv_r) AS roc_auc,
  (SELECT round(sum(CAST(pos AS DOUBLE) / P * prec), 6) FROM pts_r) AS average_precision,
  (SELECT round(sum(CAST(pos AS DOUBLE) / P * (prec + prev_prec) / 2), 6) FROM pts_r) AS pr_auc
FROM c""", PARTS))
def q_eval_on_test(spark, sf):
    return r6(M.evaluate_held_out(scored(spark, sf)))


# ---- folds and CV summaries over the scored table -----------------------------------
FOLDS = [("fo", f"""SELECT *, CAST((row_number() OVER (PARTITION BY y_true ORDER BY h, row_id) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT *, {H} AS h FROM scored)""")]
FOLD_METRICS = FOLDS + [
    ("fst", "SELECT fold, score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM fo GROUP BY fold, score"),
    ("fcv", """SELECT *, sum(neg) OVER (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
  sum(pos) OVER (PARTITION BY fold) AS P, sum(neg) OVER (PARTITION BY fold) AS N FROM fst"""),
    ("fauc", "SELECT fold, sum(pos * (N - fps + 0.5 * neg)) / (max(P) * max(N)) AS roc_auc FROM fcv GROUP BY fold"),
    ("fc", f"""SELECT fold, sum(CASE WHEN y_true = 1 AND score > {T} THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y_true = 0 AND score > {T} THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 1 AND score <= {T} THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN y_true = 0 AND score <= {T} THEN 1 ELSE 0 END) AS tn FROM fo GROUP BY fold"""),
    ("fm", f"""SELECT fold, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy,
  {sd('2 * tp', '2 * tp + fp + fn')} AS f1, roc_auc FROM fc JOIN fauc USING (fold)"""),
]


def fold_metrics(spark, sf):
    s = P.stratified_folds(scored(spark, sf), label="y_true", key="row_id", k=5, seed=42)
    pred = M.with_prediction(s, T)
    acc = M.accuracy(pred, group_cols=["fold"])
    f = M.f1(pred, group_cols=["fold"]).select("fold", "f1")
    auc = M.roc_auc(s, group_cols=["fold"])
    return acc.join(f, "fold").join(auc, "fold")


@R.add("stratified_folds", sql("SELECT row_id, y_true, fold FROM fo", FOLDS))
def q_stratified_folds(spark, sf):
    return P.stratified_folds(scored(spark, sf), label="y_true", key="row_id").select("row_id", "y_true", "fold")


@R.add("stratified_holdout", sql(f"""SELECT row_id, y_true, rn < ceil(n * 0.1) AS holdout FROM (
  SELECT *, row_number() OVER (PARTITION BY y_true ORDER BY {H}, row_id) - 1 AS rn,
  count(*) OVER (PARTITION BY y_true) AS n FROM scored)"""))
def q_stratified_holdout(spark, sf):
    return P.stratified_holdout(scored(spark, sf), label="y_true", key="row_id").select("row_id", "y_true", "holdout")


@R.add("cv_fold_metrics", sql("SELECT fold, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, "
                              "round(roc_auc, 6) AS roc_auc FROM fm", FOLD_METRICS))
def q_cv_fold_metrics(spark, sf):
    return r6(fold_metrics(spark, sf))


@R.add("cv_summary", sql("""SELECT round(avg(accuracy), 6) AS accuracy, round(avg(f1), 6) AS f1,
  round(avg(roc_auc), 6) AS roc_auc, arg_max(fold, f1) AS best_fold FROM fm""", FOLD_METRICS))
def q_cv_summary(spark, sf):
    from riskloom.operators.evaluation import cv_summary
    return r6(cv_summary(fold_metrics(spark, sf), ["accuracy", "f1", "roc_auc"], best_by="f1"))


@R.add("rank_summary", sql("""SELECT fold, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc
FROM fm ORDER BY roc_auc DESC, fold LIMIT 1""", FOLD_METRICS))
def q_rank_summary(spark, sf):
    from riskloom.operators.evaluation import rank_summary
    return r6(rank_summary(fold_metrics(spark, sf), "roc_auc", tie_break="fold"))
