"""Exact binary-classification metrics on a scored table (y_true, score).

Everything is an aggregate over the table of distinct scores:
``score_curve`` groups rows by score (partial aggregation, so a score
shared by a third of all rows is still one row), then adds cumulative
true/false positives in descending score order with bucketed running
totals. Each curve point also knows the previous point, because
(tps - pos, fps - neg) is where the curve was one threshold higher, so
trapezoids and step sums need no window at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.credit_exprs import apply_threshold
from riskloom.operators.ranking import running_totals
from riskloom.session import cut_lineage


def _safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(default))


def with_prediction(scored: DataFrame, threshold: float | Column, score: str = "score",
                    out: str = "y_pred", inclusive: bool = False) -> DataFrame:
    return scored.withColumn(out, apply_threshold(score, threshold, inclusive))


def _counts(df: DataFrame, y: str, p: str, group_cols=()) -> DataFrame:
    yy, pp = F.col(y), F.col(p)
    return df.groupBy(*group_cols).agg(
        F.sum(((yy == 1) & (pp == 1)).cast("long")).alias("tp"),
        F.sum(((yy == 0) & (pp == 1)).cast("long")).alias("fp"),
        F.sum(((yy == 1) & (pp == 0)).cast("long")).alias("fn"),
        F.sum(((yy == 0) & (pp == 0)).cast("long")).alias("tn"))


def confusion(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Full 2x2 grid (y_true, y_pred, n), zero cells included, from one
    conditional aggregate."""
    c = _counts(df, y, p)
    cells = F.array(*[F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred"), F.col(n).alias("n"))
                      for a, b, n in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]])
    return c.select(F.explode(cells).alias("c")).select("c.*")


def accuracy(df: DataFrame, y: str = "y_true", p: str = "y_pred", group_cols=()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def _prf(c: DataFrame, group_cols=()) -> DataFrame:
    prec = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(*group_cols, prec.alias("precision"), rec.alias("recall"),
                    _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def f1(df: DataFrame, y: str = "y_true", p: str = "y_pred", group_cols=()) -> DataFrame:
    """Positive-class precision, recall, F1; empty denominators give 0."""
    return _prf(_counts(df, y, p, group_cols), group_cols)


def report(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """``classification_report``: per class P/R/F1/support, then accuracy,
    macro and weighted averages (accuracy row: f1 = accuracy)."""
    c = _counts(df, y, p)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1_1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    f1_0 = _safe_div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    d = lambda v: v.cast("double")
    names = ["label", "precision", "recall", "f1", "support"]
    row = lambda *vals: F.struct(*[v.alias(n) for v, n in zip(vals, names)])
    none = F.lit(None).cast("double")
    rows = F.array(
        row(F.lit("0"), d(p0), d(r0), d(f1_0), s0),
        row(F.lit("1"), d(p1), d(r1), d(f1_1), s1),
        row(F.lit("accuracy"), none, none, d((tp + tn) / n), n),
        row(F.lit("macro avg"), d((p0 + p1) / 2), d((r0 + r1) / 2), d((f1_0 + f1_1) / 2), n),
        row(F.lit("weighted avg"), d((p0 * s0 + p1 * s1) / n), d((r0 * s0 + r1 * s1) / n),
            d((f1_0 * s0 + f1_1 * s1) / n), n))
    return c.select(F.explode(rows).alias("r")).select("r.*")


def score_curve(scored: DataFrame, y: str = "y_true", score: str = "score",
                group_cols: list[str] | None = None) -> DataFrame:
    """(threshold, pos, neg, tps, fps, P, N) per distinct score, where tps/fps
    count rows with score >= threshold, and P/N are the class totals."""
    g = list(group_cols or [])
    # written once: buckets, running totals and class totals read it, and ``scored`` may be a whole join
    per_score = cut_lineage(scored.groupBy(*g, F.col(score).alias("threshold"))
                            .agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"),
                                 F.sum((F.col(y) != 1).cast("long")).alias("neg")))
    curve = running_totals(per_score, "threshold", ["pos", "neg"], descending=True, group_cols=g)
    curve = curve.withColumnRenamed("cum_pos", "tps").withColumnRenamed("cum_neg", "fps")
    if g:
        totals = per_score.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
        return curve.join(F.broadcast(totals), g)
    tot = per_score.agg(F.struct(F.sum("pos").alias("P"), F.sum("neg").alias("N"))).scalar()
    return curve.withColumn("P", tot["P"]).withColumn("N", tot["N"])


def _precision(tps: Column, fps: Column, empty: float) -> Column:
    return _safe_div(tps, tps + fps, empty)


def roc_curve(scored: DataFrame, **kw) -> DataFrame:
    """Every distinct threshold (no intermediate points dropped) plus the
    origin at threshold +inf."""
    c = score_curve(scored, **kw)
    pts = c.select("threshold", _safe_div(F.col("fps"), F.col("N")).alias("fpr"),
                   _safe_div(F.col("tps"), F.col("P")).alias("tpr"))
    origin = scored.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                                 F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def roc_auc(scored: DataFrame, group_cols: list[str] | None = None, **kw) -> DataFrame:
    """Exact area with ties counted half (equal to the trapezoid ROC area)."""
    g = list(group_cols or [])
    c = score_curve(scored, group_cols=g, **kw)
    below = F.col("N") - F.col("fps")          # negatives scored strictly lower
    term = F.col("pos") * (below + 0.5 * F.col("neg"))
    return c.groupBy(*g).agg((F.sum(term) / (F.first("P") * F.first("N"))).alias("roc_auc"))


def pr_curve(scored: DataFrame, **kw) -> DataFrame:
    """Precision/recall per distinct threshold plus the final point
    (precision 1, recall 0, threshold NULL)."""
    c = score_curve(scored, **kw)
    pts = c.select("threshold", _precision(F.col("tps"), F.col("fps"), 0.0).alias("precision"),
                   _safe_div(F.col("tps"), F.col("P"), 1.0).alias("recall"))
    end = scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                              F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _step_terms(c: DataFrame):
    prec = _precision(F.col("tps"), F.col("fps"), 0.0)
    prev_tps, prev_fps = F.col("tps") - F.col("pos"), F.col("fps") - F.col("neg")
    prev_prec = _precision(prev_tps, prev_fps, 1.0)   # above the top score: the (0, 1) end point
    d_recall = F.col("pos") / F.col("P")
    return prec, prev_prec, d_recall


def average_precision(scored: DataFrame, group_cols: list[str] | None = None, **kw) -> DataFrame:
    """Sum over thresholds of (R_k - R_k-1) * P_k."""
    g = list(group_cols or [])
    c = score_curve(scored, group_cols=g, **kw)
    prec, _, d_recall = _step_terms(c)
    return c.groupBy(*g).agg(F.sum(d_recall * prec).alias("average_precision"))


def pr_auc(scored: DataFrame, group_cols: list[str] | None = None, **kw) -> DataFrame:
    """Trapezoid area under the PR curve including the (recall 0, precision 1) end."""
    g = list(group_cols or [])
    c = score_curve(scored, group_cols=g, **kw)
    prec, prev_prec, d_recall = _step_terms(c)
    return c.groupBy(*g).agg(F.sum(d_recall * (prec + prev_prec) / 2).alias("pr_auc"))


def f1_curve(scored: DataFrame, **kw) -> DataFrame:
    """F1 = 2PR/(P+R+1e-6) at every threshold of the PR curve."""
    pr = pr_curve(scored, **kw).filter(F.col("threshold").isNotNull())
    return pr.withColumn("f1", 2 * F.col("precision") * F.col("recall")
                         / (F.col("precision") + F.col("recall") + F.lit(1e-6)))


def best_threshold(scored: DataFrame, **kw) -> DataFrame:
    """Threshold maximising the PR-curve F1; ties go to the lowest threshold."""
    c = f1_curve(scored, **kw)
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold")))
    return c.agg(best.alias("b")).select(F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))


def summaries(scored: DataFrame, group_cols=(), y: str = "y_true", score: str = "score", threshold: float | Column = 0.5,
              inclusive: bool = False) -> DataFrame:
    """Every metric of every group from one score curve and one aggregate:
    accuracy, precision, recall and f1 at ``threshold`` (strict ``>`` unless ``inclusive``), roc_auc,
    average_precision, pr_auc, and the best ``threshold`` with its f1."""
    g = list(group_cols)
    c = score_curve(scored, y=y, score=score, group_cols=g)
    prec, prev_prec, d_recall = _step_terms(c)
    recall = _safe_div(F.col("tps"), F.col("P"), 1.0)
    curve_f1 = 2 * prec * recall / (prec + recall + F.lit(1e-6))
    above = F.col("threshold") >= threshold if inclusive else F.col("threshold") > threshold
    agg = c.groupBy(*g).agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.first("P").alias("P"), F.first("N").alias("N"),
        (F.sum(F.col("pos") * (F.col("N") - F.col("fps") + 0.5 * F.col("neg"))) / F.nullif(F.first("P") * F.first("N"), F.lit(0))).alias("roc_auc"),
        F.sum(d_recall * prec).alias("average_precision"), F.sum(d_recall * (prec + prev_prec) / 2).alias("pr_auc"),
        F.max_by(F.struct(F.col("threshold").alias("t"), curve_f1.alias("f")), F.struct(curve_f1.alias("f"), (-F.col("threshold")).alias("t"))).alias("b"))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"), F.col("N") - F.col("fp")
    return agg.select(*g, ((tp + tn) / (F.col("P") + F.col("N"))).alias("accuracy"), _safe_div(tp, tp + fp).alias("precision"),
                      _safe_div(tp, tp + fn).alias("recall"), _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"), "roc_auc", "average_precision", "pr_auc",
                      F.col("b.t").alias("threshold"), F.col("b.f").alias("f1_at_threshold"))


def evaluate_held_out(scored: DataFrame, key: str = "row_id", fraction: float = 0.1, seed: int = 42, y: str = "y_true",
                      score: str = "score", inclusive: bool = False) -> DataFrame:
    """``evaluate`` with the threshold tuned on a stratified validation part of
    ``fraction`` of the rows, and every metric over the other rows."""
    from riskloom.operators.split import stratified_holdout
    parts = stratified_holdout(scored, label=y, key=key, fraction=fraction, seed=seed)
    return evaluate(parts.filter(~F.col("holdout")), parts.filter("holdout"), y=y, score=score, inclusive=inclusive)


def evaluate(scored: DataFrame, tune_on: DataFrame | None = None, y: str = "y_true",
             score: str = "score", inclusive: bool = False) -> DataFrame:
    """``eval_on_test``: tune the threshold on ``tune_on`` (default: the same
    frame), classify with strict ``>`` and report every metric in one row."""
    tuned = best_threshold(tune_on if tune_on is not None else scored, y=y, score=score)
    t = tuned.select("threshold").scalar()
    one = summaries(scored, y=y, score=score, threshold=t, inclusive=inclusive)
    return one.select(t.alias("threshold"), "accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "pr_auc")
