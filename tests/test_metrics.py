"""Ranking metrics: FIXTURES values, tiny exact cases, partitioning."""

import numpy as np
import pytest

from riskloom.operators import metrics as M
from riskloom.operators.ranking import running_totals
from riskloom.sources import fixtures as FX


def test_fixture_auc_and_ap(spark, sf):
    s = FX.scored(spark, sf)
    assert abs(M.roc_auc(s).first()[0] - 0.498166) < 5e-7
    assert abs(M.average_precision(s).first()[0] - 0.202016) < 5e-7


def _brute(y, p):
    pos = [s for s, t in zip(p, y) if t == 1]
    neg = [s for s, t in zip(p, y) if t == 0]
    auc = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])
    order = sorted(set(p), reverse=True)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for s, yy in zip(p, y) if s >= t and yy == 1)
        fp = sum(1 for s, yy in zip(p, y) if s >= t and yy == 0)
        r = tp / sum(y)
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return auc, ap


def test_small_ties_exact(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    p = [0.9, 0.9, 0.5, 0.3, 0.3, 0.1, 0.7, 0.7]
    df = spark.createDataFrame(list(zip(y, p)), "y_true int, score double")
    auc, ap = _brute(y, p)
    assert abs(M.roc_auc(df).first()[0] - auc) < 1e-12
    assert abs(M.average_precision(df).first()[0] - ap) < 1e-12
    bt = M.best_threshold(df).first()
    assert bt["threshold"] in p


def test_report_and_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "y_true int, y_pred int")
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    rep = {r["label"]: r for r in M.report(df).collect()}
    assert abs(rep["1"]["f1"] - 0.5) < 1e-12 and rep["accuracy"]["f1"] == 0.6


def test_empty_denominators_give_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    f = M.f1(df).first()
    assert (f["precision"], f["recall"], f["f1"]) == (0.0, 0.0, 0.0)


def test_running_totals_match_cumsum(spark):
    rng = np.random.default_rng(0)
    vals = rng.choice(10_000, size=3000, replace=False).astype(float)
    w = rng.integers(0, 5, size=3000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(vals, w)], "v double, w long").repartition(7)
    got = {r["v"]: r["cum_w"] for r in running_totals(df, "v", ["w"], rows=20).collect()}
    order = np.argsort(vals)
    cum = np.cumsum(w[order])
    assert all(got[vals[i]] == c for i, c in zip(order, cum))


def test_position_within_hot_group(spark):
    """A class holding 99% of the rows gets dense, unique positions without
    a single-partition window, and folds stay within one row of each other."""
    from pyspark.sql import functions as F
    from riskloom.operators.ranking import position_within
    from riskloom.operators.split import seeded_int, stratified_folds
    df = spark.range(20000).withColumn("label", (F.col("id") % 100 == 0).cast("int"))
    pos = position_within(df.withColumn("_h", seeded_int(7, "id")), ["label"], ["_h", "id"], rows=20)
    stats = {r["label"]: r for r in pos.groupBy("label").agg(
        F.count("*").alias("n"), F.countDistinct("_pos").alias("d"), F.min("_pos").alias("lo"),
        F.max("_pos").alias("hi")).collect()}
    for r in stats.values():
        assert r["d"] == r["n"] and r["lo"] == 0 and r["hi"] == r["n"] - 1
    folds = stratified_folds(df, label="label", key="id", k=5)
    sizes = {}
    for r in folds.groupBy("label", "fold").count().collect():
        sizes.setdefault(r["label"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in sizes.values())


def test_threshold_tuned_on_held_out_rows(spark):
    """The validation part tunes; every metric is over the other rows."""
    rng = np.random.default_rng(9)
    rows = [(i, int(y), float(np.round(np.clip(0.3 * y + rng.random() * 0.7, 0, 1), 3))) for i, y in enumerate(rng.random(400) < 0.3)]
    df = spark.createDataFrame(rows, "row_id long, y_true int, score double")
    from riskloom.operators.split import stratified_holdout
    parts = stratified_holdout(df, label="y_true", key="row_id", fraction=0.25).toPandas()
    val, rest = parts[parts.holdout], parts[~parts.holdout]
    got = M.evaluate_held_out(df, fraction=0.25).first()

    def f1(t):
        p = val.score >= t
        tp = (p & (val.y_true == 1)).sum()
        a, b = tp / p.sum(), tp / (val.y_true == 1).sum()
        return 2 * a * b / (a + b + 1e-6)
    best = max(sorted(val.score.unique()), key=f1)
    assert got.threshold == best
    assert got.accuracy == pytest.approx(((rest.score > best) == (rest.y_true == 1)).mean())


def test_scores_are_computed_once(spark):
    """A score may be a whole neighbour join or model: no metric pass evaluates it again."""
    seen = spark.sparkContext.accumulator(0)

    def scores(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(i % 2, (i * 7 % 10) / 10) for i in range(60)]
    scored = spark.createDataFrame(rows, "y_true int, score double").mapInArrow(scores, "y_true int, score double")
    got = M.summaries(scored).first()
    assert seen.value == 60 and got.accuracy is not None
