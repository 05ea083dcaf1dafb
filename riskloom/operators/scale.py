"""Scalers: fit on one frame, apply to any frame with the same columns.

Fitted statistics are one-row aggregates used as scalar subqueries (Spark
merges subqueries over the same relation into one job), so applying a
scaler is a narrow projection: no join and no shuffle of the data."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranking import exact_quantiles_of, running_totals, value_counts
from riskloom.session import cut_lineage

_EPS10 = 10 * np.finfo(np.float64).eps  # a scale below this counts as zero


def _nonzero_scale(s: Column) -> Column:
    return F.when(s.isNull() | (F.abs(s) < _EPS10), F.lit(1.0)).otherwise(s)


def fit_standard(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column: one aggregate job whose single
    row (2 numbers per column) is the fitted state."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mu_{c}"), F.stddev_pop(x).alias(f"sd_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"mu_{c}"], row[f"sd_{c}"]) for c in cols}


def _scale_value(sd) -> float:
    return 1.0 if sd is None or abs(sd) < _EPS10 else float(sd)


def apply_standard(df: DataFrame, cols: list[str], stats: dict, suffix: str = "") -> DataFrame:
    out = {}
    for c in cols:
        mu, sd = stats[c]
        out[f"{c}{suffix}"] = (F.col(c) - F.lit(float(mu) if mu is not None else None)) / F.lit(_scale_value(sd))
    return df.withColumns(out)


def scale_standard(train: DataFrame, test: DataFrame, cols: list[str],
                   drop_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """``scaling_std``: standardise ``cols`` with train mean and population
    std (zero std -> 1) on both frames. The row key is kept unless
    ``drop_id`` (Spark has no index to carry row identity)."""
    stats = fit_standard(train, cols)
    a, b = apply_standard(train, cols, stats), apply_standard(test, cols, stats)
    if drop_id:
        a, b = a.drop("id"), b.drop("id")
    return a, b


def scale_robust(df: DataFrame, cols: list[str], suffix: str = "_scaled",
                 fit_on: DataFrame | None = None) -> DataFrame:
    """(x - median) / (q75 - q25), linear quantiles, zero IQR -> 1."""
    found = exact_quantiles_of(fit_on if fit_on is not None else df, {c: [0.25, 0.5, 0.75] for c in cols})
    out = {}
    for c in cols:
        q25, q50, q75 = found[c]
        iqr = None if q75 is None else q75 - q25
        out[f"{c}{suffix}"] = (F.col(c) - F.lit(q50)) / F.lit(_scale_value(iqr))
    return df.withColumns(out)


def scale_rank_pct(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """Join each row to its value's percentile rank: pandas ``rank(pct=True)``, average ties.

    All columns share one (column, value, count) table and one bucketed running
    total; whether a column's part of it is broadcast is left to adaptive execution."""
    counts = cut_lineage(value_counts(df, cols))
    cum = running_totals(counts, "_v", ["_c"], group_cols=["_col"])
    n = counts.groupBy("_col").agg(F.sum("_c").alias("_n"))
    table = cut_lineage(cum.join(n, "_col").select("_col", "_v", ((F.col("cum__c") - F.col("_c") + (F.col("_c") + 1) / 2.0) / F.col("_n")).alias("_pct")))
    out = df
    for c in cols:
        t = table.filter(F.col("_col") == c).select("_v", F.col("_pct").alias(f"{c}{suffix}"))
        out = out.withColumn("_v", F.col(c).cast("double")).join(t, "_v", "left").drop("_v")
    return out


BOUND = 1e-7


def apply_quantile(df: DataFrame, col: str, knots: list[tuple[float, float, float]], out: str) -> DataFrame:
    """Uniform quantile transform: a value equal to a knot maps to the middle
    of its tied references; values between knots interpolate linearly from
    the left knot's last reference to the right knot's first; values at or
    beyond the ends map to 0 and 1. A value's knots are found by Bucketizer's binary
    search (JVM) and one join with the knot table, which is broadcast: it has at
    most ``n_quantiles`` rows."""
    x = F.col(col).cast("double")
    known = x.isNotNull() & ~F.isnan(x)
    if len(knots) == 1:
        return df.withColumn(out, F.when(known, F.lit(0.0)))
    qs = [k[0] for k in knots]
    after = [*knots[1:], (None, None, None)]
    rows = [(float(j + 1), q, lo, hi, r[0], r[1]) for j, ((q, lo, hi), r) in enumerate(zip(knots, after))]
    table = df.sparkSession.createDataFrame(rows, "_qb double, _ql double, _lo double, _hi double, _qr double, _rlo double")
    bucket = Bucketizer(splits=[float("-inf"), *qs, float("inf")], inputCol="_qx", outputCol="_qb")
    placed = bucket.transform(df.withColumn("_qx", F.when(known, x).otherwise(F.lit(0.0)))).join(F.broadcast(table), "_qb", "left")
    inner = F.when(F.col("_qx") == F.col("_ql"), (F.col("_lo") + F.col("_hi")) / 2).otherwise(
        F.col("_hi") + (F.col("_qx") - F.col("_ql")) * (F.col("_rlo") - F.col("_hi")) / (F.col("_qr") - F.col("_ql")))
    val = F.when(known, F.when(x - BOUND < qs[0], F.lit(0.0)).when(x + BOUND > qs[-1], F.lit(1.0)).otherwise(inner))
    return placed.withColumn(out, val).drop("_qx", "_qb", "_ql", "_lo", "_hi", "_qr", "_rlo")


def fit_quantile_knots(df: DataFrame, cols: list[str], n_quantiles: int = 1000) -> dict[str, list[tuple[float, float, float]]]:
    """Quantiles at ``n_quantiles`` evenly spaced references (at most one per value), as
    knots (q, first_ref, last_ref) per distinct quantile, for all columns from one table."""
    refs: dict[str, list[float]] = {}

    def spaced(c: str):
        def at(n: int) -> list[float]:
            refs[c] = list(np.linspace(0, 1, max(1, min(n_quantiles, n))))
            return refs[c]
        return at

    found = exact_quantiles_of(df, {c: spaced(c) for c in cols})
    out = {}
    for c in cols:
        knots: dict[float, list[float]] = {}
        for q, r in zip(found[c], refs[c]):
            if q is not None:
                knots.setdefault(float(q), [float(r), float(r)])[1] = float(r)
        out[c] = [(q, lo, hi) for q, (lo, hi) in sorted(knots.items())]
    return out


def scale_quantile(df: DataFrame, cols: list[str], suffix: str = "_scaled",
                   n_quantiles: int = 1000, fit_on: DataFrame | None = None) -> DataFrame:
    knots = fit_quantile_knots(fit_on if fit_on is not None else df, cols, n_quantiles)
    out = df
    for c in cols:
        out = apply_quantile(out, c, knots[c], f"{c}{suffix}") if knots[c] else \
            out.withColumn(f"{c}{suffix}", F.lit(None).cast("double"))
    return out
