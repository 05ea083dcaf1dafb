"""Global order without a single-partition window.

Positions and running totals over a total order are computed in buckets:
rows are assigned to monotone buckets of the order key, per-bucket totals
give each bucket its offset, and a window partitioned by bucket finishes the
job. The number of buckets comes from the data: a bucket holds about
``ROWS`` rows whatever the table's size (tests: ten times the rows, the same
rows per task). Offsets join on the key the window is partitioned by, so a large offset table costs no
further shuffle and a small one is broadcast by adaptive execution.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage, ship_package

ROWS = 250_000  # rows of a bucket, about
PROBES = 256
HASH_SPACE = float(1 << 60)  # order keys from ``seeded_int`` lie in [0, 2^60)


def hash_bucket(df: DataFrame, col: str, rows: int = ROWS) -> DataFrame:
    """``_bkt``: equal-width buckets of a uniform 60-bit hash, about ``rows`` rows each."""
    n_buckets = F.greatest(F.lit(1), F.ceil(df.agg(F.count(F.lit(1))).scalar() / rows))
    return df.withColumn("_bkt", F.least(F.floor(F.col(col) / HASH_SPACE * n_buckets), n_buckets - 1).cast("long"))


def position_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                    rows: int = ROWS, out: str = "_pos", uniform: bool = True) -> DataFrame:
    """0-based position of each row within ``group_cols`` in ``order_cols``
    order. ``order_cols[0]`` must be a uniform 60-bit hash (``seeded_int``),
    so equal-width buckets of it are balanced, or with ``uniform=False`` any number without nulls."""
    b = hash_bucket(df, order_cols[0], rows) if uniform else value_bucket(df, order_cols[0], rows)
    sizes = b.groupBy(*group_cols, "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    w_off = Window.partitionBy(*group_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_bn").over(w_off), F.lit(0))).drop("_bn")
    w = Window.partitionBy(*group_cols, "_bkt").orderBy(*order_cols)
    keys = [*group_cols, "_bkt"]
    offsets = offsets.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_off")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]  # a null group is a group
    return (b.join(offsets, same).drop(*[f"_k{i}" for i in range(len(keys))])
            .withColumn(out, F.col("_off") + F.row_number().over(w) - 1)
            .drop("_bkt", "_off"))


def value_bucket(df: DataFrame, col: str, rows: int = ROWS) -> DataFrame:
    """``_bkt``: monotone buckets of ``col`` of about ``rows`` rows each. One job reads the
    row count and a sketch of the values; only borders reach the driver."""
    key = F.col(col).cast("double")
    probes = [i / PROBES for i in range(1, PROBES)]
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, probes, 10 * PROBES).alias("q")).first()
    n_buckets = max(1, math.ceil(seen["n"] / rows))
    if n_buckets == 1:
        return df.withColumn("_bkt", F.lit(0.0))
    if n_buckets <= PROBES:
        borders = [seen["q"][i * PROBES // n_buckets - 1] for i in range(1, n_buckets)]
    else:
        borders = df.withColumn("_key", key).approxQuantile("_key", [i / n_buckets for i in range(1, n_buckets)], 1.0 / (4 * n_buckets))
    inner = sorted({q for q in borders if q is not None}) or [0.0]
    split = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_key", outputCol="_bkt")
    return split.transform(df.withColumn("_key", key)).drop("_key")


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str],
                   descending: bool = False, rows: int = ROWS,
                   prefix: str = "cum_", group_cols: list[str] | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_col`` order,
    separately per ``group_cols`` (bounded number of groups, e.g. folds).

    ``df`` must hold one row per distinct (group, ``order_col``) value
    (aggregate first, which also removes any hot value)."""
    g = list(group_cols or [])
    b = value_bucket(df, order_col, rows)
    if descending:
        b = b.withColumn("_bkt", -F.col("_bkt"))
    totals = b.groupBy(*g, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w_off = Window.partitionBy(*g).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, "_bkt", *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}")
                                          for c in sum_cols])
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*g, "_bkt").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(offsets, [*g, "_bkt"])
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_o_{c}") + F.sum(c).over(w))
    return out.select(*df.columns, *[f"{prefix}{c}" for c in sum_cols])


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(_col, _v, _c): the distinct values of several columns with their counts, in
    one aggregate; nulls and NaN are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols]))
    return (df.select(pairs.alias("_p")).select("_p._col", "_p._v").filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
            .groupBy("_col", "_v").agg(F.count(F.lit(1)).alias("_c")))


def exact_quantiles_of(df: DataFrame, probs: dict, rows: int = ROWS, lower: bool = False) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles (pandas/numpy 'linear'; with ``lower``, numpy 'lower': the value at
    the rank below) of several columns at once: one table of distinct values, one running total, one lookup of the
    at most 2 x len(probs) target ranks of each column. ``probs`` maps a
    column to its probabilities, or to a function of its number of values. Only the values asked
    for reach the driver; no task holds a value map of a column (Spark's
    exact ``percentile`` merges one in a single task)."""
    ship_package(df.sparkSession)
    counts = cut_lineage(value_counts(df, list(probs)))  # the one pass over ``df``
    cum = cut_lineage(running_totals(counts, "_v", ["_c"], rows=rows, group_cols=["_col"]))
    n = {r["_col"]: r["n"] for r in cum.groupBy("_col").agg(F.max("cum__c").alias("n")).collect()}
    asked = {c: p(n.get(c, 0)) if callable(p) else p for c, p in probs.items()}
    place = {c: [p * (n[c] - 1) for p in asked[c]] for c in asked if c in n}
    targets = {c: np.unique([f(t) for t in ts for f in (math.floor, math.ceil)]) for c, ts in place.items()}

    def lookup(batches):
        for b in batches:
            col, v, c, end = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for name in np.unique(col).tolist():
                at = np.flatnonzero(col == name)
                lo, hi = (np.searchsorted(targets[name], x) for x in (end[at] - c[at], end[at]))  # ranks end - c .. end - 1
                hit = np.repeat(at, hi - lo)
                rank = targets[name][np.concatenate([np.arange(i, j) for i, j in zip(lo, hi)]).astype(int)] if len(hit) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(rank, pa.int64()), pa.array(v[hit], pa.float64())], names=["c", "t", "v"])

    found = cum.select("_col", "_v", "_c", "cum__c").mapInArrow(lookup, "c string, t long, v double").collect() if targets else []
    at = {(r["c"], r["t"]): r["v"] for r in found}
    out: dict = {}
    for c, ps in asked.items():
        out[c] = [None] * len(ps)
        for i, t in enumerate(place.get(c, [])):
            lo, hi = math.floor(t), math.ceil(t)
            out[c][i] = at[c, lo] if lower else at[c, lo] + (t - lo) * (at[c, hi] - at[c, lo])
    return out


def quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of one column, by the same plan at every size."""
    return exact_quantiles_of(df, {col: probs})[col]
