"""Summaries over result tables (one row per fold / model / setting)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cv_summary(folds: DataFrame, metrics: list[str], best_by: str, fold_col: str = "fold") -> DataFrame:
    """Mean of each metric over folds (NULL/NaN ignored, like ``nanmean``)
    and the fold with the highest ``best_by``."""
    aggs = [F.avg(F.when(~F.isnan(F.col(m)), F.col(m))).alias(m) for m in metrics]
    return folds.agg(*aggs, F.max_by(fold_col, best_by).alias("best_fold"))


def rank_summary(results: DataFrame, metric: str, n: int = 1, tie_break: str | None = None) -> DataFrame:
    """Top ``n`` rows by ``metric`` (a top-k report: the limit is the feature)."""
    order = [F.col(metric).desc()] + ([F.col(tie_break).asc()] if tie_break else [])
    return results.orderBy(*order).limit(n)
