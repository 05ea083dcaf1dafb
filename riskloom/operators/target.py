"""Risk labels: quantile threshold on default_prop, and the composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.credit_exprs import label_name

COMPOSITE_METRICS = ("weighted_default_prop", "default_prop",
                     "weighted_default_prop_tenure_norm",
                     "weighted_default_prop_vintage_norm")


def quantile_threshold(df: DataFrame, col: str = "default_prop", q: float = 0.8) -> Column:
    """Exact linear-interpolated quantile (pandas ``quantile``) as a lazy
    scalar subquery. ``percentile`` keeps a value -> count map, which is
    bounded here: ``default_prop`` is a ratio of two small integers (rows
    per customer are bounded by the months covered). For continuous
    columns use ``ranking.quantiles``."""
    return df.agg(F.percentile(F.col(col), q)).scalar()


def create_target(df: DataFrame, threshold: Column | float | None = None,
                  col: str = "default_prop", q: float = 0.8,
                  out: str = "multi_dim_target") -> tuple[DataFrame, Column]:
    """Label = ``col > threshold`` (strict; NULL counts as 0). When no
    threshold is given it is the ``q`` quantile of ``df`` itself; pass the
    training threshold to label a test frame consistently."""
    t = quantile_threshold(df, col, q) if threshold is None else (
        threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    labelled = (df.withColumn(out, F.coalesce(F.col(col) > t, F.lit(False)).cast("int"))
                .withColumn("customer_label", label_name(out)))
    return labelled, t


def composite_target(df: DataFrame, scaling: str = "quantile",
                     weights: dict[str, float] | None = None, q: float = 0.8, fit_on: DataFrame | None = None,
                     threshold: Column | float | None = None) -> tuple[DataFrame, Column]:
    """Weighted sum of the four scaled default metrics; label when above its
    own ``q`` quantile, or above ``threshold``. ``scaling`` is 'robust',
    'rank_pct' (the reference's manual quantile) or 'quantile'; any other value is an
    error. ``fit_on`` gives the rows whose statistics scale ``df`` (a value between two of their
    ranks takes the place between them; 'rank_pct' ranks within ``df`` always)."""
    from riskloom.operators import scale
    from riskloom.operators.ranking import quantiles
    from riskloom.session import cut_lineage
    weights = weights or {m: 1 / len(COMPOSITE_METRICS) for m in COMPOSITE_METRICS}
    cols = list(weights)
    df = cut_lineage(df)  # several passes follow
    if scaling == "robust":
        scaled = scale.scale_robust(df, cols, fit_on=fit_on)
    elif scaling in ("rank_pct", "manual_quantile"):
        scaled = scale.scale_rank_pct(df, cols)
    elif scaling == "quantile":
        scaled = scale.scale_quantile(df, cols, fit_on=fit_on)
    else:
        raise ValueError(f"unknown scaling {scaling!r}")
    score = None
    for c, w in weights.items():
        term = F.col(f"{c}_scaled") * F.lit(float(w))
        score = term if score is None else score + term
    # written once: its quantile and its label read the same numbers
    scored = cut_lineage(scaled.withColumn("composite_risk_score", score))
    if threshold is None:
        t = quantiles(scored, "composite_risk_score", [q])[0]
        threshold = F.lit(t).cast("double")
    return create_target(scored, threshold=threshold, col="composite_risk_score", q=q)
