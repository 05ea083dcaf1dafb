"""Credit-record aggregation: customer-level risk features.

Plan shape (per customer ``id``):

1. ``monthly_series``: raw rows -> one row per (id, months_balance) with
   row and default counts. A grouped aggregate with map-side combine, so
   duplicate rows collapse before they are shuffled and no customer can
   hold more rows than there are distinct months.
2. Order-dependent features (streaks, trailing defaults, decay by position)
   use a window partitioned by ``id`` over that bounded monthly series;
   the following ``groupBy("id")`` reuses the window's partitioning.
3. Statistics over vintages use a grouped aggregate whose key is a month
   offset, so the result is bounded by the calendar and safe to broadcast.

Within one month, rows are ordered non-defaults first (an explicit
tie-break; with one status per customer and month it never matters).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.credit_exprs import (
    default_flag, is_default_code, status_code, status_days)


def monthly_series(credit: DataFrame) -> DataFrame:
    """(id, months_balance, n_rows, n_default, max_code)."""
    code = status_code("status")
    return (credit
            .select("id", "months_balance",
                    default_flag("status").alias("_def"),
                    is_default_code(code).alias("_bad"),
                    code.alias("_code"))
            .groupBy("id", "months_balance")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum("_def").alias("n_default"),
                 F.sum("_bad").alias("n_bad"),
                 F.max("_code").alias("max_code")))


def origination_month(credit: DataFrame) -> DataFrame:
    """Every raw row with its customer's first month attached.

    The per-id minimum is a grouped aggregate joined back on ``id``; a hot
    id is split by AQE's skew-join handling instead of one window task."""
    first = credit.groupBy("id").agg(F.min("months_balance").alias("origination_month"))
    return credit.join(first, "id")


def distinct_accounts(credit: DataFrame) -> DataFrame:
    """Distinct (id, origination_month)."""
    return credit.groupBy("id").agg(F.min("months_balance").alias("origination_month"))


def _by_id_month():
    return Window.partitionBy("id").orderBy("months_balance")


def _position_decay(monthly: DataFrame, decay: float) -> DataFrame:
    """Adds ``_wdef``: this month's share of sum(flag * exp(-d * k)), where
    k counts rows after a row in month order (newest row has weight 1)."""
    if decay == 0:
        return monthly.withColumn("_wdef", F.col("n_default").cast("double"))
    after = F.coalesce(
        F.sum("n_rows").over(_by_id_month().rowsBetween(1, Window.unboundedFollowing)),
        F.lit(0))
    # defaults sit last within their month: positions after..after+n_def-1
    q = math.exp(-decay)
    return monthly.withColumn(
        "_wdef",
        F.exp(F.lit(-decay) * after)
        * (F.lit(1.0) - F.pow(F.lit(q), F.col("n_default"))) / F.lit(1.0 - q))


WEIGHT_PLACES = 14


def exact_sum(term, places: int = 25) -> "F.Column":
    """Sum that does not hang on the order of its terms: fixed-point, each term to
    ``places`` decimals. Customers with equal histories get equal sums in every run."""
    return F.sum(term.cast(f"decimal(38,{places})")).cast("double")


def customer_aggregates(credit: DataFrame | None, decay: float = 0.1,
                        decay_mode: str = "position", monthly: DataFrame | None = None) -> DataFrame:
    """Per customer: origination_month, tenure, default_prop,
    weighted_default_prop, risk_score.

    ``decay_mode='position'``: weights exp(-d*k) by row position from the
    newest row; ``'month'``: weights exp(-d*|months_balance|)."""
    monthly = monthly if monthly is not None else monthly_series(credit)
    n = F.sum("n_rows")
    nd = F.sum("n_default")
    if decay_mode == "position":
        monthly = _position_decay(monthly, decay)
        if decay == 0:
            weighted = nd / n
        else:
            q = math.exp(-decay)
            weighted = exact_sum(F.col("_wdef"), WEIGHT_PLACES) / F.round((F.lit(1.0) - F.pow(F.lit(q), n)) / F.lit(1.0 - q), WEIGHT_PLACES)
    elif decay_mode == "month":
        w = F.exp(F.lit(-decay) * F.abs(F.col("months_balance")))
        weighted = exact_sum(F.col("n_default") * w, WEIGHT_PLACES) / exact_sum(F.col("n_rows") * w, WEIGHT_PLACES)
    else:
        raise ValueError(f"decay_mode must be 'position' or 'month', got {decay_mode!r}")
    return (monthly.groupBy("id")
            .agg(F.min("months_balance").alias("origination_month"),
                 n.alias("tenure"),
                 (nd / n).alias("default_prop"),
                 weighted.alias("weighted_default_prop"),
                 (nd * F.log1p(n)).alias("risk_score")))


def with_tenure_norm(customers: DataFrame) -> DataFrame:
    return customers.withColumn(
        "weighted_default_prop_tenure_norm",
        F.col("weighted_default_prop") / F.log1p("tenure"))


def with_vintage(customers: DataFrame) -> DataFrame:
    return customers.withColumn("vintage", F.abs("origination_month"))


def with_vintage_zscore(customers: DataFrame, col: str = "weighted_default_prop",
                        out: str = "weighted_default_prop_vintage_norm") -> DataFrame:
    """(x - mean) / (sample std + 1e-6) within each vintage.

    The per-vintage statistics are keyed by a month offset, so the table is
    bounded by the calendar span, not by the data: broadcast is safe. A
    vintage holding a third of all customers costs nothing extra because
    its statistics come from a partial aggregate. A single-customer vintage
    has NULL std (pandas NaN), so its z-score is NULL."""
    x = F.col(col)
    sums = customers.groupBy("vintage").agg(F.count(col).alias("_n"), exact_sum(x).alias("_s"), exact_sum(x * x).alias("_q"))
    # from sums that are the same in every run, so that equal customers stay equal
    variance = F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / F.nullif(F.col("_n"), F.lit(0))) / F.nullif(F.col("_n") - 1, F.lit(0)), F.lit(0.0))
    stats = sums.select("vintage", (F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias("_mu"), F.when(F.col("_n") > 1, F.sqrt(variance)).alias("_sd"))
    return (customers.join(F.broadcast(stats), "vintage", "left")
            .withColumn(out, (F.col(col) - F.col("_mu")) / (F.col("_sd") + F.lit(1e-6)))
            .drop("_mu", "_sd"))


def clean_credit(credit: DataFrame | None, decay: float = 0.1, decay_mode: str = "position",
                 monthly: DataFrame | None = None) -> DataFrame:
    """``clean_credit_records``: one row per customer with all aggregates."""
    # one row per customer, read by both sides of the vintage statistics
    # join (and usually by the split and target steps): persist it once
    # instead of recomputing the aggregation from raw rows per consumer
    c = customer_aggregates(credit, decay, decay_mode, monthly).persist(StorageLevel.MEMORY_AND_DISK)
    c = with_vintage(with_tenure_norm(c))
    c = with_vintage_zscore(c)
    return c.select("id", "origination_month", "tenure", "default_prop",
                    "weighted_default_prop", "risk_score",
                    "weighted_default_prop_tenure_norm", "vintage",
                    "weighted_default_prop_vintage_norm")


def _segments(monthly: DataFrame) -> DataFrame:
    """Run-length segments of the row sequence: per month a block of
    non-default rows, then a block of default rows (empty blocks dropped)."""
    seg = F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), (F.col("n_rows") - F.col("n_bad")).alias("len")),
        F.struct(F.lit(1).alias("kind"), F.col("n_bad").alias("len"))))
    return (monthly.select("id", "months_balance", "max_code", seg.alias("s"))
            .select("id", "months_balance", "max_code", "s.kind", "s.len")
            .filter(F.col("len") > 0))


def streak_islands(credit: DataFrame) -> DataFrame:
    """Gaps-and-islands: one row per (id, island) with its kind and length."""
    segs = _segments(monthly_series(credit))
    w = Window.partitionBy("id").orderBy("months_balance", "kind")
    change = F.when(F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind")), 1).otherwise(0)
    return (segs.withColumn("_chg", change)
            .withColumn("island", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("id", "island")
            .agg(F.first("kind").alias("is_default"), F.sum("len").alias("streak_length")))


def longest_streaks(islands: DataFrame) -> DataFrame:
    """Longest run of each kind per id; a kind that never occurs -> 0."""
    return islands.groupBy("id").agg(
        F.coalesce(F.max(F.when(F.col("is_default") == 0, F.col("streak_length"))), F.lit(0))
        .cast("long").alias("longest_non_default_streak"),
        F.coalesce(F.max(F.when(F.col("is_default") == 1, F.col("streak_length"))), F.lit(0))
        .cast("long").alias("longest_default_streak"))


def feature_engineer(credit: DataFrame | None, last_rows: int = 6, monthly: DataFrame | None = None) -> DataFrame:
    """Delinquency features per id: max_days_past_due,
    longest_(non_)default_streak, consecutive_defaults_6m,
    recency_last_bad_status (-1 when the id never defaulted)."""
    monthly = monthly if monthly is not None else monthly_series(credit)
    segs = _segments(monthly)
    w = Window.partitionBy("id").orderBy("months_balance", "kind")
    prev = F.lag("kind").over(w)
    islands = (segs
               .withColumn("_chg", F.when(prev.isNull() | (prev != F.col("kind")), 1).otherwise(0))
               .withColumn("island", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
               .groupBy("id", "island")
               .agg(F.first("kind").alias("kind"), F.sum("len").alias("len"),
                    F.max("months_balance").alias("_last_month"),
                    F.max("max_code").alias("_code")))
    last = F.max_by(F.struct("kind", "len"), "island")
    per_id = islands.groupBy("id").agg(
        F.max("_code").alias("_max_code"),
        F.coalesce(F.max(F.when(F.col("kind") == 0, F.col("len"))), F.lit(0)).alias("longest_non_default_streak"),
        F.coalesce(F.max(F.when(F.col("kind") == 1, F.col("len"))), F.lit(0)).alias("longest_default_streak"),
        last.alias("_tail"),
        F.max("_last_month").alias("_max_month"),
        F.max(F.when(F.col("kind") == 1, F.col("_last_month"))).alias("_max_bad_month"))
    trailing = F.when(F.col("_tail.kind") == 1, F.least(F.col("_tail.len"), F.lit(last_rows))).otherwise(0)
    return per_id.select(
        "id",
        status_days("_max_code").alias("max_days_past_due"),
        F.col("longest_non_default_streak").cast("long").alias("longest_non_default_streak"),
        F.col("longest_default_streak").cast("long").alias("longest_default_streak"),
        trailing.cast("long").alias("consecutive_defaults_6m"),
        F.coalesce(F.abs(F.col("_max_bad_month") - F.col("_max_month")), F.lit(-1))
        .cast("long").alias("recency_last_bad_status"))
