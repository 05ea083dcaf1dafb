"""Vintage split of accounts by the origination-month CDF, and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.credit import distinct_accounts


def month_counts(accounts: DataFrame) -> DataFrame:
    """Accounts per origination month, ascending."""
    return (accounts.groupBy("origination_month")
            .agg(F.count(F.lit(1)).alias("n_accounts"))
            .orderBy("origination_month"))


def origination_cdf(accounts: DataFrame) -> DataFrame:
    """Running share of accounts by origination month.

    The input is grouped by a month offset, so it has at most one row per
    calendar month; the global window over it runs in one small task."""
    counts = accounts.groupBy("origination_month").agg(F.count(F.lit(1)).alias("n_accounts"))
    w = Window.orderBy("origination_month").rowsBetween(Window.unboundedPreceding, 0)
    return (counts
            .withColumn("cum_accounts", F.sum("n_accounts").over(w))
            .withColumn("cdf", F.col("cum_accounts") / F.sum("n_accounts").over(Window.partitionBy())))


def cdf_cutoff(accounts: DataFrame, share: float = 0.8) -> Column:
    """Scalar subquery: the first origination month whose CDF reaches ``share``."""
    cdf = origination_cdf(accounts)
    return cdf.filter(F.col("cdf") >= share).agg(F.min("origination_month")).scalar()


def assign_split(accounts: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds ``split`` = 'old' (origination month <= cutoff) or 'new' to a
    frame with one row per account and its ``origination_month``.

    The cutoff is a scalar subquery evaluated once and inlined as a literal,
    so the split itself is a narrow projection with no join."""
    cutoff = cdf_cutoff(accounts.select("id", "origination_month"), share)
    return accounts.withColumn(
        "split", F.when(F.col("origination_month") <= cutoff, "old").otherwise("new"))


def split_accounts(credit: DataFrame, share: float = 0.8) -> DataFrame:
    """(id, origination_month, split) straight from raw credit rows."""
    return assign_split(distinct_accounts(credit), share)


def split_credit(credit: DataFrame, accounts: DataFrame, split: str) -> DataFrame:
    """All raw credit rows of the accounts in one split (a semi-join)."""
    ids = accounts.filter(F.col("split") == split).select("id")
    return credit.join(ids, "id", "left_semi")


def split_applications(applications: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Application rows of old and new accounts (two semi-joins)."""
    old = accounts.filter(F.col("split") == "old").select("id")
    new = accounts.filter(F.col("split") == "new").select("id")
    return (applications.join(old, "id", "left_semi"),
            applications.join(new, "id", "left_semi"))


def split_report(accounts: DataFrame) -> DataFrame:
    """One row: counts, percentages and old/new ratio."""
    is_old = (F.col("split") == "old").cast("long")
    return (accounts.agg(F.count(F.lit(1)).alias("total_accounts"),
                         F.sum(is_old).alias("old_accounts"),
                         F.sum(1 - is_old).alias("new_accounts"))
            .select("total_accounts", "old_accounts", "new_accounts",
                    (F.col("old_accounts") * 100.0 / F.col("total_accounts")).alias("old_pct"),
                    (F.col("new_accounts") * 100.0 / F.col("total_accounts")).alias("new_pct"),
                    (F.col("old_accounts") / F.nullif(F.col("new_accounts"), F.lit(0))).alias("old_new_ratio")))


# ---------------------------------------------------------------- folds
def seeded_unit(seed: int, *keys) -> Column:
    """Deterministic draw in [0, 1) from md5(seed|key...): independent of
    partitioning and reproducible in any SQL engine with md5."""
    s = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long") / F.lit(float(1 << 60))


def seeded_int(seed: int, *keys) -> Column:
    s = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


def stratified_folds(df: DataFrame, label: str = "label", key: str = "id",
                     k: int = 5, seed: int = 42) -> DataFrame:
    """Shuffled stratified k-fold: within each class, rows are ordered by a
    seeded hash and dealt round-robin, so fold sizes differ by at most one
    per class. Adds ``fold`` (0..k-1).

    The position within a class comes from a distributed rank (range
    partitioning + per-partition offsets), never from a single-partition
    window, so a class holding most rows still spreads over all tasks."""
    from riskloom.operators.ranking import position_within
    ranked = position_within(df.withColumn("_h", seeded_int(seed, key)), [label], ["_h", key])
    return ranked.withColumn("fold", (F.col("_pos") % k).cast("int")).drop("_h", "_pos")


def stratified_holdout(df: DataFrame, label: str = "label", key: str = "id",
                       fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``holdout`` (bool): the first ceil(fraction*n_class) rows of
    each class in seeded-hash order."""
    from riskloom.operators.ranking import position_within
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = position_within(df.withColumn("_h", seeded_int(seed, key)), [label], ["_h", key])
    return (ranked.join(F.broadcast(sizes), label)
            .withColumn("holdout", F.col("_pos") < F.ceil(F.col("_n") * fraction))
            .drop("_h", "_pos", "_n"))
