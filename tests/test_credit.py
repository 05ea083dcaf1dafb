"""Credit aggregation against the values fixed in FIXTURES.md, and unit
tests on tiny literal frames for the behaviour notes of SURVEY 2.2/2.6."""

import math

from pyspark.sql import functions as F

from riskloom.operators import credit as K
from riskloom.operators import split as P
from riskloom.plans import pipeline as PL
from riskloom.sources import fixtures as FX


def test_fixture_expected_values(spark, sf):
    cr = FX.credit_record(spark, sf)
    assert cr.count() == 14060
    acc = P.split_accounts(cr)
    counts = {r["split"]: r["count"] for r in acc.groupBy("split").count().collect()}
    assert counts == {"old": 1211, "new": 289}
    cut = P.origination_cdf(K.distinct_accounts(cr)).filter("cdf >= 0.8").agg(F.min("origination_month")).first()[0]
    assert cut == -67
    old, new = PL.labelled_customers(cr)
    assert abs(old.agg(F.percentile("default_prop", 0.8)).first()[0] - 0.3) < 1e-12
    assert abs(new.agg(F.percentile("default_prop", 0.8)).first()[0] - 1 / 3) < 1e-9
    fe = K.feature_engineer(cr).agg(*[F.sum(c) for c in [
        "longest_non_default_streak", "longest_default_streak", "consecutive_defaults_6m",
        "recency_last_bad_status"]]).first()
    assert tuple(fe) == (8056, 1725, 380, 25659)


def _credit(spark, rows):
    return spark.createDataFrame(rows, "id long, months_balance int, status string")


def test_decay_by_position_matches_row_sum(spark):
    rows = [(1, -4, "0"), (1, -3, "2"), (1, -2, "X"), (1, -1, "3"), (1, 0, "C"), (2, -1, "5"), (3, 0, "1")]
    got = {r["id"]: r["weighted_default_prop"] for r in
           K.customer_aggregates(_credit(spark, rows), 0.1, "position").collect()}
    flags = [0, 1, 0, 1, 0]
    w = [math.exp(-0.1 * (len(flags) - 1 - i)) for i in range(len(flags))]
    assert abs(got[1] - sum(f * x for f, x in zip(flags, w)) / sum(w)) < 1e-12
    assert got[2] == 1.0 and got[3] == 0.0


def test_decay_by_month(spark):
    rows = [(1, -10, "2"), (1, 0, "0")]
    got = K.customer_aggregates(_credit(spark, rows), 0.1, "month").first()["weighted_default_prop"]
    assert abs(got - math.exp(-1) / (math.exp(-1) + 1)) < 1e-12


def test_streaks_and_tail(spark):
    # months -7..0: 0 0 1 1 1 0 1 1
    seq = ["0", "0", "2", "3", "4", "1", "5", "2"]
    rows = [(1, m - 7, s) for m, s in enumerate(seq)]
    f = K.feature_engineer(_credit(spark, rows)).first()
    assert f["longest_non_default_streak"] == 2
    assert f["longest_default_streak"] == 3
    assert f["consecutive_defaults_6m"] == 2
    assert f["recency_last_bad_status"] == 0
    assert f["max_days_past_due"] == 150


def test_never_defaulted_and_invalid_status(spark):
    rows = [(7, -2, "X"), (7, -1, "?"), (7, 0, "0")]
    f = K.feature_engineer(_credit(spark, rows)).first()
    assert f["longest_default_streak"] == 0
    assert f["recency_last_bad_status"] == -1
    assert f["consecutive_defaults_6m"] == 0
    c = K.customer_aggregates(_credit(spark, rows)).first()
    assert c["default_prop"] == 0.0 and c["tenure"] == 3


def test_single_customer_vintage_has_null_zscore(spark):
    rows = [(1, -5, "2"), (2, -3, "0"), (3, -3, "2")]
    z = {r["id"]: r["weighted_default_prop_vintage_norm"] for r in K.clean_credit(_credit(spark, rows)).collect()}
    assert z[1] is None
    assert z[2] is not None and z[3] is not None and abs(z[2] + z[3]) < 1e-9


def test_partitioning_independence(spark, sf):
    cr = FX.credit_record(spark, sf)
    a = sorted(K.feature_engineer(cr).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = sorted(K.feature_engineer(FX.credit_record(spark, sf)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
