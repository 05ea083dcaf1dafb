"""Scalers against direct numpy/pandas computations; the entry contract."""

import numpy as np
import pandas as pd

from riskloom.operators import scale as S


def _sk_quantile(x, n_q=1000):
    """The uniform quantile transform written out with numpy."""
    x = np.asarray(x, dtype=float)
    k = min(n_q, len(x))
    refs = np.linspace(0, 1, k)
    q = np.percentile(x, refs * 100)
    y = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
    y[x - 1e-7 < q[0]] = 0
    y[x + 1e-7 > q[-1]] = 1
    return y


def test_quantile_and_rank_pct(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.exponential(size=400), 1)          # many ties
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    got = {r["id"]: r["x_scaled"] for r in S.scale_quantile(df, ["x"], n_quantiles=50).collect()}
    exp = _sk_quantile(x, 50)
    assert max(abs(got[i] - exp[i]) for i in range(len(x))) < 1e-9
    rk = {r["id"]: r["x_scaled"] for r in S.scale_rank_pct(df, ["x"]).collect()}
    exp_r = pd.Series(x).rank(pct=True).to_numpy()
    assert max(abs(rk[i] - exp_r[i]) for i in range(len(x))) < 1e-12


def test_standard_zero_std(spark):
    tr = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "id long, a double, b double")
    te = spark.createDataFrame([(3, 6.0, 7.0)], "id long, a double, b double")
    a, b = S.scale_standard(tr, te, ["a", "b"])
    assert sorted(r["a"] for r in a.collect()) == [-1.0, 1.0]
    r = b.first()
    assert r["a"] == 3.0 and r["b"] == 2.0    # std 0 -> scale 1


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "label" in df.columns and "id" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_exact_quantiles_distributed_path(spark):
    from riskloom.operators.ranking import exact_quantiles_of
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=2000), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 0.999, 1.0]
    got = exact_quantiles_of(df, {"x": probs}, rows=40)["x"]
    assert np.allclose(got, np.percentile(x, [p * 100 for p in probs]), atol=1e-12)


def test_rows_of_a_bucket_do_not_grow_with_the_table(spark):
    from pyspark.sql import functions as F
    from riskloom.operators import ranking as R
    from riskloom.operators.split import seeded_int
    most = {}
    for n in (2_000, 20_000, 100_000):
        df = spark.range(n).select((F.col("id") * F.col("id") / 7.0).alias("v"), seeded_int(1, "id").alias("h"))
        for name, b in (("value", R.value_bucket(df, "v", rows=200)), ("hash", R.hash_bucket(df, "h", rows=200))):
            most[name, n] = b.groupBy("_bkt").count().agg(F.max("count")).first()[0]
    assert max(most.values()) <= 3 * 200
    df = spark.range(5_000).select(F.col("id"), (F.col("id") % 1009).cast("double").alias("v"))
    got = R.running_totals(df.groupBy("v").agg(F.count("id").alias("c")), "v", ["c"], rows=50).orderBy("v").collect()
    total = 0
    for r in got:
        total += r.c
        assert r.cum_c == total
    assert total == 5_000


def test_values_that_differ_in_the_last_places_are_no_ties(spark):
    from riskloom.operators import scale as S
    df = spark.createDataFrame([(1, 1e-14), (2, 2e-14), (3, 3e-14), (4, 3e-14), (5, None)], "id long, x double")
    got = {r.id: r.x_scaled for r in S.scale_rank_pct(df, ["x"]).collect()}
    assert got == {1: 0.25, 2: 0.5, 3: 0.875, 4: 0.875, 5: None}


def test_exact_sums_do_not_hang_on_order(spark):
    import random
    from pyspark.sql import functions as F
    from riskloom.operators.credit import exact_sum
    terms = [0.1 * i / 7 for i in range(200)] + [1e-9 * i for i in range(50)]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(terms)
        seen.add(spark.createDataFrame([(t,) for t in terms], "t double").repartition(1 + seed).agg(exact_sum(F.col("t"))).first()[0])
    assert len(seen) == 1 and abs(seen.pop() - sum(sorted(terms))) < 1e-9


def test_both_feature_frames_are_written_once(spark, monkeypatch):
    from riskloom import session
    from riskloom.plans import pipeline as PL
    from riskloom.plans import q_models as Q
    from riskloom.plans.common import fx
    cuts, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    train, test, cols = Q._feature_set(spark, "/root/testdata/sf0.001", False)
    assert len(cuts) == 1
    fs = PL.train_frame(fx(spark, "/root/testdata/sf0.001", "application_record"), fx(spark, "/root/testdata/sf0.001", "credit_record"), "n18")
    for got, want in ((train, fs.train), (test, fs.test)):
        assert got.columns == want.columns == ["id", *cols, "label"]
        assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = fx(spark, "/root/testdata/sf0.001", "credit_record")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_package_is_shipped_once_by_fits_side_by_side(monkeypatch):
    import time
    from types import SimpleNamespace
    from riskloom import session
    from riskloom.operators.models import run_parallel
    sent = []
    context = SimpleNamespace(applicationId="some", addPyFile=lambda path: (time.sleep(0.2), sent.append(path)))
    monkeypatch.setattr(session, "_SHIPPED", {})
    run_parallel(lambda _: session.ship_package(SimpleNamespace(sparkContext=context)), range(4))
    assert len(sent) == 1
