"""Model operators against numpy or on data whose answer is known."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import features, models, pipelines, sampling, selection

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    """The label depends on a and b only."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)) * [3, 1, 0.5, 2] + [1, 2, 3, 4]
    x[:, 3] += 0.7 * x[:, 0]
    y = (x[:, 0] - 1 + 2 * (x[:, 1] - 2) > 0).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label int").persist(), x, y


def test_pca_equals_numpy(frame):
    df, x, _ = frame
    m = features.fit_pca(df, COLS)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(m.variance, values[::-1]) and np.allclose(m.ratio, values[::-1] / values.sum())
    for row, v in zip(m.components, vectors.T[::-1]):
        assert np.allclose(np.abs(row), np.abs(v)) and row[np.abs(row).argmax()] > 0
    scores = np.array(m.project(df).select("pc1", "pc2", "pc3", "pc4").collect())
    assert np.allclose(scores.mean(0), 0, atol=1e-9) and np.allclose(np.cov(scores.T), np.eye(4), atol=1e-9)


def test_pca_refuses_nulls(spark, frame):
    with pytest.raises(Exception, match="(?i)null"):
        features.fit_pca(frame[0].unionByName(spark.createDataFrame([(999, None, 1.0, 1.0, 1.0, 0)], frame[0].schema)), COLS)


def test_classifiers_learn_a_separable_label(frame):
    df = frame[0]
    train, test = df.where("id < 300"), df.where("id >= 300")
    for model in ("gbt", "svc", "mlp"):
        scored = models.fit_score(train, test, COLS, model=model)
        got = models.score_metrics(scored)
        assert scored.count() == 100 and got["roc_auc"] > 0.9, (model, got)


def test_rfe_keeps_what_matters(frame):
    ranking = selection.rfe_linear_svc(frame[0], COLS)
    rows = ranking.collect() if hasattr(ranking, "collect") else ranking
    assert len(rows) > 0


def test_centroids_are_cluster_means(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0.0, 0.0], [50.0, 0.0], [0.0, 50.0]])
    rows = [(i, 0, [float(v) for v in centres[i % 3] + rng.normal(size=2)]) for i in range(90)] + [(100 + i, 1, [99.0, 99.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    out = sampling.cluster_centroids(df).collect()
    got = sorted(tuple(np.round(r.embedding, 6)) for r in out if r.label == 0)
    want = sorted(tuple(np.round(np.mean([r[2] for r in rows[:90] if r[0] % 3 == k], axis=0), 6)) for k in range(3))
    assert got == want and sum(r.label == 1 for r in out) == 3


def test_cv_reports_mean_best_fold_and_test(frame):
    df = frame[0]
    train, test, params = df.where("id < 300"), df.where("id >= 300"), {"maxIter": 2, "maxDepth": 2}
    rows = models.cv_test_run(train, test, COLS, "gbt", k=3, params=params).collect()
    folds = [r for r in rows if r.part == "fold"]
    mean, last = rows[3], rows[4]
    assert [r.part for r in rows] == ["fold"] * 3 + ["mean", "test"] and [r.fold for r in folds] == [0, 1, 2]
    for m in ("accuracy", "f1", "roc_auc", "average_precision"):
        assert mean[m] == pytest.approx(np.mean([r[m] for r in folds]))
    assert last.fold == int(np.argmax([r.roc_auc for r in folds]))
    kept = models.stratified_folds(train, label="label", key="id", k=3, seed=42).where(f"fold <> {last.fold}")
    scored = models.fit_score(kept, test, COLS, "gbt", params=params).toPandas()
    at = scored.score > last.threshold
    assert last.accuracy == pytest.approx((at == (scored.y_true == 1)).mean())
    # the threshold is the best one of the fold's own rows
    held = models.stratified_folds(train, label="label", key="id", k=3, seed=42).where(f"fold = {last.fold}")
    own = models.fit_score(kept, held, COLS, "gbt", params=params).toPandas()

    def f1(t):
        p = own.score >= t
        tp = (p & (own.y_true == 1)).sum()
        precision, recall = tp / p.sum(), tp / (own.y_true == 1).sum()
        return 2 * precision * recall / (precision + recall + 1e-6)
    best = {t: f1(t) for t in own.score.unique()}
    assert best[min(best, key=lambda t: abs(t - last.threshold))] == pytest.approx(max(best.values()))


def test_searches_have_the_reference_breadth(monkeypatch, spark, frame):
    """The registered searches on a small frame, with short fits: settings, folds and the best."""
    from riskloom.operators import search as SR
    from riskloom.plans import q_models as Q
    seen = []
    real_search = SR.search
    rows_of = frame[0].withColumnRenamed("a", "flag_a")
    cols = ["flag_a", *COLS[1:]]
    monkeypatch.setattr(Q, "feature_set", lambda *_, **kw: (rows_of, rows_of, cols))
    monkeypatch.setattr(SR, "search", lambda df, c, learner, combos, **kw: seen.append((learner, combos, kw["k"])) or real_search(df, c, learner, combos, **kw))
    monkeypatch.setattr(Q, "GBT_GRID", Q.GBT_GRID | {"n_estimators": [1, 2, 3]})
    rows = Q.q_random_search(spark, "").collect()
    assert sorted(r.model for r in rows) == ["gbt"] * 20 + ["svc"] * 3
    assert [sum(r.is_best for r in rows if r.model == m) for m in ("gbt", "svc")] == [1, 1]
    assert max((r for r in rows if r.model == "gbt"), key=lambda r: r.f1).f1 == next(r for r in rows if r.model == "gbt" and r.is_best).f1
    _, gbt, k = seen[0]
    assert k == 3 and len({str(sorted(c.items())) for c in gbt}) == 20 and all(set(c) == set(Q.GBT_GRID) for c in gbt)
    monkeypatch.setattr(Q, "MLP_GRID", Q.MLP_GRID | {"n_epochs": [1]})
    rows = Q.q_search_results(spark, "").collect()
    assert len(rows) == 32 and [r.is_best for r in rows].count(True) == 1
    learner, nets, k = seen[1]
    assert k == 5 and learner.categorical == ["flag_a"] and {c["hidden_dims"] for c in nets} == {(128, 64), (256, 128)}


def test_search_parameters_reach_the_estimators(monkeypatch, frame):
    train, test, given = frame[0].where("id < 300"), frame[0].where("id >= 300"), {}
    for name in ("GBTClassifier", "LinearSVC", "MultilayerPerceptronClassifier"):
        monkeypatch.setattr(models, name, lambda _f=getattr(models, name), **kw: given.update(kw) or _f(**kw))
    models.fit_score(train, test, COLS, "gbt", params={"maxIter": 1, "maxDepth": 2, "subsamplingRate": 0.6, "featureSubsetStrategy": "0.8"}).count()
    assert given["subsamplingRate"] == 0.6 and given["featureSubsetStrategy"] == "0.8"
    models.fit_score(train, test, COLS, "svc", params={"C": 10.0, "maxIter": 2}).count()
    assert given["regParam"] == pytest.approx(1 / 3000)
    models.fit_score(train, test, COLS, "mlp", params={"layers": [3], "solver": "gd", "stepSize": 5e-4, "maxIter": 2}).count()
    assert given["solver"] == "gd" and given["stepSize"] == 5e-4


def test_sampled_sets_hold_smotetomek_and_centroids(frame):
    v = pipelines._as_vectors(frame[0].where("label = 0 OR id < 80"), COLS)
    sets = sampling.make_sampled_sets(v, key="id", block_rows=64)
    assert set(sets) == {"original", "ros", "rus", "smote", "smotetomek", "cc"}
    n = {m: {r.label: r["count"] for r in sets[m].groupBy("label").count().collect()} for m in ("original", "smote", "smotetomek", "cc")}
    assert n["cc"][1] == n["original"][1] and 0 < n["cc"][0] <= n["original"][1]
    gone = [n["smote"][c] - n["smotetomek"][c] for c in (0, 1)]
    assert gone[0] == gone[1] >= 0  # both ends of each link go


def test_sampler_comparison_has_train_and_test_rows(frame):
    train, test = frame[0].where("id < 200"), frame[0].where("id >= 300")
    assert set(pipelines.SAMPLERS) == {"none", "ros", "rus", "smote", "smotetomek", "cc"}
    rows = pipelines.compare_samplers(train, test, COLS, samplers=("rus",), knn_kw=dict(block_rows=64), k=2).collect()
    folded = models.stratified_folds(train, label="label", key="id", k=2, seed=42)
    one = lambda f, against: pipelines.run_pipeline("knn", folded.where(f"fold <> {f}").drop("fold"), against, COLS, sampler="rus", knn_kw=dict(block_rows=64)).first()
    folds = [one(f, folded.where(f"fold = {f}").drop("fold")) for f in range(2)]
    best = int(np.argmax([r.f1 for r in folds]))
    assert [(r.split, r.best_fold) for r in rows] == [("train", best), ("test", best)]
    want = one(best, test)
    for m in pipelines.METRIC_COLS:
        assert rows[0][m] == pytest.approx(np.mean([r[m] for r in folds])) and rows[1][m] == pytest.approx(want[m])


def test_loadings_importances_and_correlations(spark, frame):
    """The tables behind the PCA reports against numpy."""
    from riskloom.operators import features as FE
    df, x, y = frame
    m = FE.fit_pca(df, COLS)
    load = m.loadings_table(spark)
    sums = {c: float(np.abs(m.components[:, i]).sum()) for i, c in enumerate(COLS)}
    order = sorted(COLS, key=lambda c: (-sums[c], c))
    top = FE.importance_from_loadings(load, top_n=2)
    assert [(r.feature, pytest.approx(r.importance)) for r in top.collect()] == [(c, sums[c]) for c in order[:2]]
    two = {r.feature: r.importance for r in FE.importance_from_loadings(load, n_components=2).collect()}
    assert two == {c: pytest.approx(float(np.abs(m.components[:2, i]).sum())) for i, c in enumerate(COLS)}
    at = [COLS.index(c) for c in order[:2]]
    greatest = np.abs(m.components[:, at]).max(1)
    for r in FE.loadings_scaled(load, top).collect():
        j, i = r.component - 1, COLS.index(r.feature)
        assert i in at and r.scaled_loading == pytest.approx(m.components[j, i] / greatest[j])
    scores = m.project(df)
    pcs = [f"pc{j + 1}" for j in range(len(COLS))]
    z = (x - x.mean(0)) @ m.components.T
    want = {p: abs(np.corrcoef(z[:, j], y)[0, 1]) for j, p in enumerate(pcs)}
    got = FE.pc_label_corr(scores, pcs, "label", top_n=3).collect()
    assert [r.component for r in got] == sorted(pcs, key=lambda p: -want[p])[:3]
    assert all(r.abs_corr == pytest.approx(want[r.component]) for r in got)


def test_selection_by_median_and_the_joint_ranking(spark):
    from riskloom.operators import features as FE
    imp = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 0.3), ("d", 0.1)], "feature string, importance double")
    assert {r.feature: r.selected for r in FE.select_by_median(imp).collect()} == {"a": True, "b": False, "c": True, "d": False}
    out = spark.createDataFrame([("a", 2, False), ("b", 1, True), ("c", 1, True), ("d", 3, False)], "feature string, ranking int, selected boolean")
    rows = {r.feature: r for r in FE.feature_ranking(imp, out).collect()}
    assert [rows[f].importance_rank for f in "abcd"] == [1, 3, 2, 4] and [rows[f].rfe_rank for f in "abcd"] == [2, 1, 1, 3]
    assert all((r.n_selected, r.n_dropped, r.rfe_n_selected, r.rfe_n_dropped) == (2, 2, 2, 2) for r in rows.values())


def test_grouped_pca_equals_single_fits(spark, frame):
    from riskloom.operators import features as FE
    df, x, _ = frame
    v = pipelines._as_vectors(df, COLS).withColumn("run", (F.col("id") % 2).cast("long"))
    model = FE.fit_grouped_pca(v, "cumulative")
    for g in (0, 1):
        part = df.filter(F.col("id") % 2 == g)
        one = FE.fit_pca(part, COLS)
        n = FE.n_components(one.variance_table(spark), "cumulative").first()[0]
        assert model.counts[g] == n
        mean, axes = model.models[g]
        assert np.allclose(mean, one.mean) and np.allclose(axes, (one.components / np.sqrt(one.variance)[:, None]).T[:, :n])
    for method in ("avg", "elbow", "cumulative"):
        one = FE.fit_pca(df, COLS)
        assert FE.count_components(one.ratio, method) == FE.n_components(one.variance_table(spark), method).first()[0]


def test_resampled_frames(spark):
    """Drawn rows are training rows, synthetic ones lie between two rows of the minority, classes are even."""
    from riskloom.plans import pipeline as PL
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal()), int(rng.integers(0, 9)), int(i % 5 == 0)) for i in range(200)]
    train = spark.createDataFrame(rows, "id long, a double, b int, label int")
    fs = PL.FeatureSet(train, train.where("false"), ["a", "b"])
    got = {m: df.toPandas() for m, df in PL.resampled_frames(fs, methods=("original", "ros", "rus", "smote")).items()}
    own = {r[0]: (r[1], float(r[2]), r[3]) for r in rows}
    for m, n in (("original", None), ("ros", 160), ("rus", 40), ("smote", 160)):
        df = got[m]
        assert list(df.columns) == ["id", "a", "b", "label"]
        assert sorted(df.label.value_counts().tolist()) == ([40, 160] if n is None else [n, n]), m
        real = df[df.id >= 0]
        assert all(own[i] == (a, b, y) for i, a, b, y in real.itertuples(index=False)), m
        assert (m == "ros") == real.id.duplicated().any()
    new = got["smote"][got["smote"].id < 0]
    few = np.array([own[i][:2] for i in own if own[i][2] == 1])
    assert len(new) == 120 and (new.label == 1).all()
    for _, a, b, _ in new.itertuples(index=False):
        d1 = np.linalg.norm(few - [a, b], axis=1)
        between = d1[:, None] + d1[None, :] - np.linalg.norm(few[:, None] - few[None, :], axis=2)
        assert between.min() < 1e-9
    with pytest.raises(Exception, match="is null"):
        gap = PL.FeatureSet(train.withColumn("a", F.nullif("a", F.col("a"))), train, ["a", "b"])
        PL.resampled_frames(gap, methods=("rus",))["rus"].collect()


def test_centroids_of_groups_in_one_pass(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(2):
        rows += [(g, 1000 * g + i, 0, [100.0 * (i % 4) + 7 * g, float(rng.normal())]) for i in range(80)]
        rows += [(g, 1000 * g + 100 + i, 1, [5.0, 5.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "run int, id long, label int, embedding array<double>")
    out = sampling.cluster_centroids(df, key="id", by="run").collect()
    for g in range(2):
        mine = [r for r in out if r.run == g]
        assert sum(r.label == 1 for r in mine) == 4
        got = sorted(round(r.embedding[0], 6) for r in mine if r.label == 0)
        assert got == [100.0 * j + 7 * g for j in range(4)]
    assert len({(r.run, r.id) for r in out}) == len(out)


def test_fits_have_a_bounded_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "ROWS_A_TASK", 5)
    most = 2 * spark.sparkContext.defaultParallelism
    df = spark.range(0, 100 * most, 1, 4 * most)
    got = models.compact(df)
    assert got.rdd.getNumPartitions() <= most and got.count() == 100 * most
