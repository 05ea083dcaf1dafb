"""Registered feature-analysis, model and search queries.

Most of these fit MLlib models, whose results are not SQL-expressible:
they carry no oracle and are checked by row count here and by invariants
in the tests. ``select_kbest_mi`` and ``grid_search`` are exact
aggregates and carry DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import features as FE
from riskloom.operators import learners as LN
from riskloom.operators import models as MD
from riskloom.operators import sampling as SM
from riskloom.operators import scale as S
from riskloom.operators import search as SR
from riskloom.plans import pipeline as PL
from riskloom.plans.common import Registry, fx, r6, with_fixtures  # noqa: F401
from riskloom.plans.q_application import N18_FULL, _N18_TRAIN_COLS, round_cols

R = Registry()


def feature_set(spark, sf, standardise: bool = True):
    """n18 training frame (old accounts) and test frame (new accounts);
    every feature standardised with training statistics."""
    from riskloom.plans.common import memo
    return memo(spark, ("features", sf, standardise), lambda: _feature_set(spark, sf, standardise))


def _feature_set(spark, sf, standardise: bool):
    from riskloom.session import cut_lineage
    fs = PL.train_frame(fx(spark, sf, "application_record"), fx(spark, sf, "credit_record"), "n18")
    # both frames are written once; statistics and scaling read them from there
    both = cut_lineage(fs.extra["both"])
    train, test = (both.filter(F.col("split") == s).drop("split") for s in ("old", "new"))
    if standardise:
        train, test = S.scale_standard(train, test, fs.feature_cols)
    return train, test, fs.feature_cols


def pca_model(spark, sf):
    train, test, cols = feature_set(spark, sf)
    return FE.fit_pca(train, cols), train, test, cols


@R.add("pca_variance")
def q_pca_variance(spark, sf):
    m, *_ = pca_model(spark, sf)
    return r6(m.variance_table(spark))


@R.add("pca_n_components")
def q_pca_n_components(spark, sf):
    m, *_ = pca_model(spark, sf)
    v = m.variance_table(spark).persist()
    out = None
    for method in ("avg", "elbow", "cumulative", "default"):
        part = FE.n_components(v, method).select(F.lit(method).alias("method"),
                                                 F.col("n_components").cast("int").alias("n_components"))
        out = part if out is None else out.unionByName(part)
    return out


@R.add("pca_project")
def q_pca_project(spark, sf):
    m, train, _, _ = pca_model(spark, sf)
    scores = m.project(train, whiten=True)
    return r6(scores.select("id", "label", *[c for c in scores.columns if c.startswith("pc")]))


@R.add("pca_importance")
def q_pca_importance(spark, sf):
    m, *_ = pca_model(spark, sf)
    return r6(FE.importance_from_loadings(m.loadings_table(spark), top_n=10))


@R.add("pca_loadings_scaled")
def q_pca_loadings_scaled(spark, sf):
    m, *_ = pca_model(spark, sf)
    load = m.loadings_table(spark)
    top = FE.importance_from_loadings(load, top_n=10)
    return r6(FE.loadings_scaled(load, top))


@R.add("pc_label_corr")
def q_pc_label_corr(spark, sf):
    m, train, _, _ = pca_model(spark, sf)
    scores = m.project(train)
    pcs = [c for c in scores.columns if c.startswith("pc")]
    return r6(FE.pc_label_corr(scores, pcs, "label", top_n=10))


_MI_COLS = [c for c in _N18_TRAIN_COLS if c not in ("id", "label")]
_MI_CTES = N18_FULL + [
    ("tr", f"SELECT {', '.join(_N18_TRAIN_COLS)} FROM n18 JOIN (SELECT id, multi_dim_target AS label FROM tgt "
           "WHERE split = 'old') t USING (id) LEFT JOIN fe USING (id)"),
    ("lg", " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS bin, label AS y FROM tr" for c in _MI_COLS if c != "amt_income_total_log")),
    ("jn", """SELECT feature, bin, y, count(*) AS n_xy FROM lg WHERE bin IS NOT NULL GROUP BY feature, bin, y"""),
    ("mi", """SELECT feature, sum(CAST(n_xy AS DOUBLE) / n * ln(CAST(n_xy AS DOUBLE) * n / (n_x * n_y))) AS mutual_info
FROM (SELECT *, sum(n_xy) OVER (PARTITION BY feature) AS n, sum(n_xy) OVER (PARTITION BY feature, bin) AS n_x,
  sum(n_xy) OVER (PARTITION BY feature, y) AS n_y FROM jn) GROUP BY feature"""),
    # the continuous feature by nearest neighbours, all pairs
    ("cx", "SELECT id, amt_income_total_log AS x, label AS y, count(*) OVER (PARTITION BY label) AS n_y FROM tr WHERE amt_income_total_log IS NOT NULL"),
    ("rd", """SELECT a.id, any_value(a.n_y) AS n_y, any_value(a.x) AS x, list_sort(list(abs(a.x - b.x)))[least(3, any_value(a.n_y) - 1)] AS r
FROM cx a JOIN cx b ON a.y = b.y AND a.id <> b.id GROUP BY a.id"""),
    ("mm", """SELECT rd.id, any_value(rd.n_y) AS n_y, count(*) AS m FROM rd JOIN cx ON (r = 0 AND cx.x = rd.x) OR (r > 0 AND cx.x > rd.x - r AND cx.x < rd.x + r)
GROUP BY rd.id"""),
    ("ps", """SELECT i AS n, coalesce(sum(1.0 / (i - 1)) FILTER (i > 1) OVER (ORDER BY i), 0.0) - 0.57721566490153286 AS psi
FROM range(1, (SELECT count(*) + 1 FROM cx)) t(i)"""),
    ("ck", """SELECT 'amt_income_total_log' AS feature, greatest(0.0, (SELECT psi FROM ps WHERE n = (SELECT count(*) FROM cx)) + avg(pk.psi) - avg(py.psi) - avg(pm.psi))
  AS mutual_info FROM mm JOIN ps pk ON pk.n = least(3, n_y - 1) JOIN ps py ON py.n = n_y JOIN ps pm ON pm.n = m"""),
]


@R.add("select_kbest_mi", with_fixtures(["credit_record", "application_record"],
                                        "SELECT feature, round(mutual_info, 6) AS mutual_info FROM "
                                        "(SELECT feature, mutual_info FROM mi UNION ALL SELECT feature, mutual_info FROM ck) "
                                        "ORDER BY mutual_info DESC, feature LIMIT 10", _MI_CTES))
def q_select_kbest_mi(spark, sf):
    train, _, cols = feature_set(spark, sf, standardise=False)
    return r6(FE.select_kbest(FE.mutual_information(train, cols, "label"), 10))


@R.add("mutual_information", with_fixtures(["credit_record", "application_record"],
                                           "SELECT feature, round(mutual_info, 6) AS mutual_info FROM mi UNION ALL SELECT feature, round(mutual_info, 6) FROM ck",
                                           _MI_CTES))
def q_mutual_information(spark, sf):
    train, _, cols = feature_set(spark, sf, standardise=False)
    return r6(FE.mutual_information(train, cols, "label"))


def gbt_importances(spark, sf):
    from pyspark.ml.classification import GBTClassifier
    train, _, cols = feature_set(spark, sf)
    tr = MD.with_class_weight(MD._assembled(MD.compact(train.select("label", *cols)), cols))
    model = GBTClassifier(labelCol="label", weightCol="weight", seed=42, maxIter=20, maxDepth=4).fit(tr)
    imp = model.featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, imp)], "feature string, importance double")


@R.add("select_by_importance")
def q_select_by_importance(spark, sf):
    return r6(FE.select_by_median(gbt_importances(spark, sf)))


@R.add("feature_ranking")
def q_feature_ranking(spark, sf):
    """Per feature its importance (with rank and choice) and its rank in the elimination
    (with choice), and how many each method selects and drops."""
    from riskloom.operators.selection import rfe_linear_svc
    train, _, cols = feature_set(spark, sf)
    return r6(FE.feature_ranking(gbt_importances(spark, sf), rfe_linear_svc(train, cols, "label")))


@R.add("select_rfe")
def q_select_rfe(spark, sf):
    from riskloom.operators.selection import rfe_linear_svc
    train, _, cols = feature_set(spark, sf)
    return rfe_linear_svc(train, cols, "label")


def _test_metrics(spark, sf, model, params=None):
    train, test, cols = feature_set(spark, sf)
    scored = MD.fit_score(train, test, cols, model, params=params)
    m = MD.score_metrics(scored)
    return r6(spark.createDataFrame([(model, *[float(m[k]) for k in ("accuracy", "precision", "recall", "f1",
                                                                   "roc_auc", "average_precision")])],
                                    "model string, accuracy double, precision double, recall double, f1 double, "
                                    "roc_auc double, average_precision double"))


@R.add("gbt_classifier")
def q_gbt_classifier(spark, sf):
    return _test_metrics(spark, sf, "gbt")


@R.add("svc_classifier")
def q_svc_classifier(spark, sf):
    return _test_metrics(spark, sf, "svc")


@R.add("mlp_classifier")
def q_mlp_classifier(spark, sf):
    return _test_metrics(spark, sf, "mlp", {"layers": [128, 64]})


@R.add("ml_pipeline")
def q_ml_pipeline(spark, sf):
    """Every selector-to-model chain by its name; the PCA chain on over-sampled rows."""
    from riskloom.operators.pipelines import PIPELINES, run_pipeline
    train, test, cols = feature_set(spark, sf)
    made = MD.run_parallel(lambda n: run_pipeline(n, train, test, cols, sampler="ros" if n == "knn" else "none"), PIPELINES, len(PIPELINES))
    out = made[0]
    for d in made[1:]:
        out = out.unionByName(d)
    return r6(out)


# The reference's search spaces.
GBT_GRID = {"n_estimators": [100, 200, 300], "max_depth": [3, 5, 7, 9], "learning_rate": [0.01, 0.05, 0.1, 0.2],
            "subsample": [0.6, 0.8, 1.0], "colsample_bytree": [0.6, 0.8, 1.0], "gamma": [0, 0.1, 0.2, 0.5]}
GBT_DRAWS = 20
SVC_GRID = {"C": [0.1, 1.0, 10.0]}
MLP_GRID = {"hidden_dims": [(128, 64), (256, 128)], "dropout": [0.2, 0.3], "lr": [1e-3, 5e-4],
            "optimizer_name": ["adam", "sgd"], "activation_name": ["relu", "leaky_relu"]}


@R.add("cv_run")
def q_cv_run(spark, sf):
    train, test, cols = feature_set(spark, sf)
    return r6(MD.cv_test_run(train, test, cols, "gbt", k=5, params={"maxIter": 100, "maxDepth": 6, "stepSize": 0.3}))


@R.add("random_search")
def q_random_search(spark, sf):
    train, _, cols = feature_set(spark, sf)
    gbt = SR.search(train, cols, LN.BoostedTrees(), MD.random_subset(MD.param_grid(GBT_GRID), GBT_DRAWS), k=3)
    svc = MD.search(train, cols, "svc", MD.param_grid(SVC_GRID), k=3)
    shown = ["combo", "params", "accuracy", "f1", "roc_auc"]
    best = MD.best_of(svc, "f1").select("combo").scalar()
    return r6(gbt.select(F.lit("gbt").alias("model"), *shown, "is_best")
              .unionByName(svc.select(F.lit("svc").alias("model"), *shown, (F.col("combo") == best).alias("is_best"))))


@R.add("search_results")
def q_search_results(spark, sf):
    train, _, cols = feature_set(spark, sf, standardise=False)
    coded = [c for c in cols if "encoded" in c or "flag" in c]
    return r6(SR.search(train, cols, LN.EmbeddingNetwork(coded), MD.param_grid(MLP_GRID), best_by="f1_at_threshold", k=5))


@R.add("compare_samplers")
def q_compare_samplers(spark, sf):
    from riskloom.operators.pipelines import compare_samplers
    train, test, cols = feature_set(spark, sf)
    return r6(compare_samplers(train, test, cols))


@R.add("compare_encodings")
def q_compare_encodings(spark, sf):
    from riskloom.operators.pipelines import compare_encodings
    return r6(compare_encodings(fx(spark, sf, "application_record"), fx(spark, sf, "credit_record")))


@R.add("compare_pca")
def q_compare_pca(spark, sf):
    from riskloom.operators.pipelines import compare_pca
    train, test, cols = feature_set(spark, sf)
    return r6(compare_pca(train, test, cols))


H = "CAST(('0x' || substr(md5('42|' || CAST(vec_id AS VARCHAR)), 1, 15)) AS BIGINT)"
GRID = [
    ("fv", f"""SELECT vec_id, embedding, label,
  CAST((row_number() OVER (PARTITION BY label ORDER BY {H}, vec_id) - 1) % 3 AS INTEGER) AS fold FROM vectors"""),
    ("pairs", """SELECT m.metric, q.fold, q.vec_id AS query_id, b.vec_id AS neighbor_id, b.label AS y,
  CASE WHEN m.metric = 'manhattan' THEN list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: abs(p[1] - p[2])))
       ELSE list_distance(q.embedding, b.embedding) END AS distance
FROM fv q JOIN fv b ON q.fold <> b.fold
CROSS JOIN (SELECT unnest(['euclidean', 'minkowski', 'manhattan']) AS metric) m"""),
    ("rk", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, query_id ORDER BY distance, neighbor_id) AS rank
FROM pairs) WHERE rank <= 11"""),
    ("st", """SELECT * FROM rk CROSS JOIN (SELECT unnest([3, 5, 7, 9, 11]) AS n_neighbors) kk
CROSS JOIN (SELECT unnest(['uniform', 'distance']) AS weights) ww WHERE rank <= n_neighbors"""),
    ("wz", """SELECT *, max(CASE WHEN distance = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY metric, n_neighbors, weights, query_id) AS z
FROM st"""),
    ("vt", """SELECT metric, fold, n_neighbors, weights, query_id,
  sum(w * y) / sum(w) AS proba FROM (SELECT *, CASE WHEN weights = 'uniform' THEN 1.0 WHEN z = 1 THEN
  CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 / distance END AS w FROM wz)
GROUP BY metric, fold, n_neighbors, weights, query_id"""),
    ("pf", """SELECT metric, fold, n_neighbors, weights,
  sum(CASE WHEN v.label = 1 AND proba > 0.5 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN v.label = 0 AND proba > 0.5 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN v.label = 1 AND proba <= 0.5 THEN 1 ELSE 0 END) AS fn
FROM vt JOIN vectors v ON v.vec_id = vt.query_id GROUP BY metric, fold, n_neighbors, weights"""),
]


@R.add("grid_search", with_fixtures(["vectors"], """SELECT metric, n_neighbors, weights,
  round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS mean_f1
FROM pf GROUP BY metric, n_neighbors, weights""", GRID))
def q_grid_search(spark, sf):
    v = fx(spark, sf, "vectors")
    return r6(MD.knn_grid_scores(v, folds=3))
