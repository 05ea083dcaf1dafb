"""Classifiers, the model pipeline chosen by name, cross-validation and
hyper-parameter search.

Training uses MLlib estimators (distributed); the fold and search loops
run on the driver over a handful of fits, each fit being a Spark job over
the whole fold. KNN uses the exact neighbour join of ``neighbors``."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators.neighbors import knn_classify, knn_join
from riskloom.operators.split import stratified_folds
from riskloom.session import checkpoint_dir, cut_lineage

MODELS = ("gbt", "svc", "mlp", "knn")


def _assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(
        df.withColumns({c: F.col(c).cast("double") for c in cols}))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Positive rows weighted negatives/positives (``scale_pos_weight``)."""
    ratio = df.agg((F.sum((F.col(label) == 0).cast("double"))
                    / F.nullif(F.sum((F.col(label) == 1).cast("double")), F.lit(0.0)))).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, F.coalesce(ratio, F.lit(1.0))).otherwise(1.0))


ROWS_A_TASK = 50_000


def compact(df: DataFrame) -> DataFrame:
    """``df`` written once in partitions of about ``ROWS_A_TASK`` rows, but no more than two a core:
    iterative fits run one task per partition and step, and each sends its share of
    the model, whatever its rows."""
    src = cut_lineage(df)
    return src.coalesce(max(1, min(-(-src.count() // ROWS_A_TASK), 2 * src.sparkSession.sparkContext.defaultParallelism)))


def fit_score(train: DataFrame, test: DataFrame, cols: list[str], model: str = "gbt",
              label: str = "label", key: str = "id", params: dict | None = None, seed: int = 42, compacted: bool = False) -> DataFrame:
    """Fit on ``train`` and return (key, y_true, score) for ``test``. ``compacted`` says
    that ``train`` lies in few partitions already."""
    params = dict(params or {})
    if model == "knn":
        return knn_score(train, test, cols, label=label, key=key, **params)
    if model == "mlp":
        from riskloom.operators.sampling import sample_over
        train = sample_over(train, label=label, key=key, seed=seed).drop("draw")
    tr = _assembled(train if compacted and model != "mlp" else compact(train.select(label, *cols)), cols)
    te = _assembled(test, cols)
    if model == "gbt":
        tr = with_class_weight(tr, label)
        est = GBTClassifier(labelCol=label, featuresCol="features", weightCol="weight", seed=seed,
                            maxIter=params.get("maxIter", 20), maxDepth=params.get("maxDepth", 4),
                            stepSize=params.get("stepSize", 0.1), subsamplingRate=params.get("subsamplingRate", 1.0),
                            featureSubsetStrategy=params.get("featureSubsetStrategy", "all"))
        scored = est.fit(tr).transform(te)
        score = vector_to_array("probability")[1]
    elif model == "svc":
        # the reference's penalty C multiplies a sum of losses, regParam a mean
        reg = 1.0 / (params["C"] * max(1, tr.count())) if "C" in params else params.get("regParam", 0.01)
        svc = LinearSVC(labelCol=label, featuresCol="features", regParam=reg,
                        maxIter=params.get("maxIter", 50))
        m = svc.fit(tr)
        # Platt scaling: a logistic fit on the margin gives probabilities
        margin = lambda d: m.transform(d).withColumn("_m", vector_to_array("rawPrediction")[1])
        platt = LogisticRegression(labelCol=label, featuresCol="_mv").fit(
            VectorAssembler(inputCols=["_m"], outputCol="_mv").transform(margin(tr).drop("prediction", "rawPrediction")))
        scored = platt.transform(VectorAssembler(inputCols=["_m"], outputCol="_mv").transform(
            margin(te).drop("prediction", "rawPrediction")))
        score = vector_to_array("probability")[1]
    elif model == "mlp":
        hidden = params.get("layers", [32, 16])
        est = MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", seed=seed,
                                             layers=[len(cols), *hidden, 2], maxIter=params.get("maxIter", 100),
                                             blockSize=params.get("blockSize", 128), solver=params.get("solver", "l-bfgs"),
                                             stepSize=params.get("stepSize", 0.03))
        scored = est.fit(tr).transform(te)
        score = vector_to_array("probability")[1]
    else:
        raise ValueError(f"model must be one of {MODELS}, got {model!r}")
    return scored.select(F.col(key), F.col(label).cast("int").alias("y_true"), score.alias("score"))


def knn_score(train: DataFrame, test: DataFrame, cols: list[str], label: str = "label", key: str = "id",
              k: int = 5, weights: str = "uniform", metric: str = "euclidean", **kw) -> DataFrame:
    vec = lambda d: d.select(F.col(key).alias("vec_id"), F.array(*[F.col(c).cast("double") for c in cols])
                             .alias("embedding"), F.col(label).alias("label"))
    tr, te = vec(train), vec(test)
    nn = knn_join(te, tr, k=k, metric=metric, **kw)
    votes = knn_classify(nn, tr, weights=weights)
    return (te.select(F.col("vec_id").alias(key), F.col("label").cast("int").alias("y_true"))
            .join(votes.select(F.col("query_id").alias(key), F.col("proba").alias("score")), key, "left")
            .fillna({"score": 0.0}))


METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")


def score_metrics(scored: DataFrame, threshold: float = 0.5) -> dict:
    """``METRICS`` of a scored frame at ``threshold``, and the best ``threshold`` by F1; one pass."""
    row = M.summaries(scored, threshold=threshold).first()
    return {m: row[m] for m in (*METRICS, "threshold")}


def run_parallel(fn, items, parallelism: int = 4) -> list:
    """Run independent driver-side fits concurrently (like
    ``CrossValidator(parallelism=...)``): each submits its own Spark jobs,
    so small fits share the cluster instead of queueing."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(fn, items))


def cv_run(df: DataFrame, cols: list[str], model: str = "gbt", k: int = 5, label: str = "label",
           key: str = "id", params: dict | None = None, seed: int = 42, threshold: float = 0.5,
           parallelism: int = 5) -> DataFrame:
    """Stratified k-fold: fit on k-1 folds, score the held-out fold.
    Returns one row per fold (fold, accuracy, precision, recall, f1,
    roc_auc, average_precision, and the best_threshold of its held-out rows)."""
    folded = compact(stratified_folds(df, label=label, key=key, k=k, seed=seed)).persist()

    def one(f):
        tr = folded.filter(F.col("fold") != f)
        va = folded.filter(F.col("fold") == f)
        m = score_metrics(fit_score(tr, va, cols, model, label, key, params, seed, compacted=True), threshold)
        return (f, *[float(m[x]) if m[x] is not None else None for x in
                     (*METRICS, "threshold")])

    rows = run_parallel(one, range(k), parallelism)
    folded.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, " + ", ".join(f"{m} double" for m in (*METRICS, "best_threshold")))


def cv_test_run(train: DataFrame, test: DataFrame, cols: list[str], model: str = "gbt", k: int = 5,
                label: str = "label", key: str = "id", params: dict | None = None, seed: int = 42,
                best_by: str = "roc_auc") -> DataFrame:
    """``cv_run`` with what follows from it: rows of part 'fold' (threshold
    0.5), their 'mean' (folds without a metric left out, as ``nanmean``), and
    'test': the model of the best fold (its number in ``fold``, ties to the
    first) on ``test``, at the threshold tuned on the rows of that fold, which
    the model has not seen."""
    folds = sorted(cv_run(train, cols, model, k, label, key, params, seed).collect(), key=lambda r: r["fold"])
    best = max(folds, key=lambda r: (r[best_by] is not None, r[best_by] or 0.0, -r["fold"]))
    kept = stratified_folds(train, label=label, key=key, k=k, seed=seed).filter(F.col("fold") != best["fold"])
    t = score_metrics(fit_score(kept, test, cols, model, label, key, params, seed), best["best_threshold"])

    def mean(m):
        known = [r[m] for r in folds if r[m] is not None]
        return sum(known) / len(known) if known else None

    rows = [("fold", r["fold"], 0.5, *[r[m] for m in METRICS]) for r in folds]
    rows += [("mean", None, 0.5, *[mean(m) for m in METRICS]), ("test", best["fold"], best["best_threshold"], *[t[m] for m in METRICS])]
    return train.sparkSession.createDataFrame(rows, "part string, fold int, threshold double, " + ", ".join(f"{m} double" for m in METRICS))


def param_grid(grid: dict[str, list]) -> list[dict]:
    """Cartesian product of hyper-parameter lists (configuration, not data)."""
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def random_subset(combos: list[dict], n: int, seed: int = 42) -> list[dict]:
    """``n`` combinations in seeded-hash order (reproducible)."""
    import hashlib
    keyed = sorted(combos, key=lambda c: hashlib.md5(f"{seed}|{sorted(c.items())}".encode()).hexdigest())
    return keyed[:n]


def search(df: DataFrame, cols: list[str], model: str, combos: list[dict], k: int = 3,
           label: str = "label", key: str = "id", seed: int = 42) -> DataFrame:
    """Mean CV metrics for each parameter combination of an MLlib model. Folds are dealt
    once, every fit only scores its fold, and all scores share one metric pass."""
    folded = compact(stratified_folds(df, label=label, key=key, k=k, seed=seed)).persist()
    folder = f"{checkpoint_dir(df.sparkSession)}/fits-{uuid.uuid4().hex}"

    def one(job):
        i, f = job
        scored = fit_score(folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f), cols, model, label, key, combos[i], seed, compacted=True)
        scored.select("y_true", "score").write.parquet(f"{folder}/combo={i}/fold={f}")

    run_parallel(one, [(i, f) for i in range(len(combos)) for f in range(k)], parallelism=8)
    folded.unpersist()
    folds = M.summaries(df.sparkSession.read.parquet(folder), ["combo", "fold"])
    names = df.sparkSession.createDataFrame([(i, str(sorted(p.items()))) for i, p in enumerate(combos)], "combo int, params string")
    return names.join(folds.groupBy("combo").agg(*[F.avg(m).alias(m) for m in ("accuracy", "f1", "roc_auc")]), "combo")


def best_of(results: DataFrame, metric: str = "f1") -> DataFrame:
    return results.agg(F.max_by(F.struct(*results.columns), F.struct(F.col(metric), -F.col("combo"))).alias("b")) \
        .select("b.*")


def knn_grid_scores(df: DataFrame, cols: list[str] | None = None, label: str = "label", key: str = "vec_id",
                    vec: str = "embedding", ks=(3, 5, 7, 9, 11), weights=("uniform", "distance"),
                    metrics=("euclidean", "minkowski", "manhattan"), folds: int = 3, seed: int = 42,
                    **knn_kw) -> DataFrame:
    """Grid search for KNN without refitting per setting: per fold and
    metric one neighbour table with the largest k; every (k, weights)
    setting is a filter plus a grouped vote over it. Returns the mean F1
    (threshold 0.5) per (metric, n_neighbors, weights)."""
    base = df.select(F.col(key).alias("vec_id"), F.col(vec).cast("array<double>").alias("embedding"),
                     F.col(label).alias("label"))
    folded = stratified_folds(base, label="label", key="vec_id", k=folds, seed=seed).persist()
    kmax = max(ks)
    # one join per metric serves all folds: neighbours come from other folds
    parts, tables = [], {}
    for metric in metrics:
        # minkowski with p=2 is the euclidean metric: one neighbour table serves both
        base_metric = "euclidean" if metric == "minkowski" else metric
        if base_metric not in tables:
            tables[base_metric] = knn_join(folded, folded, k=kmax, metric=base_metric, apart="fold", **knn_kw)
        parts.append(tables[base_metric].withColumn("metric", F.lit(metric)))
    nn = parts[0]
    for p in parts[1:]:
        nn = nn.unionByName(p)
    nn = nn.join(folded.select(F.col("vec_id").alias("query_id"), "fold"), "query_id")
    settings = F.explode(F.array(*[F.struct(F.lit(k).alias("n_neighbors"), F.lit(w).alias("weights"))
                                   for k in ks for w in weights]))
    lab = folded.select(F.col("vec_id").alias("neighbor_id"), F.col("label").alias("_y"))
    ex = (nn.join(lab, "neighbor_id").select("*", settings.alias("s")).select("*", "s.n_neighbors", "s.weights")
          .filter(F.col("rank") <= F.col("n_neighbors")))
    from pyspark.sql import Window
    grp = ["metric", "fold", "n_neighbors", "weights", "query_id"]
    zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(*grp))
    w = (F.when(F.col("weights") == "uniform", F.lit(1.0))
         .when(F.col("_z") == 1, (F.col("distance") == 0).cast("double"))
         .otherwise(1.0 / F.col("distance")))
    votes = (ex.withColumn("_z", zero).withColumn("_w", w)
             .groupBy(*grp).agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("proba"))
             .withColumn("y_pred", (F.col("proba") > 0.5).cast("int")))
    truth = folded.select(F.col("vec_id").alias("query_id"), F.col("label").alias("y_true"))
    per_fold = (votes.join(truth, "query_id")
                .groupBy("metric", "fold", "n_neighbors", "weights")
                .agg(F.sum(((F.col("y_true") == 1) & (F.col("y_pred") == 1)).cast("long")).alias("tp"),
                     F.sum(((F.col("y_true") == 0) & (F.col("y_pred") == 1)).cast("long")).alias("fp"),
                     F.sum(((F.col("y_true") == 1) & (F.col("y_pred") == 0)).cast("long")).alias("fn"))
                .withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"),
                                                                     F.lit(0)), F.lit(0.0))))
    return per_fold.groupBy("metric", "n_neighbors", "weights").agg(F.avg("f1").alias("mean_f1"))

