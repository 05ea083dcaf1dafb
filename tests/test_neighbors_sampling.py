"""Exact kNN against numpy brute force (including a hot cell of
duplicates), and resampling invariants."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import sampling as SM
from riskloom.operators import split as P
from riskloom.operators.neighbors import knn_join
from riskloom.sources import fixtures as FX


def _brute(q, b, qid, bid, k, metric="euclidean", exclude_self=False):
    out = {}
    for i, x in enumerate(q):
        d = np.abs(b - x).sum(1) if metric == "manhattan" else np.sqrt(((b - x) ** 2).sum(1))
        order = sorted(range(len(b)), key=lambda j: (d[j], bid[j]))
        if exclude_self:
            order = [j for j in order if bid[j] != qid[i]]
        out[qid[i]] = [bid[j] for j in order[:k]]
    return out


def test_knn_matches_brute_force_with_hot_cell(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(300, 6))
    pts[:120] = pts[0]                     # a third of the rows are one point
    pts[120:150] = rng.normal(scale=1e-3, size=(30, 6)) + 5
    ids = list(range(300))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in zip(ids, pts)], "vec_id long, embedding array<double>")
    for metric in ("euclidean", "manhattan"):
        got = knn_join(df, df, k=4, metric=metric, exclude_self=True, block_rows=16)
        res = {}
        for r in got.orderBy("query_id", "rank").collect():
            res.setdefault(r["query_id"], []).append(r["neighbor_id"])
        assert res == _brute(pts, pts, ids, ids, 4, metric, exclude_self=True)


def test_knn_fixture_sums(spark, sf):
    v = FX.vectors(spark, sf)
    r = knn_join(v.filter("vec_id < 20"), v.filter("vec_id >= 20"), k=5, block_rows=64)
    agg = r.agg(F.sum("neighbor_id"), F.sum("distance")).first()
    assert agg[0] == 26868 and abs(agg[1] - 115.83684) < 1e-4


def test_resamplers_balance(spark, sf):
    v = FX.vectors(spark, sf)
    sets = SM.make_sampled_sets(v, key="vec_id", block_rows=64)
    counts = {name: sorted(r["count"] for r in df.groupBy("label").count().collect()) for name, df in sets.items()}
    assert counts["original"] == [96, 404]
    assert counts["ros"] == [404, 404] and counts["rus"] == [96, 96] and counts["smote"] == [404, 404]


def test_smote_points_on_segments(spark, sf):
    v = FX.vectors(spark, sf)
    syn = SM.smote(v, key="vec_id", block_rows=64).collect()
    vec = {r["vec_id"]: np.array(r["embedding"]) for r in v.collect()}
    lab = {r["vec_id"]: r["label"] for r in v.collect()}
    for r in syn[:50]:
        a, b = vec[r["base_id"]], vec[r["neighbor_id"]]
        assert lab[r["base_id"]] == lab[r["neighbor_id"]] == 1
        assert np.allclose(np.array(r["embedding"]), a + r["gap"] * (b - a))
        assert 0.0 <= r["gap"] < 1.0


def test_folds_stratified(spark, sf):
    s = P.stratified_folds(FX.scored(spark, sf), label="y_true", key="row_id", k=5)
    sizes = {}
    for r in s.groupBy("y_true", "fold").count().collect():
        sizes.setdefault(r["y_true"], []).append(r["count"])
    for v in sizes.values():
        assert len(v) == 5 and max(v) - min(v) <= 1


def test_knn_groups_folds_and_blocks(spark):
    """Groups, folds, blocks of every size and near ties against brute force."""
    rng = np.random.default_rng(7)
    pts = np.round(rng.normal(size=(240, 5)), 1)
    pts[100:140] = pts[100] + 1e-9 * rng.normal(size=(40, 5))  # closer than the dot-product form can tell
    pts[140:150] *= 1e6
    rows = [(i, int(i % 3), int(i % 4), p.tolist()) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "vec_id long, run int, fold int, embedding array<double>")
    for metric in ("euclidean", "manhattan"):
        want = {}
        for i, run, fold, x in rows:
            base = [j for j, r, f, _ in rows if r == run and f != fold]
            d = pts[base] - pts[i]
            d = np.abs(d).sum(1) if metric == "manhattan" else np.sqrt((d * d).sum(1))
            order = sorted(range(len(base)), key=lambda t: (d[t], base[t]))[:6]
            want[run, i] = [(base[t], d[t]) for t in order]
        for block in (None, 16, 7):
            got = {}
            for r in knn_join(df, df, k=6, metric=metric, within="run", apart="fold", block_rows=block).orderBy("query_id", "rank").collect():
                got.setdefault((r["run"], r["query_id"]), []).append((r["neighbor_id"], r["distance"]))
            assert got == want


def test_knn_lsh_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8)) * 5
    pts = centres[rng.integers(0, 30, 900)] + rng.normal(size=(900, 8)) * 0.3
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "vec_id long, embedding array<double>")
    exact = {(r[0], r[1]): r[3] for r in knn_join(df, df, k=5, exclude_self=True).collect()}
    near = {(r[0], r[1]): r[3] for r in knn_join(df, df, k=5, exclude_self=True, method="lsh", bucket_length=2.0, block_rows=100).collect()}
    hit = [p for p in near if p in exact]
    assert len(hit) >= 0.9 * len(exact) and all(near[p] == exact[p] for p in hit)
    assert knn_join(df.where("false"), df, k=3).collect() == [] and knn_join(df, df.where("false"), k=3).collect() == []


def test_kernel_compares_few_pairs_exactly(monkeypatch):
    """Bounds leave few pairs open under both metrics; equal vectors, outliers, infinite components."""
    from riskloom.operators import neighbors as N
    rng = np.random.default_rng(11)
    q, b = rng.normal(size=(150, 24)), rng.normal(size=(5000, 24))
    b[7] *= 1e6
    b[9, 3] = np.inf
    q[5, 0] = -np.inf
    b[20:30] = q[:10]
    b[20:30] += np.where(np.arange(10) % 2, 0.0, 1e-12)[:, None]
    seen = []
    exact = N._exact
    monkeypatch.setattr(N, "_exact", lambda x, y, metric: seen.append(np.broadcast_shapes(x.shape, y.shape)[:-1]) or exact(x, y, metric))
    for metric in ("euclidean", "manhattan"):
        seen.clear()
        r, c, dist = N.nearest_in_block(q, b, 4, metric)
        assert sum(int(np.prod(s)) for s in seen) < 0.05 * len(q) * len(b)
        real = [j for j in range(len(b)) if j != 9]
        for i in range(len(q)):
            d = np.abs(b - q[i]).sum(1) if metric == "manhattan" else np.sqrt(((b - q[i]) ** 2).sum(1))
            want = [] if i == 5 else sorted(real, key=lambda j: (d[j], j))[:4]
            assert c[r == i].tolist() == want and np.array_equal(dist[r == i], d[want])


def test_kernel_keeps_first_of_equal_vectors():
    from riskloom.operators.neighbors import first_copies
    v = np.array([[1.0, 2.0], [3.0, 4.0], [1.0, 2.0], [1.0, 2.0], [3.0, 4.0]])
    assert first_copies(v, None, 2).tolist() == [0, 1, 2, 4]
    assert first_copies(v, np.array([0, 0, 1, 0, 0]), 1).tolist() == [0, 1, 2]


def test_blocks_come_from_the_size_of_each_group(spark):
    from riskloom.operators.neighbors import grid_of_groups
    per_group = spark.createDataFrame([("a", 40, 40), ("b", 40, 41), ("c", 0, 9), ("d", 100, 40)], "grp string, n_q long, n_b long")
    assert sorted(map(tuple, grid_of_groups(per_group, 40, 40).collect())) == [("a", 1, 1), ("b", 1, 2), ("d", 3, 1)]
