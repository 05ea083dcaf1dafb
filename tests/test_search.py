"""Searches: learners against gradients and separate fits, scores and metrics against brute force."""

import numpy as np

from riskloom.operators import learners as LN
from riskloom.operators import metrics as M
from riskloom.operators import models as MD
from riskloom.operators import search as SR
from riskloom.operators.split import stratified_folds

COLS = ["a", "b", "c"]


def table(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 5, n), rng.random(n)], 1)
    x[::17, 0] = np.nan
    y = ((np.nan_to_num(x[:, 0]) > 0.3) ^ (x[:, 1] == 2)).astype(float)
    return x, y


def test_prefix_of_a_fit_is_a_fit():
    x, y = table()
    trees = LN.BoostedTrees()
    trees.prepare(x, COLS)
    base = {"max_depth": 4, "learning_rate": 0.1, "subsample": 0.6, "colsample_bytree": 0.6, "gamma": 0.1}
    long = trees.fit(x, y, base | {"n_estimators": 40}, 5)
    got = trees.scores(long, x, [10, 25, 40])
    for n, p in zip((10, 25, 40), got):
        assert np.array_equal(p, trees.scores(trees.fit(x, y, base | {"n_estimators": n}, 5), x, [n])[0])
    assert ((got[-1] > 0.5) == y).mean() > 0.95


def test_trees_split_where_the_gain_is_greatest():
    """One stump against all cuts of all columns."""
    x, y = table(120, 3)
    x = np.nan_to_num(x)
    t = LN.BoostedTrees(bins=200)
    t.prepare(x, COLS)
    codes = t.codes(x)
    feature, cut, value = t.fit(x, y, {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0}, 0)[0]
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    g, h = w * (0.5 - y), w * 0.25
    best = max(((g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)), j, c)
               for j in range(3) for c in range(int(codes[:, j].max()))
               for m in [codes[:, j] <= c] if h[m].sum() >= 1 and h[~m].sum() >= 1)
    left = codes[:, feature[0]] <= cut[0]
    assert np.isclose(g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1), best[0])
    assert np.allclose(value[1:3], [-g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1)])


def test_network_gradients():
    x, y = table(30, 1)
    for act in LN.ACTIVATIONS:
        net = LN.EmbeddingNetwork(["b"])
        net.prepare(x, COLS)
        params = {"hidden_dims": (5, 4), "activation_name": act, "dropout": 0.3}
        model = net._start(params, np.random.default_rng(2))
        num, cats = net._inputs(x)
        run = lambda: net.gradients(model, num, cats, y, 3.0, params, np.random.default_rng(9))

        def loss():
            out, _ = net._forward(model, num, cats, params, np.random.default_rng(9))
            return (np.where(y == 1, 3.0, 1.0) * (np.logaddexp(0, out) - y * out)).mean()

        grad = run()
        for k, t in model.items():
            for at in [tuple(i // 2 for i in t.shape), tuple(i - 1 for i in t.shape)]:
                old = t[at]
                t[at] = old + 1e-6
                up = loss()
                t[at] = old - 1e-6
                down = loss()
                t[at] = old
                if not (k.startswith("e") and at[0] == 0):
                    assert np.isclose(grad[k][at], (up - down) / 2e-6, atol=1e-5), (act, k, at)


def frame(spark, x, y):
    nan = lambda v: None if np.isnan(v) else float(v)
    return spark.createDataFrame([(i, int(t), *map(nan, r)) for i, (r, t) in enumerate(zip(x, y))], "id long, label int, a double, b double, c double")


def test_every_row_is_scored_by_the_fits_of_other_folds(spark):
    x, y = table(150, 4)
    df = frame(spark, x, y)
    grid = [{"n_estimators": n, "max_depth": d, "learning_rate": 0.3} for d in (2, 3) for n in (3, 8)]
    assert [len(s) for _, s in SR.shared_fits(grid, "n_estimators")] == [2, 2]
    scored = SR.score_settings(df, COLS, LN.BoostedTrees(), grid, k=3)
    got = {}
    for r in scored.collect():
        got.setdefault((r.combo, r.fold), []).append((r.y_true, r.score))
    fold = {r.id: r.fold for r in stratified_folds(df, k=3).collect()}
    fold = np.array([fold[i] for i in range(len(y))])
    t = LN.BoostedTrees()
    t.prepare(x, COLS)
    for c, p in enumerate(grid):
        for f in range(3):
            use = fold != f
            want = t.scores(t.fit(x[use], y[use], p, 42), x[~use], [p["n_estimators"]])[0]
            assert np.allclose(sorted(got[c, f]), sorted(zip(y[~use].astype(int), want)))
    # the grouped metric pass equals one pass per fold
    folds = M.summaries(scored, ["combo", "fold"]).collect()
    assert len(folds) == 12
    for r in folds[:3]:
        one = scored.where(f"combo = {r.combo} AND fold = {r.fold}")
        m = MD.score_metrics(one)
        assert all(np.isclose(m[k], r[k]) for k in m)
        best = M.best_threshold(one).first()
        assert np.isclose(best.threshold, r.threshold) and np.isclose(best.f1, r.f1_at_threshold)
        assert np.isclose(M.pr_auc(one).first()[0], r.pr_auc)


def test_search_marks_one_best_and_bounds_its_sample(spark):
    x, y = table(300, 6)
    df = frame(spark, x, y)
    grid = MD.param_grid({"hidden_dims": [(16, 8)], "lr": [1e-2, 1e-4], "optimizer_name": ["adam", "sgd"], "n_epochs": [8]})
    res = SR.search(df, COLS, LN.EmbeddingNetwork(["b"]), grid, best_by="roc_auc", k=3).orderBy("combo").collect()
    assert [r.combo for r in res] == [0, 1, 2, 3] and sum(r.is_best for r in res) == 1
    best = next(r for r in res if r.is_best)
    assert best.roc_auc == max(r.roc_auc for r in res) and best.roc_auc > 0.8
    few = SR.score_settings(df, COLS, LN.BoostedTrees(), [{"n_estimators": 2, "max_depth": 2}], k=3, max_rows=100)
    assert few.count() == 300  # fitted on fewer rows, scored on all


def test_neighbour_information_equals_brute_force(spark):
    """Random data with ties, a class of one row, nulls, and blocks far smaller than the table."""
    from riskloom.operators import features as FE
    rng = np.random.default_rng(11)
    n = 160
    y = rng.integers(0, 3, n)
    y[0] = 9  # alone in its class
    a = rng.normal(size=n) + y % 3
    b = np.round(rng.normal(size=n), 1)
    b[20:60] = 0.5
    df = spark.createDataFrame([(int(t), float(u), None if i % 13 == 0 else float(v)) for i, (t, u, v) in enumerate(zip(y, a, b))], "label int, a double, b double")
    psi = lambda m: -np.euler_gamma + sum(1.0 / i for i in range(1, m))

    def brute(x, lab):
        use = np.array([(lab == t).sum() > 1 for t in lab])
        x, lab = x[use], lab[use]
        terms = []
        for i in range(len(x)):
            d = np.sort(np.abs(x[(lab == lab[i]) & (np.arange(len(x)) != i)] - x[i]))
            k = min(3, len(d))
            r = d[k - 1]
            m = int((x == x[i]).sum() if r == 0 else ((x > x[i] - r) & (x < x[i] + r)).sum())
            terms.append(psi(k) - psi(len(d) + 1) - psi(max(1, m)))
        return max(0.0, psi(len(x)) + np.mean(terms))

    use = np.arange(n) % 13 != 0
    want = {"a": brute(a, y), "b": brute(b[use], y[use])}
    for rows in (250_000, 10):
        got = {r.feature: r.mutual_info for r in FE.knn_mutual_information(df, ["a", "b"], rows=rows).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[c], want[c]) for c in want), rows
    exact = FE.mutual_information(df.withColumn("c", df.label * 2), ["a", "c"])
    assert {r.feature for r in exact.collect()} == {"a", "c"}
    big = spark.range(1, 300).select(FE.digamma(FE.F.col("id")).alias("p"), "id")
    assert all(np.isclose(r.p, psi(r.id), atol=1e-13) for r in big.collect())


def test_trees_hold_one_column_at_a_time_and_leaves_are_walked_right():
    import tracemalloc
    rng = np.random.default_rng(8)
    n, d = 20_000, 60
    x = rng.integers(0, 40, (n, d)).astype(float)
    y = (x[:, 0] + rng.normal(size=n) * 9 > 25).astype(float)
    t = LN.BoostedTrees()
    t.prepare(x, [str(i) for i in range(d)])
    codes = t.codes(x)
    tracemalloc.start()
    trees = t.fit(x, y, {"n_estimators": 2, "max_depth": 4, "learning_rate": 0.3, "gamma": 60.0}, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * d  # no whole number or double per row and column
    for feature, cut, value in trees:
        assert (feature[:15] < 0).any()  # leaves above the last level
        got = t._leaf_values((feature, cut, value), codes)
        for i in range(0, n, 97):
            at = 0
            while feature[at] >= 0:
                at = 2 * at + 1 + int(codes[i, feature[at]] > cut[at])
            assert got[i] == value[at]


def test_inputs_made_once_serve_all_models():
    """Scores of shared inputs, over several blocks of rows, against each model's forward pass; weights against steps array by array."""
    x, y = table(LN.BLOCK + 300, 2)
    net, trees = LN.EmbeddingNetwork(["b"]), LN.BoostedTrees()
    for learner in (net, trees):
        learner.prepare(x, COLS)
    inputs = net.inputs(x)
    for p in MD.param_grid({"hidden_dims": [(6, 4)], "lr": [1e-2], "optimizer_name": ["adam", "sgd"], "activation_name": list(LN.ACTIVATIONS), "dropout": [0.2]}):
        model = net.fit(x[:150], y[:150], p | {"n_epochs": 2}, 42)
        want = LN.sigmoid(net._forward(model["weights"], *inputs, p)[0])
        assert np.allclose(net.scores_of(model, inputs, [None])[0], want, rtol=1e-12)
        assert np.array_equal(net.scores_of(model, inputs, [None])[0], net.scores(model, x, [None])[0])
    model = trees.fit(x, y, {"n_estimators": 3, "max_depth": 2}, 1)
    assert all(map(np.array_equal, trees.scores_of(model, trees.inputs(x), [1, 3]), trees.scores(model, x, [1, 3])))
    # one step of each optimizer
    rng, p = np.random.default_rng(5), {"hidden_dims": (6, 4), "batch_size": 64, "n_epochs": 1, "lr": 0.1}
    num, cats = net._inputs(x[:64])
    start = net._start(p, rng)
    order = rng.permutation(64)
    grad = net.gradients(start, num[order], [c[order] for c in cats], y[order], max(1.0, (y[:64] == 0).sum()) / (y[:64] == 1).sum(), p, rng)
    for name, step in (("sgd", lambda g: 0.1 * g), ("adam", lambda g: 0.1 * g / (np.abs(g) + 1e-8))):
        got = net.fit(x[:64], y[:64], p | {"optimizer_name": name}, 5)["weights"]
        assert got.keys() == start.keys() and all(np.allclose(got[k], start[k] - step(grad[k]), atol=1e-5) for k in start)


def test_fits_take_all_rows_however_few_are_in_memory(spark):
    """Cuts, means, categories and fits from all rows: scores do not hang on ``max_rows``, and equal fits on plain arrays."""
    x, y = table(300, 6)
    df = frame(spark, x, y).repartition(7)
    fold = {r.id: r.fold for r in stratified_folds(df, k=3).collect()}
    fold = np.array([fold[i] for i in range(len(y))])
    for learner, p in ((LN.BoostedTrees(), {"n_estimators": 5, "max_depth": 3, "subsample": 0.7, "learning_rate": 0.3}),
                       (LN.EmbeddingNetwork(["b"]), {"hidden_dims": (6, 4), "lr": 1e-2, "n_epochs": 2, "dropout": 0.2})):
        plain = type(learner)(*[learner.categorical] if learner.staged is None else [])
        plain.prepare(x, COLS)
        want = np.zeros(len(y))
        for f in range(3):
            want[fold == f] = plain.scores(plain.fit(x[fold != f], y[fold != f], p, 42), x[fold == f], [p.get("n_estimators")])[0]
        for rows in (37, 100, 1 << 16):
            got = SR.score_settings(df, COLS, learner, [p], k=3, max_rows=rows).collect()
            for f in range(3):
                mine = sorted((r.y_true, r.score) for r in got if r.fold == f)
                assert np.allclose(mine, sorted(zip(y[fold == f].astype(int), want[fold == f])), atol=1e-6), (p, rows)


def test_learners_are_prepared_from_a_frame_as_from_arrays(spark):
    x, _ = table(211, 9)
    rows = frame(spark, x, np.zeros(len(x))).select(SR.F.array("a", "b", "c").alias("x"))
    trees, plain = LN.BoostedTrees(), LN.BoostedTrees()
    trees.prepare_from(rows, COLS)
    plain.prepare(x, COLS)
    assert all(map(np.array_equal, trees.cuts, plain.cuts)) and len(plain.cuts[0]) > 50
    net, other = LN.EmbeddingNetwork(["b"]), LN.EmbeddingNetwork(["b"])
    net.prepare_from(rows, COLS)
    other.prepare(x, COLS)
    assert (net.cat, net.num) == (other.cat, other.num) and np.array_equal(net.values[0], other.values[0])
    assert np.allclose(net.mean, other.mean, rtol=1e-11) and np.allclose(net.std, other.std, rtol=1e-11)
    num, cats = net.inputs(x)
    back = net._unpacked(net.packed(x))
    assert np.array_equal(back[0], num) and np.array_equal(back[1][0], cats[0])


def test_fits_are_dealt_by_cost():
    got = SR.dealt([5, 1, 1, 1, 1, 1], 2)
    assert sorted(sum(got, [])) == list(range(6)) and sorted(map(len, got)) == [1, 5]
