import numpy as np

from riskloom.llm import angular_negatives as AN
from riskloom.llm import queries as Q
from riskloom.sources.tables import read_table
from pyspark.sql import functions as F

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """All pairs in Python integers over (vec_id, label, vector) rows."""
    kept = {(i, lab, tuple(int(np.floor(scale * float(x))) for x in v)) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a[2], b[2])), b) for b in kept if b != a and len(b[2]) == len(a[2])]
        same = sorted((s, b[0]) for s, b in scored if b[1] == a[1])[:positives]
        other = sorted((s, b[0]) for s, b in scored if b[1] != a[1])
        for s, p in same:
            hard = [(t, q) for t, q in other if low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a[0], p, r + 1, q, -s, -t) for r, (t, q) in enumerate(hard)]
    return sorted(out)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for width in (1, 2, 5, 64):
        x = np.floor(rng.normal(size=(300, width)) * rng.choice([0, 3, 200], (300, 1)))
        a = np.floor(rng.normal(size=(40, width)) * 100)
        a[0] = x[1]
        n, m = np.linalg.norm(x, axis=1), np.linalg.norm(a, axis=1)
        book = AN.spread_directions(x, 6)
        theta = AN.angles_to(x, n, book).astype(np.float32).astype(float)
        alpha = AN.angles_to(a, m, book).astype(np.float32).astype(float)
        for at in range(0, 300, 7):
            t = theta[at:at + 7]
            low, high = AN.score_bounds(alpha, m, t.min(0), t.max(0), n[at:at + 7].min(), n[at:at + 7].max())
            s = a @ x[at:at + 7].T
            assert (low[:, None] <= s).all() and (s <= high[:, None]).all()


def side(x, labels, book):
    n = np.linalg.norm(x, axis=1)
    return {"row": np.arange(len(x)), "id": np.arange(len(x)) // 2, "label": labels, "v": x.astype(np.int64), "norm": n, "angles": AN.angles_to(x, n, book)}


def test_filter_leaves_out_tiles_and_no_result():
    """Rows in tight bundles: far bundles are never scored."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = np.floor(2000 * (centres[rng.integers(0, 20, 6000)] + 0.01 * rng.normal(size=(6000, 16))))
    labels = rng.integers(0, 3, 6000)
    rows = side(x, labels, AN.spread_directions(x, 16))
    anchors = {k: v[:50] for k, v in rows.items()}
    which, none = np.arange(50), np.full(50, AN.NO_LIMIT)
    got, scored = AN.best_in_windows(anchors, rows, which, -none, none, True, 5)
    s = anchors["v"] @ rows["v"].T
    for i in range(50):
        order = sorted((-s[i, j], rows["id"][j], j) for j in range(6000) if labels[j] == labels[i] and j != i)[:5]
        assert [(-a, b, c) for a, b, c in order] == [tuple(e[1:]) for e in got.tolist() if e[0] == i]
    assert scored < 0.5 * s.size


def test_small_tables(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(0, 3)), [float(t) for t in centres[rng.integers(0, 6)] + 0.3 * rng.normal(size=8)]) for i in range(400)]
    rows += [(i, 1, rows[0][2]) for i in range(400, 430)]  # ties
    rows += [rows[0]] * 40 + [(0, 2, rows[7][2]), (10, 1, rows[8][2])]  # repeated rows, shared ids
    rows += [(500, 1, [0.0] * 8), (510, 1, [-0.001] * 8), (520, 9, [1.0] * 8), (530, 1, [1.0] * 5), (531, 1, [2.0] * 5), (532, 2, [1.0] * 5), (540, 1, []), (541, 1, []), (542, 2, [])]
    rows += [(550, None, [1.0] * 8), (560, 1, None), (570, 1, [None] + [1.0] * 7), (580, 1, [float("nan")] * 8), (590, 1, [float("-inf")] + [0.0] * 7), (None, 1, [1.0] * 8)]
    df = spark.createDataFrame([(i, lab, v, 5, 1.0) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, row int, score double")
    want = brute(rows, every=10, scale=1000)
    for block, directions in ((50, 1), (64, 5), (100_000, 16)):
        got = AN.mine(df, F.col("vec_id") % 10 == 0, scale=1000, block=block, directions=directions, sample=100)
        assert sorted(map(tuple, got.collect())) == want
    assert AN.mine(df.where("false"), F.col("vec_id") % 10 == 0).collect() == []
    named = df.withColumn("label", F.concat(F.lit("l"), F.col("label").cast("string")))
    assert sorted(map(tuple, AN.mine(named, F.col("vec_id") % 10 == 0, scale=1000).collect())) == want


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in read_table(spark, sf, "embeddings").collect()]
    got = Q.R.queries["op13_angular_negatives"](spark, sf)
    assert ", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in got.schema) == SCHEMA
    assert sorted(map(tuple, got.collect())) == brute(rows)
