import hashlib

import numpy as np

from riskloom.llm import centroid_walk as CW
from riskloom.llm import queries as Q
from riskloom.sources.tables import read_table

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=8, rounds=10, width=64, scale=1024, seed="3"):
    """Lloyd's rounds in Python integers over (vec_id, vector) rows."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    x = np.array([v for _, v in kept], object).reshape(len(kept), width)

    def assign():
        d = np.array([[int(((v - np.array(c, object)) ** 2).sum()) for c in centres] for v in x])
        near = d.argmin(1)
        return near, d[np.arange(len(x)), near]

    for _ in range(rounds):
        near, _ = assign()
        centres = [[int(t) // int((near == j).sum()) for t in x[near == j].sum(0)] if (near == j).any() else c for j, c in enumerate(centres)]
    near, far = assign()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, int(c), int(d), int(far[near == c].sum()), int(far.sum()), names[c]) for (i, _), c, d in zip(kept, near, far)), key=str)


def test_walk_is_exact_and_stops_early():
    rng = np.random.default_rng(1)
    for k, width, span in [(1, 3, 5), (8, 64, 300), (40, 2, 1000), (30, 4, 3)]:
        c, x = rng.integers(-span, span + 1, (k, width)), rng.integers(-span, span + 1, (400, width))
        c[k // 2] = c[0]  # a tie
        x[:20] = c[rng.integers(0, k, 20)]
        near, far, steps = CW.CentroidLists(c).nearest(x)
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (near == d.argmin(1)).all() and (far == d.min(1)).all()
        assert steps.max() <= k
        if (k, width) == (40, 2):
            assert steps.mean() < k / 2


def test_small_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.normal(size=4)]) for i in range(60)]
    rows += [(5, rows[5][1])] * 3 + [(5, rows[9][1]), (None, rows[1][1]), (-7, [2.5, -2.5, 0.0, -0.0])]
    rows += [(100 + i, v) for i, v in enumerate([None, [], [1.0] * 3, [1.0] * 5, [None] + [1.0] * 3, [float("nan")] * 4, [float("inf")] + [0.0] * 3])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, `distance` string, v int")
    for k in (1, 6, 100):
        got = CW.cluster(df, k=k, rounds=3, width=4)
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, 3, 4)
    assert CW.cluster(df.where("false"), width=4).collect() == []
    assert CW.cluster(df.where("vec_id >= 100"), width=4).columns == COLUMNS


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, sf, "embeddings").collect()]
    got = Q.R.queries["op11_centroid_walk"](spark, sf)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
