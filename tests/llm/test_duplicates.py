"""SimHash (7), embeddings (9) and components against brute force."""
import random
import re

import numpy as np
import xxhash

from riskloom.llm import multi_index as MI
from riskloom.llm import simhash_tiles as SH
from riskloom.llm.components import connected_components, spanning_edges
from riskloom.sources.tables import read_table


def components_of(n, near):
    label = list(range(n))
    for i in range(n):
        todo = [i] if label[i] == i else []
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(near[a]):
                if label[b] != i and b != i and label[b] > i:
                    label[b] = i
                    todo.append(int(b))
    return label


def test_connected_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 900)]
    pairs = chain + star + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = np.zeros((1100, 1100), bool)
    for a, b in pairs:
        if a is not None and a != b:
            near[a, b] = near[b, a] = True
    want = {i: c for i, c in enumerate(components_of(1100, near)) if near[i].any()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    node, root = spanning_edges((np.array([3, 2, 5]), np.array([2, 1, 6])), 8)
    assert dict(zip(node.tolist(), root.tolist())) == {2: 1, 3: 1, 6: 5}


def reference_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(rows, got, radius=3):
    fps = np.array([reference_fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = components_of(len(rows), near)
    ids = {}
    for (d, _), c in zip(rows, label):
        if d is not None:
            ids[c] = min(d, ids.get(c, d))
    want = sorted(((d, f"{f:016x}", ids.get(c)) for (d, _), f, c in zip(rows, fps.tolist(), label)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_simhash(spark, edge_docs, no_docs):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    check_simhash([tuple(r) for r in docs.collect()], SH.simhash_components(docs).collect())
    small = edge_docs.where("length(text) < 50000 OR text IS NULL")
    check_simhash([(r.doc_id, r.text) for r in small.collect()], SH.simhash_components(small, block=1).collect())
    assert SH.simhash_components(no_docs).count() == 0


def test_simhash_tiles_miss_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.component for r in connected_components(SH.fingerprint_edges(df, 3, block=16)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = components_of(len(fps), near)
    groups, found = {}, {}
    for x, c in zip(fps.view(np.int64).tolist(), label):
        groups.setdefault(c, set()).add(x)
        found.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def check_embeddings(rows, got, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, (k, v) in enumerate(rows) if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = np.zeros((len(rows), len(rows)), bool)
    x = np.array([v / np.abs(v).max() for _, v in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = [i for i, _ in ok]
    near[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = components_of(len(rows), near)
    want = sorted((k, int(near[i].sum()), rows[label[i]][0], label[i] == i) for i, (k, _) in enumerate(rows))
    assert sorted(map(tuple, got)) == want


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        centre = rng.normal(size=8)
        for _ in range(rng.integers(1, 12)):
            v = centre + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.25])
            rows.append((len(rows), [float(x) for x in v]))
    rows += [(len(rows) + i, rows[3][1]) for i in range(5)]
    for v in (None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0] * 5, []):
        rows.append((len(rows), v))
    rows.append((len(rows), [1e-300 * x for x in rows[0][1]]))
    rows.append((len(rows), [1e300 * x for x in rows[0][1]]))
    df = spark.createDataFrame([(k, v, k % 3) for k, v in rows], "vec_id long, embedding array<double>, label int")
    check_embeddings(rows, MI.near_duplicates(df, recall=1.0, cell=8, unit=16).collect())
    assert MI.near_duplicates(df.where("false")).count() == 0
    assert [tuple(r) for r in MI.near_duplicates(df.where("embedding IS NULL")).collect()] == [(rows[-9][0], 0, rows[-9][0], True)]


def test_vectors_of_several_lengths(spark):
    """Links of the rarer length are found too, none between lengths."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(12)]
    rows += [(20 + i, [float(x) for x in rng.normal(size=5)]) for i in range(6)]
    rows += [(40, rows[2][1]), (41, rows[14][1]), (42, [2 * x for x in rows[14][1]]), (43, rows[2][1][:5]), (44, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in MI.near_duplicates(df, recall=1.0, cell=4, unit=8).collect()}
    assert len(got) == len(rows)
    assert got[2] == (1, 2, True) and got[40] == (1, 2, False)
    assert got[22] == (2, 22, True) and got[41] == (2, 22, False) and got[42] == (2, 22, False)
    assert got[43][:1] == (0,) and got[44] == (0, 44, True)


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    got = [a[i] + b[j] for i, j in MI.multi_sequence(a, b, 63)]
    assert np.allclose(got, np.sort((a[:, None] + b).ravel()))


def test_embedding_recall(spark):
    """Production parameters against all pairs of the sf0.01 table."""
    e = read_table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = e.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in MI.near_duplicates(e).collect()}
    found = sum(got.values())
    assert found <= near.sum() and found >= 0.9 * near.sum()
