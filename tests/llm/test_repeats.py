import hashlib

import numpy as np

from riskloom.llm import bucket_pointers as BP
from riskloom.llm import queries as Q
from riskloom.sources.tables import read_table


def brute(rows, length):
    """Every window in a dictionary of first places; (doc_id, n_bytes, n_removed, n_spans, kept)."""
    texts = [(i is None, i or 0, (t or "").encode()) for i, t in rows]
    first = {}
    for none, doc, t in texts:
        for s in range(len(t) - length + 1):
            w, place = t[s:s + length], (none, doc, s)
            first[w] = min(first.get(w, place), place)
    out = []
    for (i, _), (none, doc, t) in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if first[t[s:s + length]] < (none, doc, s):
                gone[s:s + length] = True
        runs = int((gone[1:] < gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=str)


def some_texts(rng, n, words=40):
    """Texts that share passages, lines and copies of each other."""
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(words)]
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(vocabulary, rng.integers(0, 90)))
        if out and rng.random() < 0.7:
            other = out[rng.integers(0, len(out))]
            a, b = sorted(rng.integers(0, len(other) + 1, 2))
            t = t[:rng.integers(0, len(t) + 1)] + other[a:b] + t
        if rng.random() < 0.5:
            t += "\nthis line stands in very many of these documents, word for word\n"
        out.append(t)
    return out


def test_refinement_equals_string_comparison():
    rng = np.random.default_rng(0)
    for length in (32, 33, 64, 100):
        for letters in (1, 2, 4):
            data = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
            data[1500:1900] = data[200:600]
            stop = np.sort(np.append(rng.choice(3000, 6, replace=False), 3000))
            room = stop[np.searchsorted(stop, np.arange(3000), side="right")] - np.arange(3000)
            at, pointer = BP.refine(data, room, length)
            seen = {}
            for i in np.flatnonzero(room >= length).tolist():
                seen.setdefault(data[i:i + length].tobytes(), []).append(i)
            want = sorted(v for v in seen.values() if len(v) > 1)
            got = {}
            for i, p in zip(at.tolist(), pointer.tolist()):
                got.setdefault(p, []).append(i)
            assert sorted(sorted(v) for v in got.values()) == want


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(1)
    for data in (rng.integers(97, 101, 5000), np.full(700, 120), np.tile([97, 98, 99], 300), rng.integers(0, 256, 100)):
        data = data.astype(np.uint8)
        plain = BP.Frequent(np.zeros(0, np.uint64))
        for frequent in (plain, BP.Frequent(np.unique(BP.gram_order(data))[::3])):
            first, count, key, twice = BP.segments(data, 100, frequent)
            assert first[0] == 0 and (first[1:] == (first + count)[:-1]).all() and first[-1] + count[-1] == len(data) - 99
            keys = {}
            for f, c, k in zip(first, count, key):
                for s in range(f, f + c):
                    assert keys.setdefault(data[s:s + 100].tobytes(), k) == k  # equal windows have equal keys
            for f, c, t in zip(first, count, twice):
                seen = {data[s:s + 100].tobytes() for s in range(f, f + c)}
                assert t or len(seen) == c


def check(spark, rows, length=100, **options):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, start int, `end` string, digest int")
    got = BP.remove_repeats(df, length, **options)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()), key=str) == brute(rows, length)


def test_shared_passages(spark):
    rng = np.random.default_rng(2)
    texts = some_texts(rng, 250)
    rows = list(zip(rng.permutation(1000)[:250].tolist(), texts))
    check(spark, rows, 100, draw=50, share=10)
    check(spark, rows[:120], 33, group=500)


def test_edges(spark):
    rng = np.random.default_rng(5)
    base = some_texts(rng, 12, 200)
    long_line = "z" * 3000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x" * 99), (5, "x" * 100), (6, "x" * 101), (7, long_line), (8, "ab" * 400), (9, "aab" * 90 + "c" + "aab" * 90)]
    rows += [(10 + i, t) for i, t in enumerate(base)]
    rows += [(10, base[0]), (10, base[0]), (11, base[3] * 3), (11, base[3] * 2 + base[1]), (None, base[2] * 3), (None, base[2] * 3), (None, base[4] + base[2] * 2), (None, None)]
    rows += [(-5, base[5] * 2), (1 << 40, "é" * 80 + base[6])]
    check(spark, rows)
    check(spark, rows[:3])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert BP.remove_repeats(df.where("false")).collect() == []


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    t = " ".join(rng.choice(words, 3000))
    for size in (100, 137, 5000):
        monkeypatch.setattr(BP, "PIECE", size)
        plain = BP.Frequent(np.zeros(0, np.uint64))
        held = [(d, False, d, 0, BP.segments(p, 100, plain)[2].tolist(), at, p) for d, text in ((1, t), (2, t[5000:9000] + t)) for at, p in BP.pieces(text.encode(), 100)]
        table = BP.pa.Table.from_batches([BP.different(held[i:i + 7], 100, plain) for i in range(0, len(held), 7)])
        known = table.filter(table.column("key").is_valid())
        alone = table.filter(table.column("key").is_null())
        gone = {1: np.zeros(len(t), bool), 2: np.zeros(len(t) + 4000, bool)}
        for b in BP.compare(known, 100, 1 << 12):
            for d, s, e in zip(*(b.column(c).to_pylist() for c in ("doc", "start", "end"))):
                gone[d][s:e] = True
        for d, s, n in zip(*(alone.column(c).to_pylist() for c in ("doc", "start", "windows"))):
            gone[d][s:s + n + 99] = True
        want = {r[0]: r[2] for r in brute([(1, t), (2, t[5000:9000] + t)], 100)}
        assert {d: int(g.sum()) for d, g in gone.items()} == want


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    got = Q.R.queries["op12_bucket_pointers"](spark, sf)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == ["doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"]
    want = sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows, 100)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
