"""Token counts (8), packing (3) and the piece lattice (10) against the libraries."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import kk_packing as KK
from riskloom.llm import lattice as LA
from riskloom.llm import segments as S
from riskloom.llm import token_counts as TC
from riskloom.llm.queries import PIECE_MODEL, R
from riskloom.sources.tables import read_table

WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab  \n.é中😀▁<s|e>0123'\"ÉΣ́\u0085\xa0_\x1c\t"


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


@pytest.fixture(scope="module")
def fuzz():
    rng = random.Random(4)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50))) for _ in range(1500)]


def test_hash_table_and_long_texts_in_chunks():
    cut = S.class_cuts(np.arange(256) == 32)
    texts = [b"", b"ab " * 1000, b"y" * 5000, b"a b"]
    got = [b""] * len(texts)
    for ids, parts in S.chunks(texts, cut, size=256):
        for i, p in zip(ids, parts):
            got[i] += p
    assert got == texts
    t = S.HashTable(12)
    keys = np.arange(1, 2001, dtype=np.uint64) << np.uint64(52)
    keys = np.unique(np.concatenate([keys, np.arange(1, 500, dtype=np.uint64)]))[1:1900]
    keys = keys[keys != 0]
    t.insert(keys, np.arange(len(keys), dtype=np.int32))
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(np.array([12345678901], np.uint64)) == -1).all()


def test_counts_equal_library(spark, sp, fuzz, edge_docs, no_docs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(fuzz)], "doc_id long, text string")
    for docs in (df, edge_docs):
        got = sorted(map(tuple, TC.token_counts(docs, PIECE_MODEL).collect()), key=str)
        want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in docs.collect()), key=str)
        assert got == want
    assert TC.token_counts(no_docs, PIECE_MODEL).count() == 0


def test_small_cache_gives_the_same_counts(sp, fuzz):
    c = TC.Counter(PIECE_MODEL, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    c.second.limit = 50
    for _ in range(2):
        assert c.count(fuzz)[1].tolist() == [len(sp.encode(t)) for t in fuzz]


def test_word_ids_equal_library(fuzz):
    tok = Tokenizer.from_file(WORDS)
    texts = [*fuzz, None, "", "Don't <|startoftext|> stop", "ΑΣ ΣΑΣ"]
    for t, ids in zip(texts, KK.WordTokenizer(WORDS)(texts)):
        assert ids.tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_differencing_balances():
    rng = np.random.default_rng(0)
    for m, k in ((1, 1), (5, 3), (200, 17), (3, 5)):
        sizes = rng.integers(1, 500, m)
        where = KK.differencing(sizes, k)
        assert len(where) == m and where.min() >= 0 and where.max() < k
    sums = np.bincount(KK.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]  # the textbook case of differencing
    where, offset = KK.pack_group(np.full(9, 500), 2048)
    assert np.bincount(where).max() <= 4 and offset.max() <= 1500  # nine halves need a third window


def check_packing(docs, packed, window):
    tok = Tokenizer.from_file(WORDS)
    want = sorted((str(r.doc_id), np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in docs.collect())
    rows = packed.collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
    # every id in exactly one piece: pieces of the documents, as a multiset
    pieces = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    expect = sorted((d, s, e - s, zlib.crc32(raw[4 * s:4 * e]), len(raw) // 4)
                    for d, raw in want for c in [KK.cut_points(len(raw) // 4, window, min(KK.MAX_PIECE, window))] for s, e in zip(c, c[1:]))
    assert pieces == expect
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    # sequences hold the documents: their pieces' ids, put together again, are the tokenizer's
    docs_of = {}
    for r in rows:
        docs_of.setdefault(str(r.doc_id), []).append((r.start, bytes(r.ids)))
    single = [d for d, _ in want if [x for x, _ in want].count(d) == 1] if len(want) < 300 else []
    raw_of = dict(want)
    assert all(b"".join(p for _, p in sorted(docs_of[d])) == raw_of[d] for d in single)
    return len(by_seq)


def test_packing(spark, sf, edge_docs, no_docs):
    docs = read_table(spark, sf, "documents").where("doc_id < 200")
    n = check_packing(docs, KK.pack(docs, WORDS), 2048)
    total = KK.tokenised_pieces(docs, WORDS).agg(F.sum("length")).first()[0]
    assert n <= total / 2048 * 1.03 + 1
    check_packing(edge_docs, KK.pack(edge_docs, WORDS, group=4), 2048)
    assert KK.pack(no_docs, WORDS).count() == 0


def test_letter_words_skip_the_splitter(monkeypatch):
    tok, words = Tokenizer.from_file(WORDS), KK.WordTokenizer(WORDS)
    texts = ["The Élan of ÀÇÉÑÖÜ ß ÿ THE the", "it's e\u0301a Éa\u0301 Wort٣ 12", "İI ıi Kelvin K", "naïve naïve\u0327", "ªº µ ×÷ łódź Straße"]
    sent, ids = [], KK.WordTokenizer._ids
    monkeypatch.setattr(KK.WordTokenizer, "_ids", staticmethod(lambda t, x: (sent.extend(x if t is words.tok else []), ids(t, x))[1]))
    assert [x.tolist() for x in words(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert words.words is not None and "it's" in sent and not {"The", "Élan", "ÀÇÉÑÖÜ", "Straße", "naïve"} & set(sent)


def test_differencing_holds_filled_windows_only():
    """Against differencing with all k sums of every partial partition."""
    import heapq
    import tracemalloc

    def plain(sizes, k):
        parts = {i: [(s, [i])] + [(0, [])] * (k - 1) for i, s in enumerate(sizes.tolist())}
        heap = sorted((-s, i) for i, s in enumerate(sizes.tolist()))
        for node in range(len(sizes), 2 * len(sizes) - 1):
            (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
            both = sorted(((s + t, p + q) for (s, p), (t, q) in zip(parts.pop(a), parts.pop(b)[::-1])), key=lambda x: -x[0])
            parts[node] = [(s - both[-1][0], p) for s, p in both]
            heapq.heappush(heap, (-parts[node][0][0], node))
        where = np.empty(len(sizes), np.int64)
        for window, (_, pieces) in enumerate(parts.popitem()[1]):
            where[pieces] = window
        return where

    rng = np.random.default_rng(4)
    for n, top, k in [(1, 9, 3), (40, 3, 7), (60, 512, 11), (60, 512, 200), (80, 30, 2), (50, 2, 9)]:
        for low in (0, 1):
            sizes = rng.integers(low, top, n)
            assert np.array_equal(KK.differencing(sizes, k), plain(sizes, k)), (n, top, k, low)
    sizes = np.minimum(rng.integers(1, 700, 2048), 512)
    tracemalloc.start()
    KK.pack_group(sizes, 2048)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000  # all sums of 2,048 partitions alone are 6 MB


def test_lattice_merges_equal_library(spark, sp, fuzz, edge_docs, no_docs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(fuzz)], "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    head = TC.piece_model(PIECE_MODEL).head
    rows = LA.encode_segments(LA.segment_counts(df, PIECE_MODEL), PIECE_MODEL).withColumn("back", LA.decode(F.col("ids"), PIECE_MODEL)).collect()
    assert max(len(r.segment) for r in rows) > LA.FOLD_CHARS
    for r in rows:
        s = r.segment.replace("▁", " ")
        assert r.ids == (sp.encode(s[1:]) if s[0] == " " and len(s) > 1 else sp.encode("\n" + s)[head:]), r.segment
        assert r.back == s
    for head_size in (0, 100, 10_000):  # all rare, some rare, none rare
        got = sorted(map(tuple, LA.encode_documents(df, PIECE_MODEL, head=head_size).collect()), key=str)
        if head_size == 0:
            first = got
            want = sorted((r.doc_id, len(sp.encode(r.text or "")), True) for r in df.where("doc_id IS NOT NULL").collect())
            assert sorted((g[0], g[2], g[4]) for g in got if g[0] is not None) == want
        assert got == first
    assert LA.encode_documents(no_docs, PIECE_MODEL).count() == 0


def test_checksum_tells_orders_apart(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "two one")], "doc_id long, text string")
    a, b = LA.encode_documents(df, PIECE_MODEL).collect()
    assert a.n_tokens == b.n_tokens and a.ids_checksum != b.ids_checksum


def test_documents_come_as_ids_and_text(spark, sp, fuzz, edge_docs):
    rows = [(i, t) for i, t in enumerate(fuzz)] + [(-1, " lead  and trail "), (-2, "\u2581\u2581x"), (-3, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    want = sorted(((r.doc_id, sp.encode(r.text or ""), (r.text or "").replace("▁", " ")) for r in docs.collect()), key=str)
    for head in (0, 60, 10_000):
        got = LA.encode_documents(docs, PIECE_MODEL, head=head).collect()
        assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=str) == want
        assert all(r.decoded and r.n_tokens == len(r.ids) and r.ids_checksum == sum((i + 1) * (x + 1) for i, x in enumerate(r.ids)) for r in got)


def test_a_wrong_id_is_not_decoded(monkeypatch, spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "one one")], "doc_id long, text string")
    right = LA.encode_segments

    def swapped(*args):
        got = right(*args)
        return got.withColumn("ids", F.when(F.col("segment").contains("two"), F.reverse(F.concat("ids", "ids"))).otherwise(F.col("ids")))

    monkeypatch.setattr(LA, "encode_segments", swapped)
    assert {r.doc_id: r.decoded for r in LA.encode_documents(docs, PIECE_MODEL).collect()} == {1: False, 2: True}


def test_edges_are_all_pieces_of_a_segment(spark):
    normal = LA._vocabulary(PIECE_MODEL)[0]
    table = {p: (i, rank) for p, i, rank in normal}
    words = ["▁the", "internationalization", "▁▁▁", "é漢🙂a", "x" * LA.FOLD_CHARS, "y" * (LA.FOLD_CHARS + 1), "▁"]
    edges = LA.lattice_edges(spark.createDataFrame([(w, 1) for w in words], "segment string, n long"), PIECE_MODEL)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan  # no row per substring
    for r in edges.collect():
        s = r.segment if len(r.segment) <= LA.FOLD_CHARS else ""
        want = [(table[s[a:b]][1] << 32) + (a << 26) + (b << 20) + table[s[a:b]][0] for a in range(len(s)) for b in range(a + 1, len(s) + 1) if s[a:b] in table]
        assert r.edges == sorted([0, *want])


def test_viterbi_is_the_best_path(spark, sf):
    """Against dynamic programming in Python over the same pieces and scores."""
    normal, _, _, scores, unknown = LA._vocabulary(PIECE_MODEL)
    score = {p: (scores[i], i) for p, i, _ in normal}
    docs = read_table(spark, sf, "documents").where("doc_id < 12")
    rows = LA.encode_segments(LA.segment_counts(docs, PIECE_MODEL).where("pmod(xxhash64(segment), 3) = 0"), PIECE_MODEL, "viterbi").collect()
    assert len(rows) > 100
    for r in rows:
        s = r.segment
        best = [0.0] + [-np.inf] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - 16), e):
                w = score.get(s[b:e], (unknown if e - b == 1 else -np.inf, 0))[0]
                best[e] = max(best[e], best[b] + w)
        pieces = {i: scores[i] for _, i, _ in normal}
        assert sum(pieces.get(i, 0.0) for i in r.ids) == pytest.approx(best[-1]) or any(i not in pieces for i in r.ids)


def test_registered(spark):
    import os
    d = "/root/testdata/sf0.001"
    docs = read_table(spark, d, "documents").count()
    assert R.queries["op8_token_counts"](spark, d).count() == docs
    got = R.queries["op10_lattice"](spark, d).agg(F.count("*"), F.min("decoded"), F.sum("n_tokens")).first()
    assert got[0] == docs and got[1] and got[2] == R.queries["op8_token_counts"](spark, d).agg(F.sum("n_tokens")).first()[0]
    assert os.path.exists(PIECE_MODEL)


def doubled(s, t, times=10):
    """Two words of the pattern whose polynomial hashes modulo 2**64 are equal."""
    for _ in range(times):
        s, t = s + t, t + s
    return s, t


def test_segments_that_share_a_hash_keep_their_own_results(spark, sp):
    tok = Tokenizer.from_file(WORDS)
    texts = [w for pair in (("in", "er"), ("in", "e"), ("th", "is")) for w in doubled(*pair)]
    texts += [" ".join(texts), " ".join(reversed(texts)), " ".join(t[::-1] for t in texts)]
    a, b = (t.encode() for t in texts[:2])
    h = S.hash_segments(np.frombuffer(a + b, np.uint8), np.array([0, len(a)]), np.array([len(a), len(a + b)]))
    assert h[0] == h[1] and a != b
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in TC.token_counts(df, PIECE_MODEL).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in enumerate(texts)}
    for words in (KK.WordTokenizer(WORDS), KK.WordTokenizer(WORDS)):
        for order in (texts, texts[::-1]):  # also from a warm cache
            assert [x.tolist() for x in words(order)] == [tok.encode(t, add_special_tokens=False).ids for t in order]
    encoded = {r.doc_id: list(r.ids) for r in LA.encode_documents(df, PIECE_MODEL, head=2).collect()}
    assert encoded == {i: sp.encode(t) for i, t in enumerate(texts)}
    assert S.distinct_segments(a + b, np.frombuffer(a + b, np.uint8), np.array([0, len(a)]), np.array([len(a), len(a + b)])) == {a: 1, b: 1}


def test_segment_keys_and_comparison():
    """Equal keys below 8 bytes mean equal segments; longer ones are told apart wherever they differ."""
    rng = np.random.default_rng(3)
    buf = bytes(rng.integers(0, 3, 4000, dtype=np.uint8))
    starts = rng.integers(0, 3900, 3000)
    ends = starts + rng.integers(0, 24, 3000)
    arr = np.frombuffer(buf, np.uint8)
    keys = S.hash_segments(arr, starts, ends)
    parts = [buf[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
    assert len(set(keys.tolist())) == len(set(parts)) and 0 not in keys
    held = S.SegmentBytes()
    for n in (8, 9, 15, 16, 17, 40):
        for at in range(n):
            a = bytes(rng.integers(0, 256, n, dtype=np.uint8))
            b = a[:at] + bytes([a[at] ^ 1]) + a[at + 1:]
            held.append([a, b])
            rows = np.array([held.size.n - 2, held.size.n - 1])
            both = np.frombuffer(b"xyz" + a + a, np.uint8)
            assert held.equal(both, np.array([3, 3 + n]), np.array([3 + n, 3 + 2 * n]), rows).tolist() == [True, False]


def test_rare_segments_fill_their_documents_without_a_shuffle(spark, sp):
    """Several slices in a task, some without rare segments, some repeating those of others."""
    texts = ["" if i % 7 == 0 else "the one" if 600 < i < 1200 else f"the w{i % 90}x one é{i}\n" * (i % 3 + 1) for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    encoded = LA.encode_documents(docs, PIECE_MODEL, head=5)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {r.doc_id: (r.ids, r.decoded) for r in encoded.collect()} == {i: (sp.encode(t), True) for i, t in enumerate(texts)}


def test_texts_travel_and_are_held_in_bounded_parts(spark, monkeypatch):
    """Rows of few bytes, slices by bytes, and tables that are hashed piece by piece."""
    import tracemalloc

    texts = [None, "", "é" * 700, "漢字 and more words " * 400, "x" * 512, "x" * 513, "🙂" * 300]
    docs = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = LA.text_rows(docs)
    assert rows.agg(F.max(F.length("piece"))).first()[0] == 512 and rows.count() > 20
    batches = rows.toArrow().to_batches(max_chunksize=3)  # documents go on in the next batch
    want = list(zip([0, 1, 2, 3, 4, None, 6], [t or "" for t in texts]))
    assert [x for ids, held in LA.documents(iter(batches)) for x in zip(ids, held)] == want
    assert [len(ids) for ids, _ in LA.documents(iter(batches), size=1000)] == [3, 1, 2, 1]
    assert [len(ids) for ids, _ in LA.documents(iter(batches), rows=2)] == [2, 2, 2, 1]
    parts = [b"segment %d" % i for i in range(100_000)]
    monkeypatch.setattr(S, "_POWERS", {})
    tracemalloc.start()
    table = S.SegmentTable(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # 72 MB when all are hashed at once
    arr = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = np.append(0, ends[:-1])
    assert table.find(arr, starts, ends, S.hash_segments(arr, starts, ends)).tolist() == list(range(len(parts)))
