"""Token counts by a map-side two-tier lookup.

The vocabulary tells which neighbouring bytes ever stand together inside a
piece; a text can be cut everywhere else without changing its tokens. Tier one
is a compact hash table of the lengths of frequent pre-tokens, built once over
all documents (bounded candidates per task, one bounded summary) and broadcast:
its size is fixed by ``FREQUENT``. Tier two is each worker's bounded cache,
filled by the library. Pre-tokens are never shuffled; the only shuffle is the
summary of candidates.

Null text counts as empty (0 bytes, 0 tokens). Repeated rows are counted row
by row, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import segments as S
from riskloom.session import ship_package

FREQUENT = 65_536
CANDIDATES = 4_096
WATCHED = 200_000
TOKEN_LIMIT = 4_096


class PieceModel:
    """A sentencepiece model and the cuts its vocabulary allows."""

    def __init__(self, path: str):
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        joined = np.zeros((256, 256), bool)
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                b = np.frombuffer(sp.id_to_piece(i).replace("▁", " ").encode(), np.uint8)
                joined[b[:-1], b[1:]] = True
        joined[:, 0x80:0xC0] = True  # never inside a character
        # The separability of a text at bytes that no piece joins holds for
        # models without text normalisation; others are cut nowhere.
        self.cut = ~joined if self._plain() else np.zeros((256, 256), bool)
        self.head = len(sp.encode("\n"))

    def _plain(self) -> bool:
        """No normalisation: composed, compatibility and repeated characters come back as they went in."""
        probe = "a  b ﬁ é Ａ　 \t\n x"
        return self.sp.decode(self.sp.encode(probe)) == probe

    def text_bytes(self, text: str) -> bytes:
        """The text with the prefix that the library adds; to it, U+2581 is a blank."""
        return b" " + text.replace("▁", " ").encode() if text else b""

    def ids(self, segment: str) -> list[int]:
        """Ids of one segment with U+2581 for blanks."""
        text = segment.replace("▁", " ")
        return self.sp.encode(text[1:]) if text[0] == " " and len(text) > 1 else self.sp.encode("\n" + text)[self.head:]

    def lengths(self, parts: list[bytes]) -> np.ndarray:
        """Tokens of each segment of a prefixed text. The library adds a
        prefix itself, so one leading blank is taken off; a segment without
        one stands behind a newline, which no piece joins."""
        texts = [p[1:].decode() if p[:1] == b" " else "\n" + p.decode() for p in parts]
        more = np.fromiter((p[:1] != b" " for p in parts), bool, len(parts))
        out = np.fromiter(map(len, self.sp.encode(texts, num_threads=1)), np.int64, len(parts)) - self.head * more
        for i, p in enumerate(parts):
            if p == b" ":  # the library adds no prefix to an empty text
                out[i] = len(self.sp.encode("\n ")) - self.head
        return out


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _encoded(model: PieceModel, texts: list[str | None]) -> list[bytes]:
    return [model.text_bytes(t) if t else b"" for t in texts]


def _candidates(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens of a task, counted with bounded memory:
    whenever more than WATCHED are held, the least frequent half goes."""
    model = piece_model(path)
    held: dict[int, list] = {}
    for b in batches:
        for _, parts in S.chunks([t for t in _encoded(model, b.column("text").to_pylist()) if t], model.cut):
            buf, arr, starts, ends, _ = S.cuts(parts, model.cut)
            u, first, n = np.unique(S.hash_segments(arr, starts, ends), return_index=True, return_counts=True)
            top = np.argsort(-n, kind="stable")[:4 * CANDIDATES]
            for h, f, k in zip(u[top].tolist(), first[top].tolist(), n[top].tolist()):
                if h in held:
                    held[h][1] += k
                elif ends[f] - starts[f] <= 64:
                    held[h] = [buf[starts[f]:ends[f]], k]
            if len(held) > WATCHED:
                held = dict(sorted(held.items(), key=lambda x: -x[1][1])[:WATCHED // 2])
    best = sorted(held.values(), key=lambda x: (-x[1], x[0]))[:CANDIDATES]
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], names=["part", "n"])


def frequent_lengths(docs: DataFrame, path: str, limit: int = FREQUENT) -> tuple[list[bytes], np.ndarray]:
    """(pre-tokens, lengths) of at most ``limit`` frequent pre-tokens."""
    found = (docs.select("text").mapInArrow(lambda b: _candidates(path, b), "part binary, n long")
             .groupBy("part").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "part").limit(limit).collect())
    parts = [bytes(r["part"]) for r in found]
    lengths = piece_model(path).lengths(parts) if parts else np.zeros(0, np.int64)
    return parts, np.minimum(lengths, 2**31 - 1)


class Counter:
    """Both tiers on a worker."""

    def __init__(self, path: str, frequent: list[bytes], lengths: np.ndarray):
        self.model = piece_model(path)
        self.first, self.frequent = S.SegmentTable(frequent), np.append(lengths, -1)  # the last one: not there
        self.store = S.Rows(np.int32)
        self.second = S.SegmentCache(lambda parts: self.store.append(self.model.lengths(parts)), self.store.reset)

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text."""
        raw = _encoded(self.model, texts)
        size = np.fromiter((max(0, len(b) - 1) + 2 * t.count("▁") if b else 0 for b, t in zip(raw, texts)), np.int64, len(raw))
        total = np.zeros(len(raw), np.int64)
        for ids, parts in S.chunks(raw, self.model.cut):
            buf, arr, starts, ends, which = S.cuts(parts, self.model.cut)
            if not len(starts):
                continue
            h = S.hash_segments(arr, starts, ends)
            n = self.frequent[self.first.find(arr, starts, ends, h)].astype(np.int64)
            miss = np.flatnonzero(n < 0)
            if len(miss):
                rows = self.second.rows(buf, starts, ends, h, miss)[miss]
                n[miss] = self.store.data[rows]  # after the lookup, which may grow the store
            total += np.bincount(ids[which], weights=n, minlength=len(raw)).astype(np.int64)
        return size, total


_COUNTERS: dict = {}


def token_counts(docs: DataFrame, path: str, frequent: int = FREQUENT, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    spark = docs.sparkSession
    ship_package(spark)
    table = frequent_lengths(docs, path, frequent)
    app, at = spark.sparkContext.applicationId, zlib.crc32(b"\n".join(table[0]))
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, app, at)  # a Python worker keeps its caches from task to task
        counter = _COUNTERS.get(key)
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[key] = Counter(path, *shared.value)
        for b in batches:
            size, n = counter.count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
