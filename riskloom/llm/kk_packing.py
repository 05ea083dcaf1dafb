"""Packing by Karmarkar-Karp multiway differencing.

``tokenised_pieces`` turns each text into token ids (tokenizer ids, then
``END_ID``) and cuts them into windows of the full length plus a rest in pieces
of at most ``MAX_PIECE`` tokens. Full windows are sequences already. The other
pieces are dealt evenly, by a hash of their place and not of a key, into groups
of about ``GROUP`` pieces, so neither a hot source nor a repeated document makes
a large group. In each group differencing starts from one partial partition per
piece and always merges the two with the largest imbalance, largest sum against
smallest; when a window then exceeds the capacity, the number of windows rises
by one and the group is packed again. The pieces keep their ids (little-endian
unsigned 32-bit), so a sequence is its pieces' ids by offset, padded.

Null text is empty: the document is its closing id alone. Repeated rows are
packed row by row (each row's ids lie in exactly one piece of its own). An
empty table gives an empty result. Columns other than doc_id and text are
ignored; a null doc_id is kept.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import segments as S
from riskloom.llm.rowwise import slices
from riskloom.session import checkpoint_dir, ship_package

WINDOW = 2048
MAX_PIECE = 512
GROUP = 2048
GROUPS_PER_TASK = 32
END_ID = 1
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
PLACED = "_at long, sequence_id long, offset long"


class WordTokenizer:
    """Token ids of whole texts through a worker's cache of segments.

    The tokenizer splits at white space, around each digit and between ASCII
    letters and ASCII punctuation, so ids of segments cut there add up to the
    ids of the text. Apostrophes (contractions) and characters beyond ASCII
    (normalisation) are never cut from their neighbours. Texts that contain a
    special token's string are encoded whole. A segment of Latin letters only is one word,
    composed already: the model takes it in lower case, without the patterns of the splitter."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tok.model)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(65, 256) if LETTERS(chr(c))]
        probe = [*letters, *(a + b for a in letters for b in letters), "".join(letters)]
        if self._ids(self.words, [t.lower() for t in probe]) != self._ids(self.tok, probe):  # a tokenizer of another kind
            self.words = None
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        kind = np.full(256, 5)
        kind[[9, 10, 11, 12, 13, 32]] = 3
        for b in range(33, 127):
            kind[b] = 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 4
        kind[ord("'")] = 5
        known = (kind[:, None] < 5) & (kind[None, :] < 5)
        blank = (kind[:, None] == 3) ^ (kind[None, :] == 3)
        self.cut = (known & (kind[:, None] != kind[None, :])) | blank
        digit = kind == 2
        self.cut |= digit[:, None] & digit[None, :]
        self.ids, self.spans = S.Rows(np.uint32), S.Rows(np.int64, 2)
        self.cache = S.SegmentCache(self._encode, self._reset)

    def _reset(self) -> None:
        self.ids.reset()
        self.spans.reset()

    @staticmethod
    def _ids(tok, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, parts: list[bytes]) -> int:
        texts = [p.decode() for p in parts]
        word = [self.words is not None and LETTERS(t) is not None for t in texts]
        lower = [t.lower() if w else t for t, w in zip(texts, word)]
        words = list(dict.fromkeys(t for t, w in zip(lower, word) if w))
        known = dict(zip(words, self._ids(self.words, words))) if words else {}
        others = iter(self._ids(self.tok, [t for t, w in zip(texts, word) if not w]))
        found = [known[t] if w else next(others) for t, w in zip(lower, word)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        at = self.ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())))
        return self.spans.append(np.stack([at + np.cumsum(n) - n, n], 1))

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text, in order."""
        whole = {i: np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
                 for i, t in enumerate(texts) if t and any(s in t for s in self.special)}
        raw = [b"" if i in whole or not t else t.encode() for i, t in enumerate(texts)]
        held: list[np.ndarray] = []
        at = 0
        for ids, parts in S.chunks(raw, self.cut):
            buf, arr, starts, ends, which = S.cuts(parts, self.cut)
            n = np.zeros(len(parts), np.int64)
            flat = np.zeros(0, np.uint32)
            if len(starts):
                rows = self.cache.rows(buf, starts, ends, S.hash_segments(arr, starts, ends))
                first, length = self.spans.data[rows].T
                stop = np.cumsum(length)
                flat = self.ids.data[np.repeat(first - stop + length, length) + np.arange(stop[-1])]
                n = np.bincount(which, weights=length, minlength=len(parts)).astype(np.int64)
            for i, part in zip(ids.tolist(), np.split(flat, np.cumsum(n)[:-1])):
                while at < i:  # a text is complete when the next one begins
                    yield whole[at] if at in whole else np.concatenate(held)
                    at, held = at + 1, []
                held.append(part)
        while at < len(raw):
            yield whole[at] if at in whole else np.concatenate(held or [np.zeros(0, np.uint32)])
            at, held = at + 1, []


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut_points(n: int, window: int, max_piece: int) -> list[int]:
    """Borders of the pieces of a document of n ids: full windows, then equal pieces of the rest."""
    full = n // window * window
    parts = math.ceil((n - full) / max_piece)
    return [*range(0, full, window), *(full + (n - full) * i // parts for i in range(parts)), n]


def tokenised_pieces(docs: DataFrame, path: str, window: int = WINDOW, max_piece: int = MAX_PIECE) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for b in slices(batches):
            at: list[int] = []
            rows: list[tuple[int, int, int]] = []
            held: list[bytes] = []
            for i, ids in enumerate(tok(b.column("text").to_pylist())):
                raw = memoryview(np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes())
                n = len(ids) + 1
                c = cut_points(n, window, max_piece)
                rows += [(s, e - s, n) for s, e in zip(c, c[1:])]
                held += [bytes(raw[4 * s:4 * e]) for s, e in zip(c, c[1:])]
                at += [i] * (len(c) - 1)
            cols = np.array(rows, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()).take(pa.array(at, pa.int64())), *map(pa.array, cols), pa.array(held, pa.binary())],
                                             names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each piece when ``sizes`` are dealt to ``k`` windows.

    A partial partition holds k sums, largest first, less their least. A merge
    sets one's largest sums against the other's smallest. Ties go by position. As long as
    two partitions fill no more than k windows together, no sums meet: then only filled windows
    are held, as lists of (negative) sums and of their pieces, and mostly one piece goes behind the
    others. Later merges are recorded and followed back from the last one."""
    m = len(sizes)
    if k == 1:
        return np.zeros(m, np.int64)
    parts: dict[int, tuple[list[int], list[list[int]]] | np.ndarray] = {}
    # an empty piece is no larger than an empty window: then all windows are held
    empty = k - 1 if sizes.min(initial=1) < 1 else 0
    for i, s in enumerate(sizes.tolist()):
        parts[i] = [-s, *[0] * empty], [[i], *([] for _ in range(empty))]
    heap = [(part[0][0], i) for i, part in parts.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int, np.ndarray]] = []
    filled: dict[int, list[list[int]]] = {}

    def all_sums(node: int, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part
        filled[node] = part[1]
        out = np.zeros(k, np.int64)
        out[:len(part[0])] = part[0]
        return -out

    for node in range(m, 2 * m - 1):
        _, a = heapq.heappop(heap)
        b = heap[0][1]
        one, two = parts.pop(a), parts.pop(b)
        if isinstance(one, tuple) and isinstance(two, tuple) and len(one[0]) + len(two[0]) <= k:
            (sums, held), (more, others) = one, two
            if len(more) == 1:
                at = bisect_right(sums, more[0])
                sums.insert(at, more[0])
                held.insert(at, others[0])
            else:
                sums, held = sums + more[::-1], held + others[::-1]
                order = sorted(range(len(sums)), key=sums.__getitem__)
                sums, held = [sums[i] for i in order], [held[i] for i in order]
            if len(sums) == k:
                last = sums[-1]
                sums = [s - last for s in sums]
            parts[node], top = (sums, held), sums[0]
        else:
            total = all_sums(a, one) + all_sums(b, two)[::-1]
            order = (-total).argsort(kind="stable")
            total = total[order]
            total -= total[-1]
            merges.append((node, a, b, order))
            parts[node], top = total, -int(total[0])
        heapq.heapreplace(heap, (top, node))
    where = np.empty(m, np.int64)
    for node, part in parts.items():  # the last one
        all_sums(node, part)
        labels = {node: np.arange(k)}
    for node, a, b, order in reversed(merges):
        own = np.empty(k, np.int64)
        own[order] = labels.pop(node)
        labels[a], labels[b] = own, own[::-1]
    for node, held in filled.items():
        for window, pieces in zip(labels[node].tolist(), held):
            where[pieces] = window
    return where


def pack_group(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece of a group; no window holds more than ``window``."""
    k = max(1, math.ceil(int(sizes.sum()) / window))
    while True:
        where = differencing(sizes, k)
        if np.bincount(where, weights=sizes, minlength=k).max(initial=0) <= window:
            break
        k += 1
    used, where = np.unique(where, return_inverse=True)
    order = np.argsort(where, kind="stable")
    run = np.cumsum(sizes[order]) - sizes[order]
    first = np.searchsorted(where[order], np.arange(len(used)))
    offset = np.empty(len(sizes), np.int64)
    offset[order] = run - run[first][where[order]]
    return where, offset


def pack(docs: DataFrame, path: str, window: int = WINDOW, max_piece: int = MAX_PIECE, group: int = GROUP) -> DataFrame:
    """One row per piece with its ids (and their CRC), its sequence and its offset there.

    Sequence ids are odd for full windows and even for packed groups; both come
    from the number that a row was written with, so a lost task gives the same
    ids again."""
    spark = docs.sparkSession
    table = f"{checkpoint_dir(spark)}/pieces-{uuid.uuid4().hex}"
    (tokenised_pieces(docs, path, window, max_piece).withColumn("ids_crc32", F.crc32("ids")).withColumn("_at", F.monotonically_increasing_id())
     .write.option("compression", "zstd").parquet(table))
    pieces = spark.read.parquet(table)
    full = pieces.where(F.col("length") == window).withColumn("sequence_id", F.col("_at") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < window)
    groups = max(1, math.ceil(rest.count() / group))

    def run(key, table):
        table = table.sort_by("_at")
        where, offset = pack_group(table.column("length").to_numpy(), window)
        ids = (key[0].as_py() * 2**32 + where) * 2
        return pa.table({"_at": table.column("_at"), "sequence_id": pa.array(ids, pa.int64()), "offset": pa.array(offset, pa.int64())})

    # few bytes but much work: tasks by number of groups, not by size
    tasks = max(math.ceil(groups / GROUPS_PER_TASK), min(groups, spark.sparkContext.defaultParallelism))
    # only sizes are packed; ids meet their places in a join, and stay behind where a query leaves them out
    placed = (rest.select("_at", "length", F.pmod(F.xxhash64("_at"), F.lit(groups)).alias("_group")).repartition(tasks, "_group")
              .groupBy("_group").applyInArrow(run, PLACED))
    return full.unionByName(rest.join(placed, "_at")).drop("_at")
