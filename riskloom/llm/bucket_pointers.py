"""Exact removal of repeated strings by bucket-pointer refinement.

A string is a window of ``length`` bytes of a text; every byte of a window that also
starts earlier goes. Windows with equal content must meet, so they are dealt by
content: the key of a window is the least of its ``GRAM``-byte grams in a fixed pseudo-random
order. Neighbouring windows mostly share their key. Keys are the initial gram buckets: they travel
first, without text, and the windows of a bucket of one run are settled. Only runs of shared keys
then travel as segments of bytes. Whole copies of a text are found by
their SHA-256 before that.

Within a task the windows of the remaining buckets are told apart by bucket-pointer
refinement (Schuermann and Stoye, "An incompetent suffix sorter", 2007, stopped at
the window's length): every position points to the bucket of its first 8 bytes; a
bucket is refined by sorting its members on the pointers at a later offset, and
the new pointers serve the next refinement, so the depth doubles: 8, 16, ... and
last the pointers ``length - depth`` on. Positions whose bucket has one member are
settled and leave the work. Pointers compare bytes exactly; no result hangs on a hash.

Load. A segment that occurs often in a task leaves it once, with its earliest
place; the other places are known to be repeats at once. Grams found in many of a
bounded draw of documents come last in the order, so that windows
on the border of a frequent line are dealt by the bytes beside it and not all by the line. The draw
moves work between tasks and changes no result. Documents of any length are read
whole, in pieces that overlap by a window.

Results, per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Null texts count as
empty. Places are ordered by doc_id, then start; a null doc_id comes after all
others. Rows that share a doc_id (or the null one) are one document in that order, so of
two equal rows neither is earlier and both get the same result. Texts shorter than ``length`` lose nothing. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rowwise import slices
from riskloom.session import ship_package

LENGTH = 100
GRAM = 24
PIECE = 1 << 20  # window starts of a text read at a time
HELD = 1 << 22  # text bytes whose segments are told apart at a time
GROUP = 1 << 21  # segment bytes refined at a time, as far as buckets allow
DRAW = 2048  # documents
SHARE = 256  # a gram is frequent if 1 / SHARE of the drawn documents hold it
ASKED, KNOWN, ASIDE = 0, 1, 2  # is a key shared? it is; it is, and another row of the task says so
NAMES = ("ref", "none", "doc", "digest")
MOST = 1 << 20  # frequent grams, the most frequent ones
_BASE = 0x9E3779B97F4A7C15
_LATE = np.uint64(1 << 63)
_POWERS: dict = {}


def gram_order(data: np.ndarray) -> np.ndarray:
    """63-bit rank of the gram at each position. Equal grams have equal ranks; different
    ones may share a rank, as only the dealing hangs on it."""
    n = len(data) - GRAM + 1
    if len(_POWERS.get("up", ())) < len(data):
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(len(data), PIECE + LENGTH), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
        _POWERS["code"] = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_POWERS["code"][data] * _POWERS["up"][:len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _POWERS["down"][:n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(1)


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:len(x)] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


class Frequent:
    """Sorted ranks of frequent grams behind a small table that most others fail."""

    def __init__(self, ranks: np.ndarray):
        self.ranks = np.sort(ranks)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.slot(self.ranks)] = True

    def slot(self, ranks: np.ndarray) -> np.ndarray:
        return (ranks >> np.uint64(20) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def among(self, order: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[self.slot(order)])
        if not len(at):
            return at
        spot = np.minimum(np.searchsorted(self.ranks, order[at]), len(self.ranks) - 1)
        return at[self.ranks[spot] == order[at]]


def segments(data: np.ndarray, length: int, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and key of each run of neighbouring
    windows of ``data`` (at least ``length`` bytes) with one key, and whether the
    key occurs more than once in the run: only then may the run repeat itself."""
    order = gram_order(data)
    order[frequent.among(order)] |= _LATE
    least = window_least(order, length - GRAM + 1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    count = np.diff(np.append(first, len(least)))
    wide = count + length - GRAM
    stop = np.cumsum(wide)
    hits = order[np.arange(stop[-1]) + np.repeat(first - stop + wide, wide)] == np.repeat(least[first], wide)
    twice = np.add.reduceat(hits, stop - wide, dtype=np.int64) > 1
    return first, count, (least[first] & ~_LATE).astype(np.int64), twice


def pieces(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Offsets and bytes of overlapping pieces; every window lies in exactly one."""
    for at in range(0, len(text) - length + 1, PIECE):
        yield at, np.frombuffer(text, np.uint8, count=min(len(text) - at, PIECE + length - 1), offset=at)


def refine(data: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with at least ``length`` bytes of ``room`` whose first ``length``
    bytes occur at another such position, and their bucket pointers.

    A bucket is named by the place of its first member in the sorted order, and
    its parts by places inside the old one, so names of all levels differ. A place looked
    up at a step has room for the old depth, so its pointer is of that depth, or
    it was settled before."""
    depth = 8
    key = np.zeros(len(data) - depth + 1, np.uint64)
    for i in range(depth):
        key |= data[i:len(key) + i].astype(np.uint64) << np.uint64(8 * (depth - 1 - i))
    at = np.flatnonzero(room[:len(key)] >= depth)
    key = key[at]
    pointer = np.zeros(len(data), np.int64)
    while True:
        sort = np.argsort(key)
        key, at = key[sort], at[sort]
        part = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(part, len(key)))
        old = pointer[at[part]]
        whole = np.flatnonzero(np.append(True, old[1:] != old[:-1])) if len(old) else part  # first part of each old bucket
        base = np.repeat(part[whole], np.diff(np.append(whole, len(part))))
        pointer[at] = np.repeat(old + part - base, size)
        at = at[np.repeat(size > 1, size)]
        if depth == length:
            return at, pointer[at]
        step = min(depth, length - depth)
        depth += step
        at = at[room[at] >= depth]
        key = pointer[at].astype(np.uint64) * np.uint64(len(data) + 1) + pointer[at + step].astype(np.uint64)


def frequent_grams(texts: DataFrame, draw: int, share: int) -> np.ndarray:
    """Ranks of the grams that at least 1 / ``share`` of a draw of at most about
    ``draw`` documents hold (but four at least)."""
    n = texts.count()
    if not n:
        return np.zeros(0, np.uint64)
    part = texts.where(F.pmod(F.xxhash64("ref"), F.lit(1 << 40)) < int(min(1.0, draw / n) * (1 << 40)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            found = [np.unique(gram_order(p)) for t in b.column("text").to_pylist() for _, p in pieces(t, GRAM)]
            ranks, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ranks.astype(np.int64)), pa.array(count)], names=["g", "n"])

    counted = part.select("text").mapInArrow(grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= max(4, min(n, draw) // share)).orderBy(F.col("n").desc(), "g").limit(MOST)
    return np.array([r["g"] for r in often.select("g").collect()], np.int64).astype(np.uint64)


def shared_keys(rows: DataFrame, length: int, frequent) -> DataFrame:
    """ref, keys: the keys of each row's runs whose bucket holds more than one run.

    A task names every key once per few megabytes of text; a key it met more than once is known to be
    shared, so its other places need no answer and are dealt by row."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, length):
            refs, keys, known = [], [], []
            for ref, *_, data in held:
                _, _, key, twice = segments(data, length, frequent.value)
                refs.append(np.full(len(key), ref)), keys.append(key), known.append(twice)
            ref, key, known = (np.concatenate(c) for c in (refs, keys, known))
            _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            many = count > 1
            np.logical_or.at(many, inverse, known)
            kind = np.where(many[inverse], ASIDE, ASKED)
            kind[first[many]] = KNOWN
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ref), pa.array(kind.astype(np.int8))], names=["key", "ref", "kind"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(c).to_numpy() for c in ("key", "ref", "kind")] for b in batches]
        if not held:
            return
        key, ref, kind = (np.concatenate(c) for c in zip(*held))
        shared = kind != ASKED
        met = np.flatnonzero(kind != ASIDE)
        _, inverse, count = np.unique(key[met], return_inverse=True, return_counts=True)
        many = count > 1
        many[inverse[kind[met] == KNOWN]] = True
        shared[met] = many[inverse]
        order = np.flatnonzero(shared)
        order = order[np.argsort(ref[order], kind="stable")]
        edge = np.flatnonzero(np.append(True, ref[order][1:] != ref[order][:-1])) if len(order) else order
        lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(order)).astype(np.int32)), pa.array(key[order]))
        yield pa.RecordBatch.from_arrays([pa.array(ref[order][edge]), lists], names=["ref", "keys"])

    asked = rows.mapInArrow(ask, "key long, ref long, kind byte").repartition(F.when(F.col("kind") == ASIDE, F.col("ref")).otherwise(F.col("key")))
    return asked.mapInArrow(answer, "ref long, keys array<long>").groupBy("ref").agg(F.flatten(F.collect_list("keys")).alias("keys"))


def gathered(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple]]:
    """(ref, none, doc, digest, shared keys, offset, bytes) of pieces, about ``HELD``
    bytes at a time; copies are left out."""
    held, size = [], 0
    for b in slices(batches, 256):
        more = [b.column(c).to_pylist() if c in b.schema.names else [None] * b.num_rows for c in ("keys", "copies")]
        for ref, none, doc, digest, text, own, copies in zip(*(b.column(c).to_pylist() for c in (*NAMES, "text")), *more):
            if is_copy(copies, none, doc, digest):
                continue
            for at, data in pieces(text, length):
                held.append((ref, none, doc, digest, own, at, data))
                size += len(data)
                if size > HELD:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def repeated_spans(rows: DataFrame, length: int, frequent, group: int) -> DataFrame:
    """ref, none, doc, digest, start, end: spans to remove (they may overlap) of ``rows`` with the shared keys of each."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, length):
            yield different(held, length, frequent.value)

    dealt = rows.mapInArrow(deal, "key long, twice boolean, ref long, none boolean, doc long, digest long, start long, windows long, bytes binary")
    met = dealt.repartition(F.coalesce("key", F.xxhash64("ref", "start")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            del held
            alone = table.filter(table.column("key").is_null())
            start, windows = (alone.column(c).to_numpy() for c in ("start", "windows"))
            yield _spans(*(alone.column(c).to_numpy() for c in NAMES), start, start + windows + length - 1)
            yield from compare(table.filter(table.column("key").is_valid()), length, group)

    return met.mapInArrow(meet, "ref long, none boolean, doc long, digest long, start long, end long")


def different(held: list[tuple], length: int, frequent: Frequent) -> pa.RecordBatch:
    """One row per different segment of some pieces, at its earliest place. Other
    places are repeats: neighbouring ones are one row without key and bytes."""
    rows, found = [], []
    for ref, none, doc, digest, own, at, data in held:
        first, count, keys, twice = segments(data, length, frequent)
        use = np.isin(keys, np.array(own, np.int64))
        first, count, keys, twice = (c[use] for c in (first, count, keys, twice))
        rows.append([*(np.full(len(first), v) for v in (ref, none, doc, digest)), first + at, count, keys, twice])
        text = data.tobytes()
        found += [text[s:s + n] for s, n in zip(first.tolist(), (count + length - 1).tolist())]
    ref, none, doc, digest, start, count, keys, twice = (np.concatenate(c) for c in zip(*rows))
    place = places(none, doc, start)
    lead: dict[bytes, int] = {}
    first_of = np.empty(len(found), np.int64)
    for i in np.argsort(place, kind="stable").tolist():
        first_of[i] = lead.setdefault(found[i], i)
    later = place > place[first_of]
    # an equal place is not earlier, but the same row again says nothing new
    use = np.flatnonzero(~later & ((first_of == np.arange(len(found))) | (digest != digest[first_of])))
    rest = np.flatnonzero(later)
    rest = rest[np.lexsort((start[rest], digest[rest], doc[rest], none[rest]))]
    sums = count[rest]
    if len(rest):
        new_row = np.any([c[rest][1:] != c[rest][:-1] for c in (none, doc, digest)], axis=0)
        gap = np.append(True, (start[rest][1:] != (start + count)[rest][:-1]) | new_row)
        sums, rest = np.add.reduceat(sums, np.flatnonzero(gap)), rest[gap]
    both = np.concatenate([use, rest])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[both], mask=np.arange(len(both)) >= len(use)), *(pa.array(c[both]) for c in (twice, ref, none, doc, digest, start)),
         pa.array(np.concatenate([count[use], sums])), pa.array([found[i] for i in use.tolist()] + [None] * len(rest), pa.binary())],
        names=["key", "twice", *NAMES, "start", "windows", "bytes"])


def places(none: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rank of each (document, start); equal places have one rank."""
    order = np.lexsort((start, doc, none))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(True, np.any([c[order][1:] != c[order][:-1] for c in (none, doc, start)], axis=0)))
    return out


def _spans(ref, none, doc, digest, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, bool if c == "none" else np.int64)) for c, v in
                                       zip((*NAMES, "start", "end"), (ref, none, doc, digest, start, end))], names=[*NAMES, "start", "end"])


def compare(table: pa.Table, length: int, group: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows of ``table``'s segments that have an equal earlier one."""
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(key)))
    order = order[np.repeat(size > 1, size) | table.column("twice").to_numpy()[order]]  # else no equal window
    if not len(order):
        return
    table = table.take(pa.array(order)).combine_chunks()
    key = table.column("key").to_numpy()
    edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    done = np.cumsum(table.column("windows").to_numpy() + length - 1)[edge[1:] - 1]
    at, past = 0, 0
    while at < len(done):  # whole buckets, about ``group`` bytes at a time
        to = max(at + 1, int(np.searchsorted(done, past + group, side="right")))
        yield _compare(table.slice(edge[at], edge[to] - edge[at]), length)
        at, past = to, done[to - 1]


def _compare(part: pa.Table, length: int) -> pa.RecordBatch:
    ref, none, doc, digest, start, windows = (part.column(c).to_numpy() for c in (*NAMES, "start", "windows"))
    held = part.column("bytes").to_pylist()
    place = places(none, doc, start)
    lead: dict[bytes, int] = {}
    first_of = np.empty(len(held), np.int64)
    for i in np.argsort(place, kind="stable").tolist():
        first_of[i] = lead.setdefault(held[i], i)
    later = place > place[first_of]
    out = [(ref[later], none[later], doc[later], digest[later], start[later], start[later] + windows[later] + length - 1)]
    once = np.flatnonzero(first_of == np.arange(len(held)))
    data = np.frombuffer(b"".join(held[i] for i in once.tolist()), np.uint8)
    size = windows[once] + length - 1
    stop = np.cumsum(size)
    at, pointer = refine(data, np.repeat(stop, size) - np.arange(len(data)), length)
    if len(at):
        own = np.searchsorted(stop, at, side="right")  # segment of each window
        seg = once[own]
        begin = start[seg] + at - (stop - size)[own]
        rank = places(none[seg], doc[seg], begin)
        sort = np.lexsort((rank, pointer))
        head = np.flatnonzero(np.append(True, pointer[sort][1:] != pointer[sort][:-1]))
        earliest = np.repeat(rank[sort[head]], np.diff(np.append(head, len(sort))))
        repeat = sort[rank[sort] > earliest]
        repeat = repeat[np.argsort(at[repeat])]
        spot, seg, begin = at[repeat], seg[repeat], begin[repeat]
        a = np.flatnonzero(np.append(True, (np.diff(spot) != 1) | (np.diff(seg) != 0))) if len(repeat) else np.zeros(0, np.int64)
        z = np.append(a[1:], len(repeat))[:len(a)] - 1
        seg, low, high = seg[a], begin[a], begin[z] + length
        out.append((ref[seg], none[seg], doc[seg], digest[seg], low, high))
        # rows of one doc_id with the same bytes at the same place share the result
        for t in np.flatnonzero(~later & (first_of != np.arange(len(held)))).tolist():
            s = np.flatnonzero(seg == first_of[t])
            out.append((*(np.repeat(c[t], len(s)) for c in (ref, none, doc, digest)), low[s], high[s]))
    return _spans(*(np.concatenate(c) for c in zip(*out)))


def keyed(docs: DataFrame) -> DataFrame:
    """ref, none, doc, digest, text (bytes). A row is named by its doc_id and a digest
    of its text; ``ref`` hashes the name and only brings rows together."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
                        F.xxhash64(text).alias("digest"), text.cast("binary").alias("text"))
    return named.select(F.xxhash64("none", "doc", "digest").alias("ref"), "*")


def later_copies(rows: DataFrame, length: int) -> DataFrame:
    """ref, copies: names of the rows whose whole text is that of a row with an earlier
    doc_id (more than one only if two names share a ref)."""
    name = F.struct("none", "doc", "digest")
    whole = rows.where(F.octet_length("text") >= length).select("ref", name.alias("name"), F.struct("none", "doc").alias("place"), F.unhex(F.sha2("text", 256)).alias("sha"))
    first = whole.groupBy("sha").agg(F.min("place").alias("first"))
    return whole.join(first, "sha").where("place > first").groupBy("ref").agg(F.collect_set("name").alias("copies"))


def is_copy(copies: list | None, none: bool, doc: int, digest: int) -> bool:
    return any((c["none"], c["doc"], c["digest"]) == (none, doc, digest) for c in copies or ())


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
    return s[head], reach[np.append(head[1:], len(s)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, draw: int = DRAW, share: int = SHARE, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    if length < GRAM + 8:
        raise ValueError(f"windows have at least {GRAM + 8} bytes")
    rows = keyed(docs)
    frequent = spark.sparkContext.broadcast(Frequent(frequent_grams(rows, draw, share)))
    marked = rows.join(later_copies(rows, length).hint("shuffle_hash"), "ref", "left")
    # all joins deal the texts alike, so Spark shuffles them once
    shared = shared_keys(marked, length, frequent)
    spans = (repeated_spans(rows.join(shared.hint("shuffle_hash"), "ref"), length, frequent, group).groupBy("ref")
             .agg(F.collect_list(F.struct("none", "doc", "digest", "start", "end")).alias("spans")))
    joined = marked.join(spans.hint("shuffle_hash"), "ref", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            removed, runs, kept = [], [], []
            for none, doc, digest, text, copies, own in zip(*(b.column(c).to_pylist() for c in ("none", "doc", "digest", "text", "copies", "spans"))):
                # another name with the same ref is another row
                held = [(s["start"], s["end"]) for s in own or () if (s["none"], s["doc"], s["digest"]) == (none, doc, digest)]
                s, e = merged(*np.array([(0, len(text))] if is_copy(copies, none, doc, digest) else held, np.int64).reshape(-1, 2).T)
                removed.append(int((e - s).sum())), runs.append(len(s))
                kept.append(b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(text)])) if len(s) else text)
            yield pa.RecordBatch.from_arrays([b.column("none"), b.column("doc"), pa.array([len(t) for t in b.column("text").to_pylist()], pa.int64()),
                                              pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                                             names=["none", "doc", "n_bytes", "n_removed", "n_spans", "kept"])

    out = joined.mapInArrow(cut, "none boolean, doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
