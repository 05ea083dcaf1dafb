"""SentencePiece encoding and decoding as relations.

Texts are cut where no piece of the vocabulary joins two neighbouring bytes, so
the tokens of a text are those of its segments. Each distinct segment becomes a
lattice: its substrings are looked up in the piece table where the segment lies (a
vocabulary has a fixed size; no substring is a row, so none is sorted or spilled), and
a higher-order aggregate folds the edges found into a path:

- ``viterbi``: edges in order of their end; a state per position holds the best
  score and where it came from. This is the encoding of unigram models.
- ``merges``: edges in order of their score, best first; the state is the set of
  borders still standing (bits of a long), and an edge over exactly two standing
  pieces takes away the border between them. This is the encoding of merge (BPE)
  models: a piece is always built from better pieces, so one pass in score order
  makes the library's merges. Viterbi over a merge model's scores does not give
  the library's ids, because those scores are merge ranks and no log-probabilities.

Characters without a piece fall back to byte pieces. Segments of over
``FOLD_CHARS`` characters do not fit the bits of a long and are encoded by the
library, one value at a time. Decoding looks pieces up by id and turns their
bytes back into text.

Segments of all documents are counted, and the ``HEAD`` most frequent ones (a fixed
number) are encoded once and broadcast. One pass over the documents, without a shuffle,
does the rest: a document's ids of frequent segments come in order with gaps for the
others; the distinct others of a few documents at a time are folded as rows ahead of
them, and their ids fill the gaps. The whole ids are decoded to text, which is compared
with the document's by a digest of 16 bytes. Count and checksum are taken from the whole ids.
Texts go to the workers as rows of at most ``CUT`` bytes and are put together there.

Null text is empty (no segments, no tokens). Repeated rows are encoded row by
row, other columns are ignored, an empty table gives an empty result. U+2581
counts as a blank, as in the library.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import segments as S
from riskloom.llm.token_counts import piece_model
from riskloom.session import ship_package

HEAD = 250_000
FOLD_CHARS = 62
SLICE = 500
SLICE_BYTES = 1 << 20  # of text in a slice, but for its last document
CUT = 512  # bytes of text in a row on its way to a worker
CHUNK_BYTES = 1 << 18
COUNTED = 1 << 17  # segments that a worker counts before it sends them on
PLACES = 1_000_003


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple:
    """(piece, id, rank by score) of the normal pieces, hex bytes by id, ids of the
    256 byte pieces, scores by id, score of an unknown character."""
    sp = piece_model(path).sp
    normal, data, bytes_at = [], [], [0] * 256
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_at[int(p[3:5], 16)] = i
            data.append(p[3:5])
        elif sp.is_control(i) or sp.is_unknown(i):
            data.append("")
        else:
            normal.append((p, i))
            data.append(p.replace("▁", " ").encode().hex().upper())
    scores = [float(sp.get_score(i)) for i in range(sp.get_piece_size())]
    order = {s: r for r, s in enumerate(sorted({scores[i] for _, i in normal}, reverse=True))}
    return [(p, i, order[scores[i]]) for p, i in normal], data, bytes_at, scores, min(scores[i] for _, i in normal) - 10.0


# An edge is one long: rank of its score, start, end and piece id.
_START, _END, _ID = 1 << 26, 1 << 20, (1 << 20) - 1


def edge_start(e: Column) -> Column:
    return F.shiftright(e, 26).bitwiseAND(63).cast("int")


def edge_end(e: Column) -> Column:
    return F.shiftright(e, 20).bitwiseAND(63).cast("int")


@lru_cache(maxsize=2)
def _piece_table(path: str) -> dict[str, int]:
    """Piece -> rank and id as in an edge; beginnings of pieces that are none themselves -> -1."""
    normal = _vocabulary(path)[0]
    begun = {p[:n]: -1 for p, _, _ in normal for n in range(1, len(p))}
    return begun | {p: (rank << 32) + i for p, i, rank in normal}


def find_edges(segments: list[str], path: str) -> pa.Array:
    """Of each segment every piece in it, best score first, then by place, after the empty edge 0."""
    table = _piece_table(path)
    edges, stops = array("q"), array("i", [0])
    for s in segments:
        found = [0]
        for start in range(len(s) if len(s) <= FOLD_CHARS else 0):
            for end in range(start + 1, len(s) + 1):
                piece = table.get(s[start:end])
                if piece is None:  # no piece begins so
                    break
                if piece >= 0:
                    found.append(piece + start * _START + end * _END)
        found.sort()
        edges.extend(found)
        stops.append(len(edges))
    return pa.ListArray.from_arrays(pa.array(np.array(stops, np.int32)), pa.array(np.array(edges, np.int64)))


def edge_marks(edges: pa.Array) -> pa.Array:
    """Of each edge the bits of its two ends, those of all its places, and its start and piece id."""
    e = edges.flatten().to_numpy()
    start, end = (e >> 26) & 63, (e >> 20) & 63
    ends = np.where(end > start, (1 << start) | (1 << end), -1)  # the empty edge is on no path
    marks = [pa.array(x) for x in (ends, ends | ((1 << end) - (1 << start)), (start << 20) | (e & _ID))]
    lengths = edges.value_lengths().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.StructArray.from_arrays(marks, ["ends", "span", "at"]))


MARKS = "marks array<struct<ends: long, span: long, at: long>>"
EDGES = f"edges array<long>, {MARKS}"


def lattice_edges(segments: DataFrame, path: str) -> DataFrame:
    """``segments`` (segment, ...) with ``edges``: every piece in it, best score first, then by place, after
    the empty edge 0, which every lattice holds, and with the ``marks`` of these edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = find_edges(b.column("segment").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([*b.columns, edges, edge_marks(edges)], names=[*b.schema.names, "edges", "marks"])

    return segments.mapInArrow(run, T.StructType([*segments.schema.fields, *T.StructType.fromDDL(EDGES).fields]))


def merges_fold(marks: Column, length: Column) -> Column:
    """Borders that stand after all merges, as bits of a long."""
    def step(mask: Column, e: Column) -> Column:
        # both ends and one border between them stand
        merges = (F.bit_count(mask.bitwiseAND(e["span"])) == 3) & (mask.bitwiseAND(e["ends"]) == e["ends"])
        return F.when(merges, mask.bitwiseAND(F.bitwise_not(e["span"])).bitwiseOR(e["ends"])).otherwise(mask)

    full = F.call_function("shiftleft", F.lit(2).cast("long"), length) - 1
    return F.aggregate(marks, full, step)


def viterbi_fold(edges: Column, length: Column, scores: list[float], unknown: float) -> Column:
    """Where the best path enters each end position 1..length (array of starts).

    The state holds best scores and entries of the positions so far; edges come
    by end, then by start, and a later one must be strictly better. Positions no
    piece ends at are entered by an unknown character."""
    table = F.split(F.lit(",".join(map(repr, scores))), ",")
    by_end = F.array_sort(F.transform(edges, lambda e: F.struct(
        edge_end(e).alias("end"), edge_start(e).alias("start"), F.get(table, e.bitwiseAND(_ID).cast("int")).cast("double").alias("score"))))
    zero = F.struct(F.array(F.lit(0.0)).alias("best"), F.array().cast("array<int>").alias("entry"))

    def position(state: Column, end: Column) -> Column:
        at = lambda i: F.get(state["best"], i)
        start = F.struct((at(end - 1) + unknown).alias("score"), (end - 1).alias("entry"))
        # with a single-character piece at hand there is no unknown character
        single = F.exists(by_end, lambda e: (e["end"] == end) & (e["start"] == end - 1))
        none = F.struct(F.lit(float("-inf")).alias("score"), F.lit(-1).alias("entry"))
        best = F.aggregate(F.filter(by_end, lambda e: e["end"] == end), F.when(single, none).otherwise(start),
                           lambda b, e: F.when(at(e["start"]) + e["score"] > b["score"], F.struct((at(e["start"]) + e["score"]).alias("score"), e["start"].alias("entry"))).otherwise(b))
        return F.struct(F.concat(state["best"], F.array(best["score"])).alias("best"), F.concat(state["entry"], F.array(best["entry"])).alias("entry"))

    return F.aggregate(F.sequence(F.lit(1), length), zero, position, lambda s: s["entry"])


def borders_of_entries(entries: Column, length: Column) -> Column:
    """Borders of the path that ``viterbi_fold`` found, as bits: followed back from the end."""
    one = F.lit(1).cast("long")
    start = F.struct(F.call_function("shiftleft", one, length).alias("mask"), length.alias("at"))
    back = F.aggregate(F.sequence(F.lit(1), length), start, lambda s, _: F.when(s["at"] > 0, F.struct(
        s["mask"].bitwiseOR(F.call_function("shiftleft", one, F.get(entries, s["at"] - 1))).alias("mask"), F.get(entries, s["at"] - 1).alias("at"))).otherwise(s))
    return back["mask"]


def ids_of_borders(mask: Column, marks: Column, segment: Column, byte_ids: list[int]) -> Column:
    """Piece ids between standing borders; spans without a piece become byte pieces."""
    shift = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    # both ends of the edge stand and nothing between them
    on_path = F.sort_array(F.transform(F.filter(marks, lambda e: mask.bitwiseAND(e["span"]) == e["ends"]), lambda e: e["at"]))
    all_pieces = F.transform(on_path, lambda x: x.bitwiseAND(_ID).cast("int"))

    at = F.filter(F.sequence(F.lit(0), F.length(segment)), lambda i: F.getbit(mask, i) == 1)
    table = F.split(F.lit(",".join(map(str, byte_ids))), ",")
    known = F.map_from_entries(F.transform(marks, lambda e: F.struct(e["ends"], e["at"].bitwiseAND(_ID).cast("int"))))

    def span(s: Column, k: Column) -> Column:
        e = F.get(at, k + 1)
        found = F.try_element_at(known, shift(s).bitwiseOR(shift(e)))
        data = F.hex(F.encode(F.replace(F.substring(segment, s + 1, e - s), F.lit("▁"), F.lit(" ")), "UTF-8"))
        as_bytes = F.transform(F.sequence(F.lit(1), F.length(data), F.lit(2)),
                               lambda j: F.get(table, F.conv(F.substring(data, j, F.lit(2)), 16, 10).cast("int")).cast("int"))
        return F.when(found.isNotNull(), F.array(found)).otherwise(as_bytes)

    with_bytes = F.flatten(F.transform(F.slice(at, F.lit(1), F.size(at) - 1), span))
    # most segments are covered by pieces: as many edges on the path as spans
    return F.when(F.size(all_pieces) == F.bit_count(mask) - 1, all_pieces).otherwise(with_bytes)


def decode(ids: Column, path: str) -> Column:
    """Text of an array of ids: the pieces' bytes, looked up by id (a leading prefix blank stays)."""
    table = F.split(F.lit(",".join(_vocabulary(path)[1])), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")


def encode_segments(segments: DataFrame, path: str, algorithm: str = "merges") -> DataFrame:
    """``segments`` (segment with U+2581 for blanks, distinct; ``known``: ids that
    the library gave for a segment too long to fold, else null; other columns
    kept) with ``ids``. Rows that hold their ``marks`` (and ``edges``, which only Viterbi
    reads) already are only folded; those without a segment have no ids."""
    _, _, byte_ids, scores, unknown = _vocabulary(path)
    edges = segments if "marks" in segments.columns else lattice_edges(segments, path)
    size = F.length("segment")
    if algorithm == "merges":
        folded = edges.withColumn("mask", merges_fold(F.col("marks"), size))
    elif algorithm == "viterbi":
        folded = edges.withColumn("entry", viterbi_fold(F.col("edges"), size, scores, unknown)).withColumn("mask", borders_of_entries(F.col("entry"), size))
    else:
        raise ValueError(algorithm)
    ids = (F.when(F.col("segment").isNull() | F.col("known").isNotNull(), F.col("known"))
           .otherwise(ids_of_borders(F.col("mask"), F.col("marks"), F.col("segment"), byte_ids)))
    return folded.select("segment", *[c for c in segments.columns if c not in ("segment", "known", "edges", "marks")], ids.alias("ids"))


def text_rows(docs: DataFrame, cut: int = CUT) -> DataFrame:
    """Texts as rows (doc_id, piece, last) of at most ``cut`` bytes, those of a document one after the other.

    A batch on its way to a worker holds thousands of rows, whatever their size: so it is
    bounded, and neither side holds whole texts by the thousand. Null text is one empty row."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    size = F.octet_length("raw")
    at = raw.select("doc_id", "raw", F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), F.lit(cut))).alias("at"))
    return at.select("doc_id", F.substring("raw", F.col("at") + 1, F.lit(cut)).alias("piece"), (F.col("at") + cut >= size).alias("last"))


def documents(batches: Iterator[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of a few documents at a time: a worker holds the segments of no more than these."""
    ids, texts, held, total = [], [], [], 0
    for b in batches:
        for doc_id, piece, last in zip(*(c.to_pylist() for c in b.columns)):
            held.append(piece)
            total += len(piece)
            if last:
                ids.append(doc_id)
                texts.append(b"".join(held).decode())
                held = []
                if len(ids) >= rows or total >= size:
                    yield ids, texts
                    ids, texts, total = [], [], 0
    if ids:
        yield ids, texts


def segment_counts(docs: DataFrame, path: str) -> DataFrame:
    """Distinct segments of all texts with their numbers of occurrences ``n``, and
    ``known`` ids of those of over FOLD_CHARS characters."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        total: dict[bytes, int] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            left = iter(total.items())
            while held := list(islice(left, COUNTED // 16)):
                texts = [p.decode().replace(" ", "▁") for p, _ in held]
                known = [model.ids(t) if len(t) > FOLD_CHARS else None for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([n for _, n in held], pa.int64()), pa.array(known, pa.list_(pa.int32()))], names=["segment", "n", "known"])

        for _, texts in documents(batches):
            raw = [model.text_bytes(t) for t in texts]
            for _, pieces in S.chunks([t for t in raw if t], model.cut, CHUNK_BYTES):
                buf, arr, starts, ends, _ = S.cuts(pieces, model.cut)
                for part, n in S.distinct_segments(buf, arr, starts, ends).items():
                    total[part] = total.get(part, 0) + n
            if len(total) > COUNTED:
                yield from counted()
                total = {}
        yield from counted()

    found = text_rows(docs).mapInArrow(run, "segment string, n long, known array<int>")
    return found.groupBy("segment", "known").agg(F.sum("n").alias("n"))


def ids_sum(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksum of the ids of each document, whose ids end at ``ends``: depends on their order."""
    starts = np.append(0, ends[:-1])[: len(ends)]
    place = np.arange(len(ids)) - np.repeat(starts, ends - starts)
    total = np.append(0, np.cumsum((place + 1) % PLACES * (ids.astype(np.int64) + 1)))
    return total[ends] - total[starts]


def decode_ids(ids: np.ndarray, data: np.ndarray) -> str:
    """Text of the ids of a whole document, by the bytes ``data`` of each id; the prefix blank goes."""
    raw = b"".join(b"".join(data[ids[at:at + 1_000_000]].tolist()) for at in range(0, len(ids), 1_000_000))
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


class _Head:
    """Frequent segments on a worker: segment -> span of ids."""

    def __init__(self, data: bytes, sizes: np.ndarray, spans: np.ndarray, ids: np.ndarray):
        stops = np.cumsum(sizes).tolist()
        self.table, self.spans, self.ids = S.SegmentTable([data[e - n:e] for n, e in zip(sizes.tolist(), stops)]), spans, ids


def _head(counts: DataFrame, path: str, algorithm: str, limit: int) -> tuple:
    spark = counts.sparkSession
    most = counts.orderBy(F.desc("n"), "segment").limit(limit).repartition(2 * spark.sparkContext.defaultParallelism, "segment")
    got = encode_segments(most, path, algorithm).select("segment", "ids").toArrow()
    raw = [s.replace("▁", " ").encode() for s in got.column("segment").to_pylist()]
    lists = got.column("ids").combine_chunks()
    ids = lists.flatten().to_numpy().astype(np.int32)
    n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return b"".join(raw), np.fromiter(map(len, raw), np.int32, len(raw)), np.stack([np.cumsum(n) - n, n], 1).astype(np.int32), ids


def encode_documents(docs: DataFrame, path: str, algorithm: str = "merges", head: int = HEAD) -> DataFrame:
    """Per row: doc_id, n_segments, n_tokens, ids_checksum, ``decoded`` (the ids
    decode to the whole text), ``ids`` in order and the ``text`` decoded from them."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(_head(segment_counts(docs, path), path, algorithm, head))
    # ids travel in as few bytes as the vocabulary needs; the largest value stands for a rare segment
    kind = np.dtype("<u2" if len(_vocabulary(path)[1]) < 0xFFFF else "<u4")
    gap = np.iinfo(kind).max
    # the second pass gets the bytes of the ids and needs no model
    bytes_of = spark.sparkContext.broadcast([bytes.fromhex(h) for h in _vocabulary(path)[1]])
    of_edges = {"edges": pa.list_(pa.int64())} if algorithm == "viterbi" else {}
    of_edges["marks"] = pa.list_(pa.struct([(c, pa.int64()) for c in ("ends", "span", "at")]))

    def known_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = piece_model(path), _Head(*shared.value)
        for part, (doc_ids, texts) in enumerate(documents(batches)):
            texts = [t.replace("▁", " ") for t in texts]
            raw = [model.text_bytes(t) for t in texts]
            segs, tokens, gaps = (np.zeros(len(raw), np.int64) for _ in range(3))
            found: list[np.ndarray] = [np.zeros(0, kind)]
            rare: dict[bytes, int] = {}
            which_rare: list[int] = []
            for ids, pieces in S.chunks(raw, model.cut, CHUNK_BYTES):
                buf, arr, starts, ends, which = S.cuts(pieces, model.cut)
                if not len(starts):
                    continue
                doc = ids[which]
                segs += np.bincount(doc, minlength=len(raw))
                row = known.table.find(arr, starts, ends, S.hash_segments(arr, starts, ends))
                hit = row >= 0
                first, length = np.zeros(len(row), np.int64), np.ones(len(row), np.int64)
                first[hit], length[hit] = known.spans[row[hit]].T
                stop = np.cumsum(length)
                flat = np.full(stop[-1], gap, kind)
                of_known = np.repeat(hit, length)
                at = np.arange(stop[-1]) - np.repeat(stop - length - first, length)
                flat[of_known] = known.ids[at[of_known]]
                found.append(flat)
                tokens += np.bincount(np.repeat(doc, length), minlength=len(raw))
                miss = np.flatnonzero(~hit)
                gaps += np.bincount(doc[miss], minlength=len(raw))
                which_rare += [rare.setdefault(buf[s:e], len(rare)) for s, e in zip(starts[miss].tolist(), ends[miss].tolist())]
            new = [s.decode().replace(" ", "▁") for s in rare]
            edges = find_edges(new, path)
            found_edges = {"edges": edges, "marks": edge_marks(edges)}
            m, n = len(new), len(raw)

            def by_document(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
                data, stop = values.tobytes(), np.append(0, np.cumsum(sizes) * values.itemsize).tolist()
                return [data[s:e] for s, e in zip(stop, stop[1:])]

            # rare segments, then the documents they occur in
            columns = [pa.array(np.full(m + n, part)), pa.array(new + [None] * n, pa.string()),
                       pa.array([model.ids(s) if len(s) > FOLD_CHARS else None for s in new] + [None] * n, pa.list_(pa.int32())),
                       *(pa.concat_arrays([found_edges[c], pa.nulls(n, t)]) for c, t in of_edges.items()),
                       pa.array([None] * m + doc_ids, pa.int64()),
                       pa.array([None] * m + segs.tolist(), pa.int64()),
                       pa.array([None] * m + by_document(np.concatenate(found), tokens), pa.binary()),
                       pa.array([None] * m + by_document(np.array(which_rare, np.int32), gaps), pa.binary()),
                       pa.array([None] * m + [_digest(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "segment", "known", *of_edges, "doc_id", "n_segments", "stream", "rare", "digest"])

    rows = text_rows(docs).mapInArrow(
        known_ids, f"part long, segment string, known array<int>, {EDGES if 'edges' in of_edges else MARKS}, doc_id long, n_segments long, stream binary, rare binary, digest binary")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.array(bytes_of.value, object)
        held, sizes, fill = -1, np.zeros(0, np.int64), np.zeros(0, np.int32)
        for b in batches:
            part, is_rare = b.column("part").to_numpy(), b.column("segment").is_valid().to_numpy(zero_copy_only=False)
            border = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (is_rare[1:] != is_rare[:-1]))).tolist() if b.num_rows else []
            for lo, hi in zip(border, [*border[1:], b.num_rows]):
                if part[lo] != held:
                    held, sizes, fill = part[lo], np.zeros(0, np.int64), np.zeros(0, np.int32)
                run = b.slice(lo, hi - lo)
                if is_rare[lo]:
                    ids = run.column("ids")
                    sizes = np.append(sizes, ids.value_lengths().to_numpy(zero_copy_only=False))
                    fill = np.append(fill, ids.flatten().to_numpy())
                else:
                    yield _whole_documents(run, kind, gap, sizes, fill, data)

    return (encode_segments(rows, path, algorithm)
            .mapInArrow(whole, "doc_id long, n_segments long, n_tokens long, ids_checksum long, decoded boolean, ids array<int>, text string"))


def _whole_documents(b: pa.RecordBatch, kind: np.dtype, gap: int, sizes: np.ndarray, fill: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """Documents with the ids of their rare segments, number i of which has the next ``sizes[i]`` ids of ``fill``, in the gaps."""
    streams = b.column("stream").to_pylist()
    stream, rare = np.frombuffer(b"".join(streams), kind), np.frombuffer(b"".join(b.column("rare").to_pylist()), np.int32)
    wide = np.ones(len(stream), np.int64)
    gaps = stream == gap
    size = sizes[rare]
    wide[gaps] = size
    ids = np.repeat(stream, wide).astype(np.int32)
    first, stop = (np.cumsum(sizes) - sizes)[rare], np.cumsum(size)
    ids[np.repeat(gaps, wide)] = fill[np.arange(size.sum()) + np.repeat(first - stop + size, size)]
    stop = np.cumsum(np.fromiter((len(s) // kind.itemsize for s in streams), np.int64, len(streams)))
    ends = np.append(0, np.cumsum(wide))[stop]
    starts = np.append(0, ends[:-1])[: len(ends)]
    texts = [decode_ids(ids[s:e], data) for s, e in zip(starts.tolist(), ends.tolist())]
    same = [_digest(t) == d for t, d in zip(texts, b.column("digest").to_pylist())]
    return pa.RecordBatch.from_arrays(
        [b.column("doc_id"), b.column("n_segments"), pa.array(ends - starts), pa.array(ids_sum(ids, ends)), pa.array(same, pa.bool_()),
         pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids)), pa.array(texts, pa.string())],
        names=["doc_id", "n_segments", "n_tokens", "ids_checksum", "decoded", "ids", "text"])
