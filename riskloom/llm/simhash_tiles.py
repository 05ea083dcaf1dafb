"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint: bit i is set if more than half of the
XXH64 (seed 42) hashes of its word shingles, repeats included, have it set.
Equal fingerprints are one row (least doc_id) before anything is compared.
Fingerprints are tiled by the population counts of their four quarters: two
fingerprints within the radius differ by at most the radius in the sum of the
differences of those counts, so all other pairs of tiles are skipped unseen.
Tiles are dealt into blocks of bounded size, each remaining pair of blocks is
compared exactly with numpy exclusive-or and bit counts, and a pair of blocks
gives only a spanning forest of its links, fewer rows than fingerprints however
many links it has. Components of these edges are found on Spark.

The work of an exact comparison still grows with the square of the number of
distinct fingerprints (times the share of tile pairs kept, about 5 %).

Null and empty texts and texts without a word have fingerprint zero and are
linked like any other. Repeated rows share a fingerprint. Null doc_ids are
returned with their fingerprint and count as no copy of anything: their
component is the least non-null doc_id of the fingerprint's component, or null.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.components import connected_components, spanning_edges
from riskloom.llm.rowwise import add_from_text
from riskloom.session import checkpoint_dir

SHINGLE = 3
RADIUS = 3
SEED = 42
BLOCK = 2048
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, lower-cased A-Z (fewer words: of the whole sequence)."""
    import xxhash
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-size]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1:] - 1).tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, in pieces of bounded memory."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, kept: list[str] | None = None) -> DataFrame:
    """Columns ``kept`` (doc_id) and the fingerprint as a signed 64-bit ``fp``."""
    def make():
        return lambda texts: [pa.array(np.array([majority(shingle_hashes(t, size)) for t in texts], np.uint64).view(np.int64))]

    return add_from_text(docs, kept or ["doc_id"], [T.StructField("fp", T.LongType())], make)


def _near_tiles(radius: int) -> list[list[int]]:
    """Differences of the four quarter counts whose absolute values sum to at
    most ``radius``; of each pair of opposite ones, the lexicographically larger."""
    span = range(-radius, radius + 1)
    return [[a, b, c, d] for a in span for b in span for c in span for d in span
            if abs(a) + abs(b) + abs(c) + abs(d) <= radius and (a, b, c, d) >= (0, 0, 0, 0)]


def block_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into left, right) of fingerprints within ``radius`` bits."""
    found = []
    for at in range(0, len(left), 256):
        near = np.bitwise_count(left[at:at + 256, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        found.append((i + at, j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def fingerprint_edges(distinct: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of ``fp`` values whose components are those of all links within ``radius``."""
    q = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    tiled = distinct.select("fp", F.struct(*[x.cast("int").alias(f"q{i}") for i, x in enumerate(q)]).alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.count("*").alias("n"))
    blocks = (tiled.join(sizes, "tile")
              .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
              .groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")).checkpoint())
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in _near_tiles(radius)])
    left = (blocks.select(F.col("tile").alias("t"), F.col("block").alias("b"), F.col("fps").alias("left"), F.explode(steps).alias("d"))
            .select("t", "b", "left", F.struct(*[(F.col(f"t.q{i}") + F.col(f"d.d{i}")).alias(f"q{i}") for i in range(4)]).alias("tile")))
    pairs = left.join(blocks, "tile").where("tile > t OR block >= b").select("left", F.col("fps").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[np.ndarray] = []
            for x, y in zip(b.column("left"), b.column("right")):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                i, j = block_links(x, y, radius)
                own = x[i] != y[j]
                if own.any():
                    values, at = np.unique(np.concatenate([x[i[own]], y[j[own]]]), return_inverse=True)
                    n, r = spanning_edges(np.split(at, 2), len(values))
                    out.append(np.stack([values[n], values[r]]).view(np.int64))
            e = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def fingerprint_components(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, group) for every row of ``distinct`` (fp); the group is a fingerprint of the component."""
    comp = connected_components(fingerprint_edges(distinct, radius, block))
    return distinct.join(comp, distinct.fp == comp.node, "left").select("fp", F.coalesce("component", "fp").alias("group"))


def simhash_components(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    checkpoint_dir(docs.sparkSession)
    fps = fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), size).checkpoint()
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = distinct.join(fingerprint_components(distinct.select("fp"), radius, block), "fp")
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "group").select("fp", "component_id")
    return (fps.join(by_fp, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
