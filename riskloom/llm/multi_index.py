"""Embedding near-duplicates through an inverted multi-index.

Vectors are scaled to unit length in double precision; equal vectors are one
row (least vec_id, number of copies). Two independent codebooks, one per half of
the vector, form a product grid; every vector lies in one cell. From each
occupied cell a multi-sequence traversal visits the cells of the grid in order
of the distance of their centres until the target recall is reached. How far that
is, is calibrated on a bounded sample with the hardest partners there are:
synthetic vectors at exactly the threshold cosine in random directions. A pair of
cells is compared if either one's traversal visits the other, so the relation is
symmetric.

Neighbouring cells of the grid are bundled into units of about ``UNIT`` vectors
(a hot unit is divided by a hash into blocks of that size), and vectors are sent
once per pair of blocks that has cells to compare, not once per pair of cells:
that keeps the shuffle small. In a pair of blocks only the visiting pairs of
cells are verified, exactly, in double precision, and the result is link counts
per vector and a spanning forest of the links, never the links themselves.

Codebooks are fitted on at most about ``SAMPLE`` vectors; their size grows with
the square root of the number of vectors so that cells keep their size.

Vectors of different lengths never link; each length has a grid of its own, one
after the other (a table holds few lengths). Null and empty vectors and vectors
that are zero or hold null or non-finite components link with nothing: n_links 0,
their own component, kept. Repeated rows with one vec_id count as vectors of
their own in n_links. Null vec_ids are returned; they link, but name no component
unless all of its ids are null. An empty table gives an empty result. Extra
columns (labels) are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import connected_components, spanning_edges
from riskloom.session import checkpoint_dir, ship_package

THRESHOLD = 0.9
RECALL = 0.995
SAMPLE = 20_000
CELL = 64
UNIT = 8192
ROWS = 256
PROBES = 2_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's iterations from distinct random rows; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (centres * centres).sum(1)
    for at in range(0, len(x), 4096):
        out[at:at + 4096] = (norms - 2 * x[at:at + 4096] @ centres.T).argmin(1)
    return out


def multi_sequence(first: np.ndarray, second: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The ``count`` cells (i, j) of least first[i] + second[j], nearest first:
    a heap over two sorted lists, as in the inverted multi-index."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (first[a[u]] + second[b[v]], u, v))
    return out


class ProductGrid:
    """Two codebooks and the distances between their centres."""

    def __init__(self, sample: np.ndarray, k: int):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, :self.half], k), kmeans(sample[:, self.half:], k, seed=4)]
        # near centres get near numbers: sorted along their longest direction
        for h, book in enumerate(self.books):
            _, _, axes = np.linalg.svd(book - book.mean(0), full_matrices=False)
            self.books[h] = book[np.argsort(book @ axes[0], kind="stable")]
        self.k = len(self.books[1])
        self.between = [((b[:, None] - b[None]) ** 2).sum(2) for b in self.books]
        self.reaches: dict = {}

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers: first codeword * k + second."""
        return nearest(x[:, :self.half], self.books[0]) * self.k + nearest(x[:, self.half:], self.books[1])

    def reach(self, cell: int, count: int) -> float:
        """Distance of the last of the ``count`` cells that a traversal from ``cell`` visits."""
        got = self.reaches.get((cell, count))
        if got is None:
            first, second = (self.between[h][c] for h, c in enumerate(divmod(cell, self.k)))
            i, j = multi_sequence(first, second, count)[-1]
            got = self.reaches[cell, count] = float(first[i] + second[j])
        return got

    def meets(self, cell: int, others: np.ndarray, count: int) -> np.ndarray:
        """Which of the other cells a traversal from ``cell`` visits."""
        i, j = divmod(cell, self.k)
        u, v = np.divmod(others, self.k)
        return self.between[0][i, u] + self.between[1][j, v] <= self.reach(cell, count) + 1e-12

    def calibrate(self, sample: np.ndarray, threshold: float, recall: float, probes: int = PROBES, seed: int = 9) -> int:
        """Cells to visit so that a partner at the threshold cosine is met with
        the target recall. Either side's visit finds the pair, so the lesser
        rank of the two counts."""
        rng = np.random.default_rng(seed)
        x = sample[rng.choice(len(sample), min(probes, len(sample)), replace=False)]
        u = rng.normal(size=x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
        y = threshold * x + math.sqrt(1 - threshold ** 2) * u
        total = self.between[0].shape[0] * self.between[1].shape[0]
        ranks = np.empty(len(x))
        for n, (a, b) in enumerate(zip(self.cells(x).tolist(), self.cells(y).tolist())):
            (i, j), (u, v) = divmod(a, self.k), divmod(b, self.k)
            d = self.between[0][i, u] + self.between[1][j, v]
            ranks[n] = min((self.between[0][p][:, None] + self.between[1][q][None, :] <= d + 1e-12).sum() for p, q in ((i, j), (u, v)))
        return int(min(total, np.quantile(ranks, recall, method="higher") if len(ranks) else total))


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec (unit, doubles) and whether it can link (``ok``)."""
    e = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    top = F.array_max(F.transform("e", F.abs))  # scaled first: squares must neither overflow nor vanish
    fine = F.coalesce(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (top > 0), F.lit(False))
    scaled = embeddings.select("vec_id", e.alias("e")).select("vec_id", F.when(fine, F.transform("e", lambda v: v / top + 0.0)).alias("s"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v))
    return scaled.select("vec_id", F.transform("s", lambda v: v / norm).alias("vec"), F.col("s").isNotNull().alias("ok"))


def block_links(left: tuple, right: tuple, grid: ProductGrid, count: int, threshold: float, same: bool):
    """Verified links between two blocks, each (cells, copies, unit vectors)
    sorted by cell: number of linked copies for each left and right row, and the
    spanning forest of the links over left rows, then right rows."""
    (ca, na, x), (cb, nb, y) = left, right
    la, lb = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    others = np.unique(cb)
    far = np.array([grid.reach(int(c), count) for c in others])
    at = np.append(np.flatnonzero(np.append(True, ca[1:] != ca[:-1])), len(ca))
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        cell = int(ca[s])
        i, j = divmod(cell, grid.k)
        u, v = np.divmod(others, grid.k)
        d = grid.between[0][i, u] + grid.between[1][j, v]
        sel = np.flatnonzero(np.isin(cb, others[d <= np.maximum(far, grid.reach(cell, count)) + 1e-12]))
        if same:  # each unordered pair once
            sel = sel[sel >= s]
        for lo in range(s, e, ROWS):
            hi = min(e, lo + ROWS)
            near = x[lo:hi] @ y[sel].T >= threshold
            if same:
                near &= sel[None, :] > np.arange(lo, hi)[:, None]
            if near.any():
                la[lo:hi] += near @ nb[sel]
                lb[sel] += na[lo:hi] @ near
                p, q = np.nonzero(near)
                node, root = spanning_edges((p, q + hi - lo), hi - lo + len(sel))
                ids = np.concatenate([np.arange(lo, hi), sel if same else sel + len(ca)])
                edges.append((ids[node], ids[root]))
    if same:
        la, lb = la + lb, lb[:0]
    size = len(ca) + len(lb)
    label = np.arange(size)
    if edges:
        node, root = spanning_edges(tuple(np.concatenate(e) for e in zip(*edges)), size)
        label[node] = root
    return np.concatenate([la, lb]), label


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE,
                    cell: int = CELL, unit: int = UNIT) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    units = unit_vectors(embeddings.select("vec_id", "embedding")).checkpoint()
    out = units.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for row in units.where("ok").select(F.size("vec").alias("n")).distinct().orderBy("n").collect():
        out = out.unionByName(linked_vectors(units.where(F.col("ok") & (F.size("vec") == row["n"])), threshold, recall, sample, cell, unit))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def linked_vectors(units: DataFrame, threshold: float, recall: float, sample: int, cell: int, unit: int) -> DataFrame:
    """vec_id, n_links, component_id of ``units`` (vec_id, vec), unit vectors of one length."""
    spark = units.sparkSession
    reps = (units.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
            .select("vec", "least", "copies", F.monotonically_increasing_id().alias("rep")).checkpoint())
    n = reps.count()
    draw = F.pmod(F.xxhash64("vec"), F.lit(1 << 40)) < F.lit(int(min(1.0, sample / n) * (1 << 40)))
    picked = np.array([r["vec"] for r in reps.where(draw).select("vec", F.xxhash64("vec").alias("h")).orderBy("h").collect()]
                      or [reps.select("vec").first()["vec"]], float)
    grid = ProductGrid(picked, max(1, math.ceil(math.sqrt(n / cell))))
    count = grid.calibrate(picked, threshold, recall)
    shared = spark.sparkContext.broadcast(grid)

    bundle = max(1, round(unit * len(grid.books[0]) * grid.k / n))  # cells of a unit

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("vec")
            cells = shared.value.cells(v.flatten().to_numpy().reshape(len(v), -1)) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rep"), v, b.column("copies"), pa.array(cells), pa.array(cells // bundle)],
                                             names=["rep", "vec", "copies", "cell", "unit"])

    placed = reps.select("rep", "vec", "copies").mapInArrow(assign, "rep long, vec array<double>, copies long, cell long, unit long").checkpoint()
    blocks = (placed.groupBy("unit").agg(F.count("*").alias("n"))
              .select("unit", F.ceil(F.col("n") / unit).cast("long").alias("blocks")))
    placed = placed.join(blocks, "unit").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        every = np.arange(len(grid.books[0]) * grid.k)
        for b in batches:
            for c in b.column("cell").to_pylist():
                met = np.unique(every[grid.meets(c, every, count)] // bundle)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(met, c // bundle)), pa.array(np.maximum(met, c // bundle))], names=["a", "b"])

    unit_pairs = placed.select("cell").distinct().mapInArrow(visit, "a long, b long").distinct()
    spread = blocks.select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    pairs = (unit_pairs.join(spread.select(F.col("unit").alias("a"), F.col("block").alias("x")), "a")
             .join(spread.select(F.col("unit").alias("b"), F.col("block").alias("y")), "b")
             .where("a < b OR x <= y").select(F.struct("a", "x", "b", "y").alias("pair")))
    sides = pairs.select("pair", F.explode(F.when(F.expr("pair.a = pair.b AND pair.x = pair.y"), F.array(F.struct(F.col("pair.a").alias("unit"), F.col("pair.x").alias("block"), F.lit(0).alias("side"))))
                                           .otherwise(F.array(F.struct(F.col("pair.a").alias("unit"), F.col("pair.x").alias("block"), F.lit(0).alias("side")),
                                                              F.struct(F.col("pair.b").alias("unit"), F.col("pair.y").alias("block"), F.lit(1).alias("side"))))).alias("s"))
    sent = placed.join(sides.select("pair", "s.unit", "s.block", "s.side"), ["unit", "block"]).select("pair", "side", "rep", "copies", "cell", "vec")

    def verify(key, table):
        table = table.sort_by([("side", "ascending"), ("cell", "ascending"), ("rep", "ascending")])
        side, rep, copies, cell = (table.column(c).to_numpy() for c in ("side", "rep", "copies", "cell"))
        vec = table.column("vec").combine_chunks()
        x = vec.flatten().to_numpy().reshape(len(vec), -1)
        m = int((side == 0).sum())
        same = m == len(side) and key[0].as_py()["a"] == key[0].as_py()["b"] and key[0].as_py()["x"] == key[0].as_py()["y"]
        left, right = ((cell[p], copies[p], x[p]) for p in (slice(0, m), slice(0, m) if same else slice(m, None)))
        links, label = block_links(left, right, shared.value, count, threshold, same)
        use = links > 0
        return pa.table({"rep": rep[use], "links": links[use], "root": rep[label[use]]})

    found = sent.groupBy("pair").applyInArrow(verify, "rep long, links long, root long").checkpoint()
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (reps.select("vec", "least", "copies", "rep").join(links, "rep", "left").join(comp, comp.node == F.col("rep"), "left")
             .select("vec", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")))
    ids = named.groupBy("c").agg(F.min("least").alias("component_id"))
    by_vec = named.join(ids, "c").select("vec", "n_links", "component_id")
    return units.select("vec_id", "vec").join(by_vec, "vec").select("vec_id", "n_links", "component_id")
