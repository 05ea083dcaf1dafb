"""Hard-negative mining with angular triangle filtering.

Scores are inner products of whole-number vectors. Every vector's angles to a few
reference directions are stored beside it, with its norm. For an anchor and a tile
of rows that lie close in angle, the triangle inequality of angles gives, from each
direction, a least and a greatest angle between them; the tightest ones give a
cosine interval, and the norms turn it into bounds of the score. Bounds are
widened by far more than the rounding of their computation, so that a tile is left
out only if no row of it can matter: no score of the tile meets the asked window, or none
reaches the last of the best scores known so far. Tiles whose bounds overlap are
scored in whole numbers. Directions change the work, never the result.

Two passes over one grid of blocks (rows x anchors, fixed block sizes): the best
rows of an anchor's own label are its positives, and each positive opens a window
for rows of other labels. A task holds one block of each side, sends at most
``positives`` or ``negatives`` rows per anchor or window, and no pair is ever
a row. Blocks are dealt by row number, so a hot label, id or vector is spread.

Results: rows with a null vec_id, label or vector, or with a null or non-finite
component take no part. A repeated row (same id, label and vector) counts once;
rows that share an id otherwise are rows of their own. Vectors of different lengths
have no score with each other. Equal scores come by smaller id. A negative positive score
gives an empty window. An anchor without positives or negatives has no rows; an empty table
gives an empty result. Components whose whole number would reach 2**24 are an
error, as 100 times a score would leave long. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.integer_vectors import finite, matrix, scaled
from riskloom.session import checkpoint_dir, ship_package

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SCALE = 256
DIRECTIONS = 16
SAMPLE = 1024
BLOCK = 16_384
TILE = 256
SLACK = 1e-5  # radians; stored angles are single precision (2.4e-7)
FOUND = ("anchor", "score", "id", "row")
HARD = ("anchor", "anchor_id", "slot", "positive_id", "positive_score", "score", "id", "row")
NO_LIMIT = np.int64(1) << 62


def spread_directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each the farthest in angle from those before."""
    norms = np.linalg.norm(sample, axis=1)
    x = sample[norms > 0] / norms[norms > 0, None]
    if not len(x):
        return np.eye(1, sample.shape[1])
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(count, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    return x[picked]


def angles_to(x: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of every row to every direction; a zero vector has score 0 whatever its angle."""
    return np.arccos(np.clip(x @ directions.T / np.where(norms > 0, norms, 1.0)[:, None], -1.0, 1.0))


def score_bounds(alpha: np.ndarray, norm: np.ndarray, least: np.ndarray, greatest: np.ndarray, short: float, long: float) -> tuple[np.ndarray, np.ndarray]:
    """Safe bounds of the scores of anchors (angles ``alpha``, norms) with any row
    whose angles lie in [least, greatest] and whose norm lies in [short, long]."""
    near = np.maximum(alpha - greatest, least - alpha).max(1)
    far = np.minimum(alpha + greatest, 2 * np.pi - alpha - least).min(1)
    top = np.cos(np.clip(near - SLACK, 0, np.pi))
    bottom = np.cos(np.clip(far + SLACK, 0, np.pi))
    upper = norm * np.where(top >= 0, long, short) * top
    lower = norm * np.where(bottom >= 0, short, long) * bottom
    margin = 1e-9 * norm * long + 1e-6
    return lower - margin, upper + margin


class Best:
    """The k best (score, then smaller id, then row) entries of every group."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, -NO_LIMIT)
        self.entries = np.zeros((0, 4), np.int64)  # group, score, id, row
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def push(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.held.append(np.stack([group, score, ids, rows], 1))
        self.n_held += len(group)
        if self.n_held > max(4096, 2 * self.k * len(self.floor)):  # floors rise early, sorts stay few
            self.settle()

    def settle(self) -> np.ndarray:
        e = np.concatenate([self.entries, *self.held])
        e = e[np.lexsort((e[:, 3], e[:, 2], -e[:, 1], e[:, 0]))]
        start = np.flatnonzero(np.append(True, e[1:, 0] != e[:-1, 0])) if len(e) else np.zeros(0, np.int64)
        place = np.arange(len(e)) - np.repeat(start, np.diff(np.append(start, len(e))))
        self.entries, self.held, self.n_held = e[place < self.k], [], 0
        last = e[place == self.k - 1]
        self.floor[last[:, 0]] = last[:, 1]
        return self.entries


def best_in_windows(anchors: dict, rows: dict, which: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, int]:
    """Entries (request, score, id, row) of the ``k`` best rows of each request:
    an anchor (number ``which``) and bounds low <= 100 * score <= high. ``same``
    asks for rows of the anchor's label (itself left out), else of others.

    Both sides: row, id, label (codes), v (int64), norm, angles. Also returns the
    number of scores computed."""
    best, scored = Best(len(which), k), 0
    exact = float(anchors["norm"].max(initial=0) * rows["norm"].max(initial=0)) < 2.0 ** 52
    vectors = anchors["v"].astype(np.float64) if exact else anchors["v"]
    home = rows["angles"].argmin(1)
    order = np.lexsort((rows["angles"][np.arange(len(home)), home], home))
    for at in range(0, len(order), TILE):
        tile = order[at:at + TILE]
        theta, norm = rows["angles"][tile], rows["norm"][tile]
        lower, upper = score_bounds(anchors["angles"], anchors["norm"], theta.min(0), theta.max(0), norm.min(), norm.max())
        ask = np.flatnonzero((100 * upper[which] >= low) & (100 * lower[which] <= high) & (upper[which] >= best.floor))
        if not len(ask):
            continue
        mine, back = np.unique(which[ask], return_inverse=True)
        v = rows["v"][tile]
        # sums below 2**53 are exact in doubles
        scores = (vectors[mine] @ v.T.astype(np.float64)).astype(np.int64) if exact else vectors[mine] @ v.T
        scored += scores.size
        alike = anchors["label"][mine][:, None] == rows["label"][tile]
        use = alike & (anchors["row"][mine][:, None] != rows["row"][tile]) if same else ~alike
        s = scores[back]
        hit = use[back] & (100 * s >= low[ask, None]) & (100 * s <= high[ask, None]) & (s >= best.floor[ask, None])
        r, c = np.nonzero(hit)
        best.push(ask[r], s[r, c], rows["id"][tile][c], rows["row"][tile][c])
    return best.settle(), scored


def _side(table: pa.Table, width: int) -> dict:
    angles = table.column("angles").combine_chunks()
    return {"row": table.column("row").to_numpy(), "id": table.column("id").to_numpy(), "v": matrix(table.column("v"), width),
            "norm": table.column("norm").to_numpy(), "angles": angles.flatten().to_numpy().reshape(len(angles), -1).astype(np.float64)}


def _sides(left: pa.Table, right: pa.Table, width: int) -> tuple[dict, dict]:
    """Both sides with label codes that agree, whatever the labels' type."""
    a, b = _side(left, width), _side(right, width)
    codes = pa.chunked_array(left.column("label").chunks + right.column("label").chunks).combine_chunks().dictionary_encode().indices.to_numpy()
    a["label"], b["label"] = codes[:left.num_rows], codes[left.num_rows:]
    return a, b


def _ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stored_angles(vectors: DataFrame, scale: int, directions: int, sample: int) -> str:
    """Folder with row, id, label, v, width, norm, angles of the rows that take part."""
    spark = vectors.sparkSession
    part = vectors.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    rows = part.select(F.col("vec_id").cast("long").alias("id"), "label", scaled("embedding", scale, 1 << 24).alias("v"))
    drawn: dict[int, list] = {}
    for r in rows.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(sample).collect():
        drawn.setdefault(len(r["v"]), []).append(r["v"])
    books = spark.sparkContext.broadcast({w: spread_directions(np.array(v, float).reshape(len(v), w), directions) for w, v in drawn.items()})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            widths = np.diff(v.offsets.to_numpy())
            norms, angles = np.zeros(len(v)), [None] * len(v)
            for w in np.unique(widths).tolist():
                at = np.flatnonzero(widths == w)
                x = matrix(v.take(pa.array(at)), w).astype(np.float64)
                norms[at] = np.sqrt((x * x).sum(1))
                book = books.value.get(w)
                found = angles_to(x, norms[at], np.eye(1, w) if book is None else book)
                for i, t in zip(at.tolist(), found.astype(np.float32)):
                    angles[i] = t
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), v, pa.array(widths.astype(np.int32)), pa.array(norms),
                                              pa.array(angles, pa.list_(pa.float32()))], names=["id", "label", "v", "width", "norm", "angles"])

    label = part.schema["label"].dataType.simpleString()
    out = rows.distinct().mapInArrow(measure, f"id long, label {label}, v array<int>, width int, norm double, angles array<float>")
    path = f"{checkpoint_dir(spark)}/angles-{uuid.uuid4().hex}"
    out.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return path


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE, directions: int = DIRECTIONS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on vec_id. ``sample`` rows at most are drawn for the
    directions; blocks hold about ``block`` rows of each side."""
    spark = vectors.sparkSession
    ship_package(spark)
    path = stored_angles(vectors, scale, directions, sample)
    stored = spark.read.parquet(path)  # read anew for each side, as a table is not joined with itself
    asked = spark.read.parquet(path).withColumnRenamed("id", "vec_id").where(anchor).withColumnRenamed("vec_id", "id")
    n = stored.count()
    n_rows, n_anchors = (max(1, -(-m // block)) for m in (n, asked.count()))
    deal = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    grid = ["width", "x", "y"]
    right = stored.withColumn("x", deal(n_rows)).withColumn("y", every(n_anchors)).groupBy(*grid)
    placed = asked.withColumn("y", deal(n_anchors)).withColumn("x", every(n_rows))

    def longs(*names: str) -> pa.Table:
        return pa.table({c: pa.array([], pa.int64()) for c in names})

    def first_pass(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return longs(*FOUND)
        a, b = _sides(left, right, key[0].as_py())
        all_ = np.full(len(a["row"]), NO_LIMIT)
        e, _ = best_in_windows(a, b, np.arange(len(all_)), -all_, all_, True, positives)
        return pa.table({"anchor": a["row"][e[:, 0]], "score": e[:, 1], "id": e[:, 2], "row": e[:, 3]})

    found = placed.groupBy(*grid).cogroup(right).applyInArrow(first_pass, ", ".join(f"{c} long" for c in FOUND))
    kept = (_ranked(found, ["anchor"], positives).groupBy("anchor")
            .agg(F.collect_list(F.struct("rank", "id", "score")).alias("p")))  # at most ``positives``
    chosen = f"{checkpoint_dir(spark)}/positives-{uuid.uuid4().hex}"
    kept.select(F.col("anchor").alias("row"), F.col("p.rank").alias("slot"), F.col("p.id").alias("pid"), F.col("p.score").alias("ps")).write.parquet(chosen)
    windows = placed.join(spark.read.parquet(chosen), "row")

    def second_pass(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return longs(*HARD)
        a, b = _sides(left, right, key[0].as_py())
        lists = {c: left.column(c).combine_chunks() for c in ("slot", "pid", "ps")}
        which = np.repeat(np.arange(left.num_rows), np.diff(lists["ps"].offsets.to_numpy()))
        slot, pid, ps = (lists[c].flatten().to_numpy().astype(np.int64) for c in ("slot", "pid", "ps"))
        e, _ = best_in_windows(a, b, which, low * ps, high * ps, False, negatives)
        r = e[:, 0]
        return pa.table({"anchor": a["row"][which[r]], "anchor_id": a["id"][which[r]], "slot": slot[r], "positive_id": pid[r],
                         "positive_score": ps[r], "score": e[:, 1], "id": e[:, 2], "row": e[:, 3]})

    hard = windows.groupBy(*grid).cogroup(right).applyInArrow(second_pass, ", ".join(f"{c} long" for c in HARD))
    return _ranked(hard, ["anchor", "slot"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
