"""Exact k-nearest-neighbour join on a grid of blocks, and its approximate form.

Plan of the exact join:

1. Both sides are checked and written once to the shared checkpoint folder.
2. Query rows and base rows are dealt by a seeded hash into blocks whose size comes
   from the width of the vectors (``BLOCK_BYTES``), so no task holds more than two blocks
   whatever the data look like. The blocks of both sides of a group form a grid; each field
   of it is one cogrouped task.
3. A task holds tiles of lower bounds (single-precision dot products, or sums of small whole
   numbers) against the k-th best distance of each query so far, and compares exactly (in the
   difference form) what they leave open. Pairs are never rows.
4. The k best of each query over the base blocks are a top-k by rank, cut down
   before and after the shuffle.

``method="lsh"`` deals the rows by random-projection buckets instead and compares only
within a bucket: sub-quadratic, and approximate. A bucket of any size is divided into blocks
like the exact grid.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.split import seeded_int
from riskloom.session import checkpoint_dir, ship_package

METRICS = ("euclidean", "manhattan", "minkowski")
BLOCK_BYTES = 32 << 20
TILE = (256, 2048), (64, 4096)  # rows of both sides whose distances are estimated at a time: by dot products, by sums
PAIRS = 1 << 16  # pairs compared exactly at a time
GROUPS = 10_000  # tables of so few groups are broadcast
FOUND = "query_id long, neighbor_id long, distance double"


def _exact(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances between rows of equal number, difference form."""
    diff = q - b
    return np.abs(diff).sum(-1) if metric == "manhattan" else np.sqrt((diff * diff).sum(-1))


def _square_bounds(q: np.ndarray, b: np.ndarray):
    """Lower bounds of squared distances by single-precision dot products, and the greatest
    bound that a distance allows. Vectors are scaled to at most 1 and moved to the middle of the base;
    the squares are cut by the largest error that rounding can make, so no bound exceeds its distance."""
    width = q.shape[1]
    scale = max(np.abs(q).max(), np.abs(b).max(), 1e-300)
    middle = np.median(b[:1024] / scale, axis=0)
    u, v = q / scale - middle, b / scale - middle
    cut = 1 - (width + 8) * 2.0 ** -23
    one = lambda x: np.ones((len(x), 1))
    u = np.hstack([-2 * u, cut * (u * u).sum(1)[:, None], one(u)]).astype(np.float32)
    v = np.ascontiguousarray(np.hstack([v, one(v), cut * (v * v).sum(1)[:, None]]).astype(np.float32).T)

    def bounds(lo: int, hi: int, at: int, to: int) -> np.ndarray:
        return u[lo:hi] @ v[:, at:to]

    def limits(dist: np.ndarray, lo: int, hi: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((dist / scale + 1e-14) ** 2 * (1 + 1e-6) + 1e-30).astype(np.float32)

    return bounds, limits


def _sum_bounds(q: np.ndarray, b: np.ndarray):
    """Lower bounds of sums of absolute differences from components rounded to small whole
    numbers, and the greatest bound that a distance allows. Components far outside the base's bulk are
    clipped, which brings no two nearer than they are; each row's rounding error is added to its limit."""
    low, high = b.min(0), b.max(0)
    inner = np.quantile(b[:: max(1, len(b) // 4096)], [0.001, 0.999], axis=0)
    far = 8 * (inner[1] - inner[0]).max()
    if far > 0:
        low, high = np.maximum(low, inner[0] - far), np.minimum(high, inner[1] + far)
    span = np.minimum(high - low, 1e300)
    step = max(span.max() / 32_000, span.sum() / 65_000, 1e-300)

    def whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = (np.clip(x, low, high) - low) / step
        n = np.rint(y)
        return np.ascontiguousarray(n.astype(np.int16).T), np.abs(y - n).sum(1) + 1e-6 * len(low)

    (u, off_q), (v, off_b) = whole(q), whole(b)
    slack = off_q + off_b.max()

    def bounds(lo: int, hi: int, at: int, to: int) -> np.ndarray:
        total, diff = np.zeros((hi - lo, to - at), np.uint16), np.empty((hi - lo, to - at), np.int16)
        for x, y in zip(u, v):
            np.subtract(x[lo:hi, None], y[at:to], out=diff)
            np.abs(diff, out=diff)
            np.add(total, diff.view(np.uint16), out=total)
        return total

    def limits(dist: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return np.clip(np.ceil(dist * (1 + 1e-12) / step + slack[lo:hi]), 0, 65_535).astype(np.uint16)

    return bounds, limits


def first_copies(vectors: np.ndarray, marks: np.ndarray | None, k: int) -> np.ndarray:
    """Rows without those that have ``k`` rows of the same vector and mark before them."""
    odd = np.random.default_rng(1).integers(0, 1 << 62, vectors.shape[1] + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = np.ascontiguousarray(vectors).view(np.uint64)
    with np.errstate(over="ignore"):
        name = ((bits ^ (bits >> np.uint64(29))) * odd[:-1]).sum(1, dtype=np.uint64)
        if marks is not None:
            name += marks.astype(np.uint64) * odd[-1]
    order = np.argsort(name, kind="stable")
    first = np.append(True, name[order][1:] != name[order][:-1])
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    late = np.flatnonzero(np.arange(len(order)) - start >= k)
    same = (bits[order[late]] == bits[order[start[late]]]).all(1)
    if marks is not None:
        same &= marks[order[late]] == marks[order[start[late]]]
    return np.setdiff1d(np.arange(len(order)), order[late[same]])


def _true_places(flags: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of flags that are nearly all false: eight at a time first."""
    whole = len(flags) // 8 * 8
    words = np.flatnonzero(flags[:whole].view(np.uint64))
    inner = np.flatnonzero(flags[:whole].reshape(-1, 8)[words])
    return np.concatenate([8 * words[inner >> 3] + (inner & 7), whole + np.flatnonzero(flags[whole:])])


def nearest_in_block(q: np.ndarray, b: np.ndarray, k: int, metric: str, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, distance) of the k nearest base rows of every query,
    ties by base row. ``allowed(r, c)`` tells of query rows r and base rows c (arrays that
    broadcast) which pairs count.

    Tile by tile, a lower bound of each distance is held against the k-th best distance so
    far; what it leaves open is compared exactly. Nothing else is kept of a tile."""
    real_q, real = np.flatnonzero(np.isfinite(q).all(1)), np.flatnonzero(np.isfinite(b).all(1))  # others are nowhere near
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not (len(real_q) and len(real)):
        return empty
    if len(real_q) < len(q) or len(real) < len(b):
        inner = None if allowed is None else lambda r, c: allowed(real_q[r], real[c])
        r, c, dist = nearest_in_block(q[real_q], b[real], k, metric, inner)
        return real_q[r], real[c], dist
    rows, width = TILE[metric == "manhattan"]
    bounds, limits = (_sum_bounds if metric == "manhattan" else _square_bounds)(q, b)
    out: list[tuple] = []

    def measured(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            parts = [_exact(q[r[i:i + PAIRS]], b[c[i:i + PAIRS]], metric) for i in range(0, len(r), PAIRS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    for lo in range(0, len(q), rows):
        hi = min(lo + rows, len(q))
        best, found = np.full((hi - lo, k), np.inf), np.full((hi - lo, k), len(b))
        for at in range(0, len(b), width):
            to = min(at + width, len(b))
            low, kth = bounds(lo, hi, at, to), best[:, -1].copy()
            new = np.flatnonzero(np.isinf(kth))
            if len(new) and to - at > k:  # no k-th best yet: the k lowest bounds give one
                some = low[new].astype(np.float32)
                if allowed is not None:
                    some[~allowed(lo + new[:, None], np.arange(at, to))] = np.inf
                c = np.argpartition(some, k - 1, axis=1)[:, :k]
                dist = measured(np.repeat(lo + new, k), (at + c).ravel()).reshape(-1, k)
                kth[new] = np.where(np.take_along_axis(some, c, 1) < np.inf, dist, np.inf).max(1)
            open_ = low <= limits(kth, lo, hi)[:, None]
            open_[best[:, -1] == 0] = False  # nothing is nearer, and base rows come in order
            r, c = np.divmod(_true_places(open_.ravel()), to - at)
            c += at
            if allowed is not None:
                use = allowed(lo + r, c)
                r, c = r[use], c[use]
            dist = measured(lo + r, c)
            use = (dist <= kth[r]) & (dist < best[r, -1])
            r, c, dist = r[use], c[use], dist[use]
            if len(r):
                names, own = np.unique(r, return_inverse=True)
                r = np.concatenate([np.repeat(np.arange(len(names)), k), own])
                c, dist = np.concatenate([found[names].ravel(), c]), np.concatenate([best[names].ravel(), dist])
                order = np.lexsort((c, dist, r))
                r, c, dist = r[order], c[order], dist[order]
                start = np.searchsorted(r, np.arange(len(names)))
                top = start[:, None] + np.arange(k)
                best[names], found[names] = dist[top], c[top]
        use = np.isfinite(best)
        out.append((np.nonzero(use)[0] + lo, found[use], best[use]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _written(queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, within: str | None, apart: str | None) -> str:
    """Folder of both sides (id, vec, grp, mark, side). A vector with a missing or NaN
    component has no distance to anything and is an error."""
    def side(df: DataFrame, name: str) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(True))
        fail = F.raise_error(F.concat(F.lit("NULL or NaN in the vector of "), F.col(id_col).cast("string"))).cast("array<double>")
        text = lambda c: F.col(c).cast("string") if c else F.lit("")
        return df.select(F.col(id_col).cast("long").alias("id"), F.when(bad, fail).otherwise(v).alias("vec"),
                         text(within).alias("grp"), text(apart).alias("mark"), F.lit(name).alias("side"))

    path = f"{checkpoint_dir(base.sparkSession)}/knn-{uuid.uuid4().hex}"
    side(queries, "q").unionByName(side(base, "b")).write.parquet(path)
    return path


def grid_of_groups(per_group: DataFrame, rows_q: int, rows_b: int) -> DataFrame:
    """(grp, in_q, in_b): how many blocks either side of a group (grp, n_q, n_b) is dealt into."""
    blocks = lambda n, rows: F.ceil(F.col(n) / rows).cast("int")
    return per_group.where("n_q > 0 AND n_b > 0").select("grp", blocks("n_q", rows_q).alias("in_q"), blocks("n_b", rows_b).alias("in_b"))


def knn_join(queries: DataFrame, base: DataFrame, k: int = 5, metric: str = "euclidean",
             id_col: str = "vec_id", vec_col: str = "embedding", exclude_self: bool = False,
             within: str | None = None, apart: str | None = None, method: str = "exact",
             block_rows: int | None = None, seed: int = 42, bucket_length: float | None = None, tables: int = 8) -> DataFrame:
    """(query_id, neighbor_id, rank, distance) for the k nearest base rows
    of every query row; ties broken by neighbour id.

    ``within`` names a column of both sides: neighbours come from the query's own
    group, and the group is the first column of the result (many searches in one
    join). ``apart`` names a column whose value must differ (cross-validation
    folds). ``method="lsh"`` is approximate: ``tables`` random projections with buckets of
    ``bucket_length``; its recall depends on both."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    if method not in ("exact", "lsh"):
        raise ValueError(f"method must be exact|lsh, got {method!r}")
    if method == "lsh" and (bucket_length is None or metric == "manhattan"):
        raise ValueError("method 'lsh' needs bucket_length and the euclidean metric")
    metric = "euclidean" if metric == "minkowski" else metric
    spark = base.sparkSession
    ship_package(spark)
    path = _written(queries, base, id_col, vec_col, within, apart)
    read = lambda side: spark.read.parquet(path).where(F.col("side") == side).drop("side")
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    per_group = spark.read.parquet(path).groupBy("grp").agg(count("q").alias("n_q"), count("b").alias("n_b"), F.max(F.size("vec")).alias("d"))
    size = per_group.agg(F.sum("n_q").alias("n_q"), F.max("d").alias("d"), F.count(F.lit(1)).alias("groups")).first()
    rows = block_rows or max(1024, BLOCK_BYTES // (8 * max(1, size["d"] or 1)))
    # queries are spread over all cores even if one block could hold them
    rows_q = block_rows or min(rows, max(256, -(-(size["n_q"] or 0) // max(1, spark.sparkContext.defaultParallelism))))
    q, b = read("q"), read("b")
    keys = ["grp"]
    if method == "lsh":
        q, b = (_bucketed(side, max(1, size["d"] or 1), bucket_length, tables, seed) for side in (q, b))
        keys = ["grp", "table", "bucket"]
    deal = lambda n: (seeded_int(seed, "id") % n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    fields = None
    # blocks of each group or bucket, from its own size
    if method == "lsh":
        count = lambda side, rows, name: side.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
        in_both = count(q, rows_q, "in_q").join(count(b, rows, "in_b"), keys)
    else:
        in_both = grid_of_groups(per_group, rows_q, rows)
        fields = in_both.agg(F.sum(F.col("in_q").cast("long") * F.col("in_b"))).first()[0] or 1
        in_both = F.broadcast(in_both) if size["groups"] <= GROUPS else in_both
    q, b = q.join(in_both, keys), b.join(in_both, keys)
    in_q, in_b = F.col("in_q"), F.col("in_b")
    left = q.withColumn("x", deal(in_q)).withColumn("y", every(in_b))
    right = b.withColumn("y", deal(in_b)).withColumn("x", every(in_q))
    grid = [*keys, "x", "y"]
    kk = k  # captured by the tasks

    def nearest(key, lt: pa.Table, rt: pa.Table) -> pa.Table:
        lt, rt = lt.combine_chunks(), rt.sort_by("id").combine_chunks()
        ids, near = lt.column("id").to_numpy(), rt.column("id").to_numpy()
        names = ["grp", "query_id", "neighbor_id", "distance"]
        if not (len(ids) and len(near)):
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.float64())], names=names)
        qv, bv = (t.column("vec").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (lt, rt))
        marks = (None, None)
        if apart:
            both = pa.concat_arrays([t.column("mark").combine_chunks() for t in (lt, rt)]).dictionary_encode()
            codes = both.indices.fill_null(-1).to_numpy()
            marks = codes[:len(ids)], codes[len(ids):]
        # of equal vectors the first are enough; with repeated ids they may all be the query itself
        if not (exclude_self and len(np.unique(near)) < len(near)):
            some = first_copies(bv, marks[1], kk + exclude_self)
            near, bv, marks = near[some], bv[some], (marks[0], marks[1][some] if apart else None)

        def allowed(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            ok = ids[r] != near[c] if exclude_self else True
            return ok & (marks[0][r] != marks[1][c]) if apart else ok

        r, c, dist = nearest_in_block(qv, bv, kk, metric, allowed if exclude_self or apart else None)
        return pa.table([pa.array([key[0].as_py()] * len(r), pa.string()), pa.array(ids[r]), pa.array(near[c]), pa.array(dist)], names=names)

    cols = ["id", "vec", "mark"]
    left, right = left.select(*grid, *cols), right.select(*grid, *cols)
    if fields:  # the fields are dealt over more tasks than there are fields, so that few share one
        left, right = (side.repartition(int(min(4 * fields, 16 * spark.sparkContext.defaultParallelism)), *grid) for side in (left, right))
    found = (left.groupBy(*grid).cogroup(right.groupBy(*grid))
             .applyInArrow(nearest, f"grp string, {FOUND}"))
    if method == "lsh":
        found = found.distinct()  # a pair may share several buckets
    w = Window.partitionBy("grp", "query_id").orderBy("distance", "neighbor_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    out = ["query_id", "neighbor_id", "rank", "distance"]
    return best.select(F.col("grp").cast(base.schema[within].dataType).alias(within), *out) if within else best.select(*out)


def _bucketed(side: DataFrame, width: int, length: float, tables: int, seed: int) -> DataFrame:
    """One row per table with the bucket of the vector's random projection."""
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(tables, width))
    axes /= np.linalg.norm(axes, axis=1, keepdims=True)
    shift = rng.random(tables) * length

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                v = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
                bucket = np.floor((v @ axes.T + shift) / length).astype(np.int64)
                table = pa.Table.from_batches([batch])
                for t in range(tables):
                    out = table.append_column("table", pa.array(np.full(batch.num_rows, t, np.int32))).append_column("bucket", pa.array(bucket[:, t]))
                    yield from out.to_batches()

    return side.mapInArrow(project, "id long, vec array<double>, grp string, mark string, table int, bucket long")


def knn_classify(neighbors: DataFrame, labels: DataFrame, weights: str = "uniform",
                 id_col: str = "vec_id", label_col: str = "label", within: str | None = None) -> DataFrame:
    """Vote of each query's neighbours: ([within,] query_id, proba, y_pred).

    ``uniform`` counts each neighbour once; ``distance`` weighs by 1/d, and
    a query with any zero-distance neighbour uses only those. Ties between
    the classes go to class 0 (argmax takes the first)."""
    g = [within] if within else []
    # once per id: rows that a sampler repeated must not vote more than they were found
    lab = labels.select(*g, F.col(id_col).alias("neighbor_id"), F.col(label_col).alias("_y")).distinct()
    j = neighbors.join(lab, [*g, "neighbor_id"])
    if weights == "uniform":
        w = F.lit(1.0)
        agg = j.groupBy(*g, "query_id").agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("proba"))
    elif weights == "distance":
        zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(*g, "query_id"))
        j = j.withColumn("_z", zero)
        w = F.when(F.col("_z") == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
        agg = j.groupBy(*g, "query_id").agg((F.sum(w * F.col("_y")) / F.sum(w)).alias("proba"))
    else:
        raise ValueError(f"weights must be uniform|distance, got {weights!r}")
    return agg.withColumn("y_pred", (F.col("proba") > 0.5).cast("int"))
