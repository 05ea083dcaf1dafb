"""Hyper-parameter search with its fits side by side.

MLlib's trees need one job per level of every tree; twenty settings of up to 300
trees over three folds are over 80,000 jobs in a row. Here the cluster works on all fits at once, and
every fit sees all rows of its folds:

1. folds, labels and features are written once; what the learner takes from the table as a
   whole (cuts, categories, means) comes from aggregates over all rows;
2. the fits (setting, fold) are dealt over the cores by their cost, and each core's task is sent all
   rows once, in the order of their keys, as packed bytes. It lays them in a file and fits from there; ``max_rows``
   rows are in memory at a time. Settings that differ only in the number of boosting rounds share a fit, scored at several stages;
3. all rows are scored by the models of their own fold, a bounded number of
   models at a time, into one table (combo, fold, y_true, score);
4. one grouped metric pass gives every metric of every setting and fold.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import metrics as M
from riskloom.operators.split import stratified_folds
from riskloom.session import checkpoint_dir, ship_package

MAX_ROWS = 1 << 16  # rows of a fit in memory at a time
MODELS_AT_A_TIME = 24


def _arrays(table: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    col = table.column("x")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, width)


def shared_fits(combos: list[dict], staged: str | None) -> list[tuple[dict, list[tuple[int, int | None]]]]:
    """(parameters of the longest fit, [(combo, stage)]) for the settings that one fit serves."""
    groups: dict[str, list] = {}
    for i, p in enumerate(combos):
        rest = {k: v for k, v in p.items() if k != staged}
        groups.setdefault(repr(sorted(rest.items())), []).append((i, p))
    return [(max((p for _, p in g), key=lambda p: p[staged]) if staged else g[0][1], [(i, p[staged] if staged else None) for i, p in g])
            for g in groups.values()]


def dealt(costs: list[float], slots: int) -> list[list[int]]:
    """Fits dealt over ``slots`` tasks: the costliest first, each to the task with the least so far."""
    load, out = [(0.0, s) for s in range(slots)], [[] for _ in range(slots)]
    for job in sorted(range(len(costs)), key=lambda j: (-costs[j], j)):
        so_far, s = heapq.heappop(load)
        out[s].append(job)
        heapq.heappush(load, (so_far + costs[job], s))
    return out


def scratch(shape, dtype) -> np.ndarray:
    """Zeros in a file without a name, mapped into memory."""
    if not np.prod(shape):
        return np.zeros(shape, dtype)
    with tempfile.TemporaryFile() as f:
        return np.asarray(np.memmap(f, dtype, "w+", shape=shape))


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Fixed-size binary rows as (rows, bytes)."""
    size = column.type.byte_width
    return np.frombuffer(column.buffers()[1], np.uint8, len(column) * size, column.offset * size).reshape(len(column), size)


def _laid(batches, width: int):
    """(slot, packed, y, fold) for each slot of sorted batches (slot, y, fold, packed), the packed rows in a file."""
    def arrays(slot, f, y, fold):
        f.flush()
        n = sum(map(len, y))
        packed = np.asarray(np.memmap(f, np.uint8, "r", shape=(n, width))) if n and width else np.zeros((n, width), np.uint8)
        return slot, packed, np.concatenate(y), np.concatenate(fold)

    now, f, y, fold = None, None, [], []
    for b in batches:
        slots = b.column("slot").to_numpy()
        for slot in np.unique(slots).tolist():
            if slot != now:
                if now is not None:
                    yield arrays(now, f, y, fold)
                    f.close()
                now, f, y, fold = slot, tempfile.TemporaryFile(), [], []
            lo, hi = np.searchsorted(slots, [slot, slot + 1])
            part = b.slice(lo, hi - lo)
            f.write(_bytes_of(part.column("packed").cast(pa.binary(width))).tobytes())
            y.append(part.column("y").to_numpy().astype(float))
            fold.append(part.column("fold").to_numpy().astype(np.int16))
    if now is not None:
        yield arrays(now, f, y, fold)
        f.close()


def score_settings(df: DataFrame, cols: list[str], learner, combos: list[dict], k: int = 3, label: str = "label",
                   key: str = "id", seed: int = 42, max_rows: int = MAX_ROWS) -> DataFrame:
    """(combo, fold, y_true, score): every row of ``df`` scored by every setting
    fitted on all rows of the other folds, ``max_rows`` of them in memory at a time. Rows without a label take no part."""
    spark = df.sparkSession
    ship_package(spark)
    folder = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    known = df.filter(F.col(label).isNotNull())
    (stratified_folds(known, label=label, key=key, k=k, seed=seed)
     .select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"), "fold", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
     .write.parquet(f"{folder}/rows"))
    rows = spark.read.parquet(f"{folder}/rows")
    learner.prepare_from(rows, cols)
    fits = shared_fits(combos, learner.staged)
    width = learner.packed(np.zeros((1, len(cols)))).shape[1]

    def pack(batches):
        for b in batches:
            packed = np.ascontiguousarray(learner.packed(_arrays(b, len(cols))))
            values = pa.Array.from_buffers(pa.binary(width), len(packed), [None, pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("y"), b.column("fold"), values.cast(pa.binary())], names=["key", "y", "fold", "packed"])

    shares = dealt([learner.cost(p) for p, _ in fits for _ in range(k)], max(1, min(len(fits) * k, spark.sparkContext.defaultParallelism)))
    packed = rows.mapInArrow(pack, rows.select("key", "y", "fold", F.lit(b"").alias("packed")).schema)
    sent = (packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1))).alias("slot"))
            .repartitionById(len(shares), F.col("slot")).sortWithinPartitions("slot", F.col("key").asc_nulls_last(), "y", "fold", "packed")
            .select("slot", "y", "fold", "packed"))

    def fit(batches):
        for slot, packed, y, fold in _laid(batches, width):
            for f in range(k):
                use = np.flatnonzero(fold != f)
                for job in shares[slot]:
                    if job % k == f:
                        model = learner.fit_packed(packed, y, use, fits[job // k][0], seed, max_rows, scratch)
                        yield pa.RecordBatch.from_arrays([pa.array([job]), pa.array([pickle.dumps(model)], pa.binary())], names=["job", "model"])

    sent.mapInArrow(fit, "job long, model binary").write.parquet(f"{folder}/models")
    per_pass = max(1, MODELS_AT_A_TIME // k)
    for at in range(0, len(fits), per_pass):
        part = fits[at:at + per_pass]
        fitted = spark.read.parquet(f"{folder}/models").where(F.col("job").between(at * k, (at + len(part)) * k - 1)).collect()
        models = spark.sparkContext.broadcast({r["job"] - at * k: bytes(r["model"]) for r in fitted})

        def score(batches):
            held = {j: pickle.loads(m) for j, m in models.value.items()}
            for b in batches:
                x, y, fold = _arrays(b, len(cols)), b.column("y"), b.column("fold").to_numpy()
                for f in np.unique(fold).tolist():
                    at = np.flatnonzero(fold == f)
                    inputs = learner.inputs(x[at])
                    for group, (_, served) in enumerate(part):
                        stages = sorted({s for _, s in served}, key=lambda s: (s is not None, s))
                        got = dict(zip(stages, learner.scores_of(held[group * k + f], inputs, stages)))
                        for combo, stage in served:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(at), combo, np.int32)), pa.array(np.full(len(at), f, np.int32)), y.take(pa.array(at)), pa.array(got[stage])],
                                names=["combo", "fold", "y_true", "score"])

        (rows.select("y", "fold", "x").mapInArrow(score, "combo int, fold int, y_true int, score double")
         .write.mode("append").parquet(f"{folder}/scored"))
        models.unpersist()
    return spark.read.parquet(f"{folder}/scored")


METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "pr_auc", "threshold", "f1_at_threshold")


def search(df: DataFrame, cols: list[str], learner, combos: list[dict], best_by: str = "f1", k: int = 3, **options) -> DataFrame:
    """One row per setting: combo, params, the mean of each metric over the folds
    (threshold 0.5, and the best threshold of each fold), and ``is_best`` (highest ``best_by``, ties to the first)."""
    scored = score_settings(df, cols, learner, combos, k=k, **options)
    folds = M.summaries(scored, ["combo", "fold"])
    mean = folds.groupBy("combo").agg(*[F.avg(m).alias(m) for m in METRICS])
    best = mean.agg(F.max_by("combo", F.struct(best_by, -F.col("combo")))).scalar()
    names = df.sparkSession.createDataFrame([(i, str(sorted(p.items()))) for i, p in enumerate(combos)], "combo int, params string")
    return names.join(mean, "combo").withColumn("is_best", F.col("combo") == best)
