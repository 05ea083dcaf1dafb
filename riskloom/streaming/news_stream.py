"""The news-preparation projections on a Structured Streaming source.

The reference prepares files in batch; its text steps are stateless
row projections, so the same Column expressions run unchanged on a file
stream (new CSV/Parquet drops in a folder). No state, watermark or
aggregation is involved; the checkpoint goes to the shared folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskloom.operators import text_prep as TP
from riskloom.session import checkpoint_dir


def read_news_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                     max_files_per_trigger: int = 100) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    return r.format(fmt).load(folder)


def prepare_stream(stream: DataFrame, kind: str, threshold: float | None = None) -> DataFrame:
    """Apply the batch loader's projections to a streaming DataFrame."""
    if kind == "financial_news":
        if threshold is None:
            raise ValueError("financial_news needs the confidence threshold")
        return TP.prepare_financial_news(stream, threshold)
    if kind == "fiqa":
        return TP.prepare_fiqa(stream)
    if kind == "reuters":
        return TP.prepare_reuters(stream)
    raise ValueError(f"unknown kind {kind!r}")


def start_parquet_sink(prepared: DataFrame, out_path: str, name: str, trigger_once: bool = False):
    """Append the prepared rows to Parquet; the stream's checkpoint lives
    under the session's shared checkpoint folder, so a restarted query (or
    one whose executors were lost) resumes exactly where it stopped."""
    ckpt = os.path.join(checkpoint_dir(prepared.sparkSession), "streams", name)
    w = prepared.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt) \
        .outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
