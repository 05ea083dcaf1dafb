"""Writers: Parquet and CSV, partitioned by split."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 16 << 20  # a writer holds a row group in memory, and a reader a column of it
CSV_NULL = "\\N"  # all fields are quoted, so nothing else tells a null from an empty text
CSV_FILE_ROWS = 20_000  # a file with multi-line fields is read by one task


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", split_col: str = "split",
                 mode: str = "overwrite") -> str:
    """Write one directory per split value (``partitionBy``); CSV gets a
    header and quoted multi-line fields so it reads back unchanged, blanks at
    either end included."""
    w = df.write.mode(mode).partitionBy(split_col)
    if fmt == "parquet":
        w.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    elif fmt == "csv":
        (w.option("header", True).option("escape", '"').option("quoteAll", True).option("maxRecordsPerFile", CSV_FILE_ROWS)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("nullValue", CSV_NULL).option("charToEscapeQuoteEscaping", '"').csv(path))
    else:
        raise ValueError(f"fmt must be parquet or csv, got {fmt!r}")
    return path


def read_splits(spark, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    r = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
         .option("nullValue", CSV_NULL).option("charToEscapeQuoteEscaping", '"'))
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both frames hold the same rows as often as each other (columns by name). Rows are
    compared by SHA-256 over all their values, so only digests are shuffled and sorted, no texts."""
    cols = sorted(a.columns)
    if cols != sorted(b.columns):
        return False
    # the length before each value, and none before a null: no two rows give one text
    text = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    side = lambda d, n: d.select(F.unhex(F.sha2(F.concat(*[text(c) for c in cols]), 256)).alias("row"), F.lit(n).alias("n"))
    return side(a, 1).unionByName(side(b, -1)).groupBy("row").agg(F.sum("n").alias("n")).where("n <> 0").limit(1).count() == 0


def output_path(spark, name: str) -> str:
    """A folder under the shared checkpoint directory (never machine-local
    on a cluster)."""
    from riskloom.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), "riskloom-out", name)
