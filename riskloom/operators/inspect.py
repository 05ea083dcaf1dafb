"""Frame inspection: profile, cardinalities, class balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_profile(df: DataFrame) -> DataFrame:
    """``.info()``/``.shape``: one aggregate pass, then one row per column
    (column_name, non_null, total_rows)."""
    aggs = [F.count(F.col(c)).alias(c) for c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    stacked = wide.unpivot("__rows", df.columns, "column_name", "non_null")
    return stacked.select("column_name", "non_null", F.col("__rows").alias("total_rows"))


def cardinalities(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Distinct count per column and the embedding size min(50, (c+1)//2)."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    wide = df.agg(*[fn(F.col(c)).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "cardinality")
    return long.withColumn("embedding_dim",
                           F.least(F.lit(50), F.floor((F.col("cardinality") + 1) / 2)).cast("long"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives, positives and their ratio (imbalance weight)."""
    neg = F.sum((F.col(label) == 0).cast("long"))
    pos = F.sum((F.col(label) == 1).cast("long"))
    return df.agg(neg.alias("negatives"), pos.alias("positives"),
                  (neg / F.nullif(pos, F.lit(0))).alias("pos_weight"))
