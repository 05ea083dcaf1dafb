"""Categorical encoders: label, one-hot, categorical mapping, none.

Fitting gives every category of every column its dense code in one
distributed pass: distinct values are range-partitioned and written in order, and
a value's code is its place in its partition plus the partition's offset. The (value,
code) table stays on the cluster, and applying a label encoder joins it, so
a vocabulary may have any size. Only a one-hot encoder brings its categories
to the driver: each of them is a column of the result."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import checkpoint_dir

UNKNOWN = "Unknown"

APPLICATION_CATEGORICALS = ["name_income_type", "name_education_type",
                            "name_family_status", "name_housing_type",
                            "occupation_type"]


@dataclass
class Encoder:
    column: str
    kind: str                      # label | onehot | categorical | none
    table: DataFrame | None = None  # (value, code)

    def mapping(self, spark) -> DataFrame:
        """``enc_mapping``: (value, code) rows, code = position in value order."""
        return spark.createDataFrame([], "value string, code int") if self.table is None else self.table.select("value", "code")

    @property
    def categories(self) -> list[str]:
        """All values in code order, on the driver: for one-hot columns and small vocabularies."""
        return [] if self.table is None else [r["value"] for r in self.table.orderBy("code").collect()]


def as_category(c: str | Column, unknown: str = UNKNOWN) -> Column:
    """String category; NULL becomes ``unknown``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(unknown))


def code_table(df: DataFrame, cols: list[str], unknown: str = UNKNOWN, keep_unknown: bool = True) -> DataFrame:
    """(column, value, code): dense codes 0, 1, ... of each column's distinct
    values in order, whatever their number."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_category(c, unknown).alias("value")) for c in cols]))
    values = df.select(pairs.alias("p")).select("p.column", "p.value").distinct()
    if not keep_unknown:
        values = values.filter(F.col("value") != unknown)
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"
    (values.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
     .withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{folder}/sorted"))
    placed = spark.read.parquet(f"{folder}/sorted").withColumn("part", F.shiftright("at", 33)).withColumn("seq", F.col("at").bitwiseAND((1 << 33) - 1))
    # one row per (column, partition)
    first = placed.groupBy("column", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = first.select("column", "part", (before - F.col("first")).alias("offset"))
    (placed.join(offsets, ["column", "part"]).select("column", "value", (F.col("seq") + F.col("offset")).cast("int").alias("code"))
     .write.parquet(f"{folder}/codes"))
    return spark.read.parquet(f"{folder}/codes")


def fit(df: DataFrame, col: str, kind: str = "label", unknown: str = UNKNOWN) -> Encoder:
    return fit_many(df, [col], kind, unknown)[col]


def with_label_code(df: DataFrame, enc: Encoder, on_unseen: str = "error", unknown: str = UNKNOWN, out: str | None = None) -> DataFrame:
    """Adds the code of each value: ``unknown``/NULL -> -1; a value unseen at fit
    time raises (``on_unseen='error'``), or becomes NULL / -1."""
    v = as_category(enc.column, unknown)
    if on_unseen == "error":
        missing = F.raise_error(F.concat(F.lit(f"unseen label in {enc.column}: "), v)).cast("int")
    elif on_unseen == "null":
        missing = F.lit(None).cast("int")
    elif on_unseen == "unknown":
        missing = F.lit(-1)
    else:
        raise ValueError(f"on_unseen must be error|null|unknown, got {on_unseen!r}")
    codes = enc.mapping(df.sparkSession).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    code = F.when(v == unknown, F.lit(-1)).when(F.col("_code").isNotNull(), F.col("_code")).otherwise(missing)
    return df.join(codes, v == F.col("_value"), "left").withColumn(out or f"{enc.column}_encoded", code.cast("int")).drop("_value", "_code")


def onehot_columns(enc: Encoder) -> dict[str, Column]:
    """``{col}_{category}`` -> 1.0/0.0; an unseen value is all zeros."""
    v = as_category(enc.column)
    return {f"{enc.column}_{cat}": (v == F.lit(cat)).cast("double") for cat in enc.categories}


def apply(df: DataFrame, enc: Encoder, on_unseen: str = "error") -> DataFrame:
    if enc.kind == "label":
        return with_label_code(df, enc, on_unseen)
    if enc.kind == "onehot":
        return df.withColumns(onehot_columns(enc))
    if enc.kind in ("categorical", "none"):
        return df.withColumn(enc.column, as_category(enc.column))
    raise ValueError(enc.kind)


def fit_many(df: DataFrame, cols: list[str], kind: str = "label", unknown: str = UNKNOWN) -> dict[str, Encoder]:
    """Fit several encoders in one pass over ``df``."""
    if kind == "none":
        return {c: Encoder(c, kind) for c in cols}
    if kind not in ("label", "onehot", "categorical"):
        raise ValueError(f"unknown encoding {kind!r}")
    table = code_table(df, cols, unknown, keep_unknown=kind != "label")
    return {c: Encoder(c, kind, table.filter(F.col("column") == c).select("value", "code")) for c in cols}


def encode_application(df: DataFrame, kind: str = "label",
                       encoders: dict[str, Encoder] | None = None,
                       columns: list[str] = APPLICATION_CATEGORICALS,
                       on_unseen: str = "error") -> tuple[DataFrame, dict[str, Encoder]]:
    """All categorical columns; encoders fitted on ``df``
    unless given (pass the training encoders to encode a test frame). Raw
    categories are dropped for 'label' and 'onehot'."""
    encoders = dict(encoders or {})
    missing = [c for c in columns if c not in encoders]
    if missing:
        encoders.update(fit_many(df, missing, kind))
    out = df
    for c in columns:
        enc = encoders[c]
        if kind == "label":
            out = with_label_code(out, enc, on_unseen)
        elif kind == "onehot":
            out = out.withColumns(onehot_columns(enc))
        else:
            out = out.withColumn(c, as_category(c))
    if kind in ("label", "onehot"):
        out = out.drop(*columns)
    return out, encoders
