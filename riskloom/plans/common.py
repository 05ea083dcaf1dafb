"""Shared pieces for the query registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.sources import fixtures as FX
from riskloom.sources.fixtures import with_fixtures  # noqa: F401  (re-export)

DIGITS = 6


def r6(df: DataFrame) -> DataFrame:
    """Round double columns for engine-independent comparison (last-bit
    differences of exp/log between engines)."""
    return df.select(*[F.round(F.col(f.name), DIGITS).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


_MEMO: dict = {}


def memo(spark, key, build):
    """Per-session memo of persisted derived inputs (fixture views, feature
    sets), so queries that share an input compute it once."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def fx(spark, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the given tables. It is lazy, so every query scans
    only its own columns, with its filters pushed to the parquet files."""
    return FX.load(spark, sf_dir, name)


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn):
            if name in self.queries:
                raise KeyError(f"duplicate query {name}")
            self.queries[name] = fn
            if sql is not None:
                self.oracle[name] = sql
            return fn
        return deco
