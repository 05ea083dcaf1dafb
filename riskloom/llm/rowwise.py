"""Columns computed from the text of each row, whatever the other columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import ship_package


SLICE = 1024


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds the texts of few rows as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def add_from_text(docs: DataFrame, kept: list[str], fields: list[T.StructField], make: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """Columns ``kept`` of ``docs`` and the computed ``fields``.

    ``make()`` is called once per task and gives a function from texts to one
    Arrow array per field. Columns travel under positional names, so names that
    clash with the fields or hold dots do no harm; the text is sent back only if kept."""
    ship_package(docs.sparkSession)
    source = {f.name: f for f in docs.schema.fields}
    sent = [*kept, *(["text"] if "text" not in kept else [])]
    at, n = sent.index("text"), len(kept)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)])
    schema = T.StructType([*(T.StructField(f"c{i}", source[c].dataType) for i, c in enumerate(kept)),
                           *(T.StructField(f"x{i}", f.dataType) for i, f in enumerate(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in slices(batches):
            out = compute(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *out], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*kept, *(f.name for f in fields))
