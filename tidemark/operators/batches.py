"""Python over rows of long texts, in Arrow batches that are bounded by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of a batch that a Python worker gets, and of the part of it whose results are held as Python objects at once.
BATCH_BYTES, PART_BYTES = 1 << 20, 1 << 18


def bound(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session by bytes, which Spark else bounds by rows, unless a lower bound is set."""
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if held is None or not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about PART_BYTES by the lengths of its last column, a string; a longer one is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
    place = np.cumsum(sizes, dtype=np.int64) // PART_BYTES
    starts = [*np.flatnonzero(np.r_[True, place[1:] != place[:-1]]), batch.num_rows] if batch.num_rows else []
    for a, b in zip(starts, starts[1:], strict=False):
        yield batch.slice(a, b - a)


def map_parts(rows: DataFrame, work: Callable[[list[str | None]], tuple[list[int], dict[str, pa.Array]]], schema: T.StructType) -> DataFrame:
    """The columns of rows but the last, a string, for each row that work names (by place, as often as it likes), with the columns that work makes."""
    bound(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                places, made = work(part.column(part.num_columns - 1).to_pylist())
                kept = part.take(pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *made.values()], [*kept.schema.names[:-1], *made])

    return rows.mapInArrow(run, schema)
