"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. Texts can be long, so the bytes bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 8192, 1 << 20
#: Bits of the filter of `parted`.
FILTER_BITS = 1 << 24


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package, bounds Arrow batches and sees to a checkpoint folder.

    The folder is the one that spark.checkpoint.dir names; one is made only where none is set and Spark runs in one process, as in tests.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the checkpoint folder and read again, so that lost executors cost no more than one stage."""
    prepare(frame.sparkSession)
    path = f"{frame.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def map_batches(frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""
    prepare(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is not None:
                yield out

    return frame.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(total: float, most: float) -> int:
    return max(1, math.ceil(total / most))


def joined_hot(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined with a table of one row a key, which has the key's number of rows in the column `count`.

    Keys with more than a thousandth of all rows are fewer than 1,000: these are broadcast and their rows stay where they are.
    The other rows are joined by shuffle, where no key is large.
    """
    rest = [c for c in table.columns if c not in keys]
    large = F.col(count) * 1000 > total
    hot = table.where(large).select(*keys, F.struct(*rest).alias("__hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    near = marked.where(F.col("__hot").isNotNull()).select(*rows.columns, *[F.col(f"__hot.{c}").alias(c) for c in rest])
    far = marked.where(F.col("__hot").isNull()).select(*rows.columns).join(table.where(~large).hint("merge"), keys)
    return near.unionByName(far.select(*near.columns))


def parted(frame: DataFrame, table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of frame whose keys may be in the table (all that are, and few others), and the rest.

    The rest needs no join with the table, so its texts are not shuffled. A broadcast table of at most FILTER_BITS / 64 rows says
    which; as it fills up, more rows go to the first part.
    """
    bit = f"pmod(xxhash64({', '.join(keys)}), {FILTER_BITS})"
    words = table.select(F.expr(f"shiftright({bit}, 6)").alias("__tm_word"), F.expr(f"shiftleft(1L, cast({bit} % 64 as int))").alias("b")).groupBy("__tm_word").agg(F.bit_or("b").alias("__tm_bits"))
    marked = frame.withColumn("__tm_word", F.expr(f"shiftright({bit}, 6)")).join(F.broadcast(words), "__tm_word", "left")
    marked = marked.withColumn("__tm_may", F.expr(f"coalesce(shiftrightunsigned(__tm_bits, cast({bit} % 64 as int)) & 1, 0) = 1"))
    return marked.where("__tm_may").select(*frame.columns), marked.where("not __tm_may").select(*frame.columns)
