"""Shared storage and sizing helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 4_000, 16 << 20
#: Bits of a bitmap for each of its keys, and bits at least and at most.
KEY_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 12, 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-skyfold-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there and every later pass sees the same rows.

    `options` are the Parquet writer's, with underscores for dots.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skyfold-{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **{k.replace("_", "."): v for k, v in options.items()}).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes tables that `materialize` gave, once nothing reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_bitmap(keys: DataFrame) -> DataFrame:
    """One row `_bits`: a bitmap of the hashes of the only column's values, of a bounded size (8 MB) whatever their number."""
    size = min(max(LEAST_BITS, KEY_BITS * keys.count()), MOST_BITS) // 64
    at = F.pmod(F.xxhash64(keys.columns[0]), F.lit(64 * size))
    found = keys.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(size, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.createDataFrame(pa.table({"_bits": pa.array([bits], pa.list_(pa.int64()))}))


def by_bitmap(df: DataFrame, column: str, bitmap: DataFrame, among: bool = True) -> DataFrame:
    """The rows whose key may be in the bitmap, or the others, whose key surely isn't; no row is shuffled.

    A join that takes the rows which may have a partner alone shuffles these alone. The column has the keys' type.
    """
    bits = free_name(df, "_bits")
    at = F.pmod(F.xxhash64(df[column]), F.lit(64).cast("long") * F.size(bits))
    hit = F.getbit(F.get(bits, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
    return df.join(F.broadcast(bitmap.toDF(bits)), hit, "left_semi" if among else "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores put before it until no column has it."""
    while name in df.columns:
        name = f"_{name}"
    return name


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches hold whole texts here, so they are bounded by bytes as well as rows, where the session allows more."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(name))  # another unit is somebody's choice
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map function that gives its freed memory back when its partition ends: Python workers live on between stages."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner
