"""Live stacking with Structured Streaming.

Frames arrive as files; each micro-batch is scored, gated and added to per-pixel sums (weight, weighted value, frames). The
state is a versioned Parquet table in the shared folder: batch n merges version n - 1 with its own partial sums and writes
version n, so a batch that is run again after a failure writes the same table anew; versions that no batch can need again are
removed. A run that finds nothing new gives the last version. The online clip keeps its state per pixel in the same way and
folds a batch's samples in arrival order, as `combine.online_clip` does with all samples at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.operators import combine as C


class StateTable:
    """Versions of a state table, one a micro-batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def version(self, n: int) -> DataFrame:
        if n < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{n}")

    def write(self, n: int, state: DataFrame) -> None:
        state.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        if n > 1:  # batch n may run again and then reads version n - 1
            folder, fs = self._place(f"{self.path}/v{n - 2}")
            fs.delete(folder, True)

    def _place(self, path: str) -> tuple:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The highest version that is whole, -1 without any."""
        folder, fs = self._place(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return max((n for n in found if fs.exists(self._place(f"{self.path}/v{n}/_SUCCESS")[0])), default=-1)


def weighted_sums(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial sums of a batch: (keys..., wsum, acc, n)."""
    return px.groupBy(*keys).agg(F.sum("w").alias("wsum"), F.sum(F.col("w") * F.col("v")).alias("acc"), F.count(F.lit(1)).alias("n"))


def merge_sums(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys).agg(F.sum("wsum").alias("wsum"), F.sum("acc").alias("acc"), F.sum("n").alias("n"))


def current_stack(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    return state.select(*keys, (F.col("acc") / F.greatest("wsum", F.lit(1e-9))).alias("value"), "n")


def run_batches(stream: DataFrame, state: StateTable, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, timeout: float | None = None) -> int:
    """Folds the available micro-batches into the state and returns the last version; with a timeout it keeps waiting for more."""
    def fold(batch: DataFrame, n: int) -> None:
        state.write(n, step(state.version(n - 1), batch))

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    started = (query.trigger(processingTime="4 seconds") if timeout else query.trigger(availableNow=True)).start()
    started.awaitTermination(timeout) if timeout else started.awaitTermination()
    if timeout and started.isActive:
        started.processAllAvailable()
        started.stop()
    return state.last()


def live_stack(spark: SparkSession, stream: DataFrame, to_pixels: Callable[[DataFrame], DataFrame], keys: Sequence[str], kinds: str, folder: str, timeout: float | None = None) -> DataFrame:
    """The stack after all available batches; to_pixels gives (keys..., v, w) of a batch of frames."""
    state = StateTable(spark, f"{folder}/state", f"{kinds}, wsum double, acc double, n long")
    last = run_batches(stream, state, lambda old, batch: merge_sums(old, weighted_sums(to_pixels(batch), keys), keys), f"{folder}/offsets", timeout)
    return current_stack(state.version(last), keys)


_CLIP = "seen long, first array<double>, n long, mean double, m2 double"


def clip_batch(old: DataFrame, px: DataFrame, keys: Sequence[str], order: str, sigma: float, burn_in: int) -> DataFrame:
    """Folds samples (keys..., order, v) in order into the states (keys..., seen, first, n, mean, m2) of their keys."""
    state = F.struct("seen", "first", "n", "mean", "m2")
    kind = px.schema[order].dataType
    rows = px.select(*keys, F.lit(1).alias("_late"), F.col(order).alias("_o"), F.col("v").cast("double").alias("_v"), F.lit(None).cast(old.select(state.alias("s")).schema["s"].dataType).alias("_s"))
    rows = old.select(*keys, F.lit(0).alias("_late"), F.lit(None).cast(kind).alias("_o"), F.lit(None).cast("double").alias("_v"), state.alias("_s")).unionByName(rows.filter("_v IS NOT NULL AND NOT isnan(_v)"))

    def add(held: list, values: np.ndarray, states: np.ndarray) -> list:
        if len(states) and states[0] is not None:  # a key's state comes before its samples
            s = states[0]
            held, values = [int(s["seen"]), [float(x) for x in s["first"]], int(s["n"]), float(s["mean"]), float(s["m2"])], values[1:]
        return C.clip_fold(held, values.tolist(), sigma, burn_in)

    def end(held: list) -> tuple:
        return held[0], [float(x) for x in held[1]], held[2], float(held[3]), float(held[4])

    return C.fold_sorted(rows, keys, ["_late", "_o", "_v"], ["_v", "_s"], lambda: [0, [], 0, 0.0, 0.0], add, end, _CLIP)


def online_clip_stream(spark: SparkSession, stream: DataFrame, to_pixels: Callable[[DataFrame], DataFrame], keys: Sequence[str], kinds: str, order: str, folder: str, sigma: float = 3.0, burn_in: int = 10) -> DataFrame:
    """Online clipped mean (keys..., mean, m2, n) after all available batches."""
    state = StateTable(spark, f"{folder}/state", f"{kinds}, {_CLIP}")
    last = run_batches(stream, state, lambda old, batch: clip_batch(old, to_pixels(batch), keys, order, sigma, burn_in), f"{folder}/offsets")
    whole = state.version(last)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [C.clip_end([r["seen"], r["first"], r["n"], r["mean"], r["m2"]], sigma, burn_in) for r in batch.select(["seen", "first", "n", "mean", "m2"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([float(f[3]) for f in found], pa.float64()), pa.array([float(f[4]) for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64())], names=[*keys, "mean", "m2", "n"])

    return whole.mapInArrow(close, f"{kinds}, mean double, m2 double, n long")


def windowed_integration(stream: DataFrame, time: str, keys: Sequence[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time integration: mean and count per window, with a watermark for late frames."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))
