"""A live stack whose work follows its new frames: placed once on arrival, folded into per-tile states that Spark keeps.

Two queries run one after the other. The first takes each micro-batch's frames: they are calibrated and measured, a frame under
`LEAST_SNR` is refused, the first accepted frame of a session becomes its reference for good, and the batch's frames alone are
registered on it; a shift beyond `MOST_SHIFT` of a side is refused. Warped frames are cut into blocks of tiles. Everything is
written under the batch's number, so a batch that is run again replaces what it wrote, and the second query does not read before
the first has ended. The second keeps, per session and tile, the state of a clip in arrival order (the first `burn_in` samples of
each pixel, then number, mean and squared deviations) in Spark's state store, and touches the tiles of new frames only; it
writes each touched tile's values, and the newest of a tile are the stack.

Both go on after a restart from their checkpoints. A session's frames are registered by as many tasks as there are; a tile's
new blocks meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.operators import image_ops as I
from skyfold.operators import tiles as T
from skyfold.operators.combine import MAD_SCALE
from skyfold.plans import run as R
from skyfold.streaming.session import Masters

FRAME = "session long, frame_id long, seq long, channel int, height int, width int, exposure double, data array<double>"
#: Limits of a frame (fixed values): its signal-to-noise ratio, and its shift as a share of the frame's side.
LEAST_SNR, MOST_SHIFT = 0.3, 0.3

BLOCKS = f"session long, channel int, seq long, frame_id long, {T.KINDS}, batch long"
_KEYS = ["session", "channel", "y0", "x0"]
_STATE = "th int, tw int, frames long, seen binary, first binary, n binary, mean binary, m2 binary"
TILES = "session long, channel int, y0 int, x0 int, th int, tw int, frames long, value array<double>, n_used array<bigint>"


class Clip:
    """The clip's state of many pixels at once; samples come frame by frame, missing ones are NaN."""

    def __init__(self, pixels: int, burn_in: int):
        self.seen, self.n = np.zeros(pixels, np.int32), np.zeros(pixels, np.int32)
        self.mean, self.m2 = np.zeros(pixels), np.zeros(pixels)
        self.first = np.full((burn_in, pixels), np.nan)

    @staticmethod
    def of(parts: list[bytes], burn_in: int) -> Clip:
        seen, first, n, mean, m2 = parts
        out = Clip(len(seen) // 4, burn_in)
        out.seen, out.n = np.frombuffer(seen, np.int32).copy(), np.frombuffer(n, np.int32).copy()
        out.mean, out.m2 = np.frombuffer(mean).copy(), np.frombuffer(m2).copy()
        if first:
            out.first = np.frombuffer(first).reshape(burn_in, -1).copy()
        return out

    def parts(self) -> list[bytes]:
        """Bytes of the state; the first samples are dropped once no pixel needs them."""
        done = (self.seen >= len(self.first)).all()
        return [self.seen.tobytes(), b"" if done else self.first.tobytes(), self.n.tobytes(), self.mean.tobytes(), self.m2.tobytes()]

    def seeded(self, at: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, mean and squared deviations of what one median rejection leaves of the first samples of pixels."""
        v = self.first[:, at]
        c = np.nanmedian(v, axis=0)
        spread = np.maximum(MAD_SCALE * np.nanmedian(np.abs(v - c), axis=0), 1e-6)
        kept = np.abs(v - c) <= sigma * spread
        n = kept.sum(0)
        mean = np.where(kept, v, 0).sum(0) / np.maximum(n, 1)
        return n, mean, (np.where(kept, v - mean, 0) ** 2).sum(0)

    def add(self, x: np.ndarray, sigma: float) -> None:
        burn_in, valid = len(self.first), ~np.isnan(x)
        early = np.flatnonzero(valid & (self.seen < burn_in))
        late = np.flatnonzero(valid & (self.seen >= burn_in))
        self.first[self.seen[early], early] = x[early]
        self.seen[valid] += 1
        full = early[self.seen[early] == burn_in]
        if len(full):
            self.n[full], self.mean[full], self.m2[full] = self.seeded(full, sigma)
        n, mean, v = self.n[late], self.mean[late], x[late]
        fresh = n == 0
        taken = fresh | (np.abs(v - mean) <= sigma * np.sqrt(np.maximum(self.m2[late] / np.maximum(n, 1), 1e-12)))
        late, n, mean, v = late[taken], n[taken], mean[taken], v[taken]
        d = v - mean
        self.n[late] = n + 1
        self.mean[late] = np.where(n == 0, v, mean + d / (n + 1))
        self.m2[late] = np.where(n == 0, 0, self.m2[late] + d * (v - self.mean[late]))

    def values(self, sigma: float) -> tuple[np.ndarray, np.ndarray]:
        """Mean and number as they count if no more samples come."""
        n, mean = self.n.copy(), self.mean.copy()
        part = np.flatnonzero((self.seen > 0) & (self.seen < len(self.first)))
        if len(part):
            n[part], mean[part], _ = self.seeded(part, sigma)
        return mean, n


def fold_tiles(blocks: DataFrame, sigma: float, burn_in: int) -> DataFrame:
    """Streaming blocks folded into the states of their tiles; each trigger gives the values of the tiles that it touched."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["seq", "frame_id"])  # a tile's new blocks
        if state.exists:
            th, tw, frames, *parts = state.get
            clip = Clip.of([bytes(p) for p in parts], burn_in)
        else:
            th, tw, frames = int(rows["th"].iloc[0]), int(rows["tw"].iloc[0]), 0
            clip = Clip(th * tw, burn_in)
        for block in rows["block"]:
            clip.add(np.frombuffer(block, "<f8"), sigma)
        state.update((int(th), int(tw), int(frames) + len(rows), *clip.parts()))
        mean, n = clip.values(sigma)
        yield pd.DataFrame([(*key, int(th), int(tw), int(frames) + len(rows), mean.tolist(), n.tolist())], columns=[*_KEYS, "th", "tw", "frames", "value", "n_used"])

    return blocks.groupBy(*_KEYS).applyInPandasWithState(fold, TILES, _STATE, "update", "NoTimeout")


def place_batch(spark: SparkSession, rows: DataFrame, n: int, masters: Masters, plan: R.StackPlan, folder: str, size: int, register: bool) -> None:
    """Stores a batch's references, placements and blocks; frames of other batches are not read."""
    planes = rows.select("session", "frame_id", "channel", "height", "width", "data")
    clean = I.chain(R._calibrated(planes, masters.dark, masters.flat), ["session", "frame_id", "channel"], plan.clean)
    clean = clean if plan.debayer == "none" else I.debayer(clean, ["session", "frame_id"], plan.debayer)
    clean = clean if masters.vignette is None else R.less_vignette(clean, masters.vignette)
    clean.write.mode("overwrite").parquet(f"{folder}/planes")  # this batch's only
    clean = spark.read.parquet(f"{folder}/planes")
    about = rows.groupBy("session", "frame_id").agg(F.min("seq").alias("seq"), F.max("exposure").alias("exposure"))
    blocks = f"{folder}/blocks/batch={n}"
    if not register:
        T.cut(clean.join(about, ["session", "frame_id"]), ["session", "channel", "seq", "frame_id"], size).write.mode("overwrite").parquet(blocks)
        return
    lead = R._lead(clean)
    found = I.flat_map_frames(lead, ["session", "frame_id"], R.METRICS, lambda a: R._measure(a, plan.star_sigma)).join(about, ["session", "frame_id"])
    found.withColumn("clear", F.col("snr") >= LEAST_SNR).write.mode("overwrite").parquet(f"{folder}/measured/batch={n}")
    found = spark.read.parquet(f"{folder}/measured/batch={n}")

    references = f"{folder}/references"
    schema = "session long, height int, width int, r_data array<double>, batch long"
    known = spark.createDataFrame([], schema) if n == 0 else spark.read.schema(schema).parquet(references).filter(F.col("batch") < n)
    first = found.filter("clear").join(known.select("session"), "session", "left_anti").groupBy("session").agg(F.min_by("frame_id", F.struct("seq", "frame_id")).alias("frame_id"))
    lead.join(first, ["session", "frame_id"]).select("session", "height", "width", F.col("data").alias("r_data")).write.mode("overwrite").parquet(f"{references}/batch={n}")
    of = spark.read.schema(schema).parquet(references).filter(F.col("batch") <= n).select("session", "height", "width", "r_data")

    ready = lead.join(found.filter("clear").select("session", "frame_id"), ["session", "frame_id"]).join(of.select("session", "height", "width"), ["session", "height", "width"], "left_semi")
    placed = I.register_to_reference(ready, of.select("session", "r_data"), ["session"], "frame_id", plan.star_sigma, 16 if plan.elastic else 0)
    near = (F.abs("dy") <= MOST_SHIFT * F.col("height")) & (F.abs("dx") <= MOST_SHIFT * F.col("width"))
    sizes = of.select("session", "height", "width")
    whole = found.join(placed, ["session", "frame_id"], "left").join(sizes, "session", "left").withColumn("accepted", F.coalesce(F.col("clear") & F.col("dy").isNotNull() & near, F.lit(False)))
    whole.drop("height", "width").write.mode("overwrite").parquet(f"{folder}/placements/batch={n}")
    shifts = spark.read.parquet(f"{folder}/placements/batch={n}").filter("accepted")
    moved = clean.join(shifts.select("session", "frame_id", "seq", "dy", "dx", "angle", *(["field"] if plan.elastic else [])), ["session", "frame_id"])
    I.warp_tiles(moved, ["session", "channel", "seq", "frame_id"], size).write.mode("overwrite").parquet(blocks)


def advance(spark: SparkSession, stream: DataFrame, masters: Masters, plan: R.StackPlan, folder: str, burn_in: int = 10, size: int = 64, register: bool = True) -> DataFrame:
    """Takes what has arrived of a stream of `FRAME` rows and gives the stack so far as tiles (`TILES`).

    The state store is RocksDB, so that states of many tiles need not stay in memory.
    """
    placing = stream.writeStream.foreachBatch(lambda rows, n: place_batch(spark, rows, n, masters, plan, folder, size, register))
    placing.option("checkpointLocation", f"{folder}/placing").trigger(availableNow=True).start().awaitTermination()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/blocks")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], TILES)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folded = fold_tiles(spark.readStream.schema(BLOCKS).parquet(f"{folder}/blocks"), plan.sigma, burn_in)
        folding = folded.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/tiles/batch={n}"))
        folding.option("checkpointLocation", f"{folder}/folding").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return current(spark, folder)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest values of every tile."""
    every = spark.read.schema(f"{TILES}, batch long").parquet(f"{folder}/tiles")
    names = ["th", "tw", "frames", "value", "n_used"]
    return every.groupBy(*_KEYS).agg(F.max_by(F.struct(*names), "batch").alias("s")).select(*_KEYS, *(f"s.{n}" for n in names))


def to_pixels(tiles: DataFrame) -> DataFrame:
    """(session, channel, y, x, value, n_used) of the pixels that a frame has reached."""
    p = tiles.select("session", "channel", "y0", "x0", "tw", F.posexplode(F.arrays_zip("value", "n_used")).alias("p", "s")).filter("s.n_used > 0")
    return p.select("session", "channel", (F.col("y0") + F.floor(F.col("p") / F.col("tw"))).cast("int").alias("y"), (F.col("x0") + F.col("p") % F.col("tw")).cast("int").alias("x"), "s.value", "s.n_used")
