"""Target inference, settings from presets, background samples, radial profiles and sequential tracking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions import scalars as S


def candidates(names: DataFrame, keys: Sequence[str], text: str, source: str, weight: float, lookup: Sequence[tuple[str, str]], digits: int | None = 4) -> DataFrame:
    """(keys..., source, target, confidence): catalogue identifiers in a text (0.95, numbers of at most `digits` digits, None for
    any), names of the lookup that equal it (0.9) or that it holds or is held by (0.75, five letters at least). The lookup
    (name, target) is a fixed small table."""
    t = F.lower(F.col(text))
    ids = names.select(*keys, F.explode(S.catalog_ids(F.col(text), digits)).alias("_id")).select(*keys, S.normalize_id(F.col("_id")).alias("target"), F.lit(0.95).alias("confidence"))
    known = F.array(*[F.struct(F.lit(n.lower()).alias("name"), F.lit(target).alias("target")) for n, target in lookup if len(n) >= 5])
    key = F.col("_k.name")
    named = names.withColumn("_k", F.explode(known)).filter((t.contains(key) | key.contains(t)) & (F.length(t) > 0))
    named = named.select(*keys, F.col("_k.target").alias("target"), F.when(t == key, 0.9).otherwise(0.75).alias("confidence"))
    return ids.unionByName(named).select(*keys, F.lit(source).alias("source"), "target", (F.col("confidence") * weight).alias("confidence"))


def best_candidate(found: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """Highest confidence, then the source's priority, then the name."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), order, "target"))
    return found.withColumn("_r", rank).filter("_r = 1").drop("_r")


def blended_settings(weights: DataFrame, presets: DataFrame, keys: Sequence[str], numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Settings of each row from preset weights: weighted means of the numbers a preset defines, texts of the heaviest one."""
    j = weights.join(F.broadcast(presets), "preset")
    mean = [(F.sum(F.when(F.col(n).isNotNull(), F.col("weight") * F.col(n))) / F.sum(F.when(F.col(n).isNotNull(), F.col("weight")))).alias(n) for n in numbers]
    top = [F.max_by(F.col(t), F.when(F.col(t).isNotNull(), F.col("weight"))).alias(t) for t in texts]
    return j.groupBy(*keys).agg(*mean, *top)


def quality_rules(n: Column, snr: Column, fwhm: Column) -> dict[str, Column]:
    """Method choices that follow from a run's size and quality."""
    return {
        "combine": F.when(n < 3, "mean").when(n < 8, "percentile").when(n < 15, "winsorized").when(n < 20, "sigma_clip").otherwise("esd"),
        "denoise": F.when(snr < 2, "strong").when(snr < 5, "medium").otherwise("light"),
        "deconvolve": (fwhm > 3) & (snr > 5),
        "drizzle": (n >= 30) & (fwhm < 2.5),
    }


def background_samples(px: DataFrame, keys: Sequence[str], patch: int, sigma: float = 2.5) -> DataFrame:
    """Clipped median, spread and share of each patch: what a background surface is fitted to."""
    cell = px.select(*keys, F.floor(F.col("y") / patch).cast("int").alias("py"), F.floor(F.col("x") / patch).cast("int").alias("px"), "v")
    w = Window.partitionBy(*keys, "py", "px")
    s = cell.withColumn("_m", F.median("v").over(w)).withColumn("_s", F.greatest(1.4826 * F.median(F.abs(F.col("v") - F.col("_m"))).over(w), F.lit(1e-6)))
    keep = F.abs(F.col("v") - F.col("_m")) <= sigma * F.col("_s")
    return s.groupBy(*keys, "py", "px").agg(F.median(F.when(keep, F.col("v"))).alias("level"), F.avg(keep.cast("double")).alias("share"), F.stddev_pop(F.when(keep, F.col("v"))).alias("spread"))


def radial_profile(px: DataFrame, keys: Sequence[str], cy: float, cx: float, width: float = 1.0) -> DataFrame:
    """Median of each ring around a centre, and what every pixel has over it."""
    r = F.floor(F.sqrt((F.col("y") - cy) ** 2 + (F.col("x") - cx) ** 2) / width).cast("int")
    s = px.withColumn("ring", r)
    return s.withColumn("excess", F.col("v") - F.median("v").over(Window.partitionBy(*keys, "ring")))


def affine_residual(matches: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least-squares plane value ~ 1 + y + x per group from sums, with its residual: groups of three points or more."""
    w = Window.partitionBy(*keys)
    m = matches.withColumns({"_y": F.col("y") - F.avg("y").over(w), "_x": F.col("x") - F.avg("x").over(w), "_v": F.col(value) - F.avg(value).over(w)})
    a = m.groupBy(*keys).agg(*[F.sum(F.col(p) * F.col(q)).alias(n) for n, p, q in (("yy", "_y", "_y"), ("xx", "_x", "_x"), ("yx", "_y", "_x"), ("yv", "_y", "_v"), ("xv", "_x", "_v"), ("vv", "_v", "_v"))], F.count(F.lit(1)).alias("n"))
    det = F.col("yy") * F.col("xx") - F.col("yx") ** 2
    ky, kx = (F.col("yv") * F.col("xx") - F.col("xv") * F.col("yx")) / det, (F.col("xv") * F.col("yy") - F.col("yv") * F.col("yx")) / det
    ok = (F.col("n") >= 3) & (F.abs(det) > 1e-9)
    left = F.greatest(F.col("vv") - ky * F.col("yv") - kx * F.col("xv"), F.lit(0.0))
    return a.select(*keys, "n", F.when(ok, ky).alias("by_y"), F.when(ok, kx).alias("by_x"), F.when(ok, F.sqrt(left / F.col("n"))).alias("rms"))


def track(frames: DataFrame, group: str, frame: str, radius: float) -> DataFrame:
    """Follows the brightest spot of a group's frames in order, within the radius of where it was before.

    A position depends on the last one, so a group's frames stream through one task in order; sessions run side by side.
    """
    ordered = frames.select(group, frame, "height", "width", "data").repartition(group).sortWithinPartitions(group, frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            out = []
            for g, h, w, data in zip(batch.column(group).to_pylist(), batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("data"), strict=True):
                if held != (g,):
                    held, last = (g,), None
                a = data.values.to_numpy(zero_copy_only=False).reshape(h, w)
                y, x = np.indices(a.shape)
                near = np.ones(a.shape, bool) if last is None else np.hypot(y - last[0], x - last[1]) <= radius
                last = np.unravel_index(np.where(near, a, -np.inf).argmax(), a.shape)
                out.append((int(last[0]), int(last[1])))
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column(frame).cast(pa.int64()), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32())], names=[group, frame, "y", "x"])

    return ordered.mapInArrow(run, f"{group} {frames.schema[group].dataType.simpleString()}, {frame} long, y int, x int")
