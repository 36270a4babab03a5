"""Earlier linear stacks on a new one: placement by stars, guards on overlap and likeness, means weighted by frame counts.

A stack is rows (keys..., stack, channel, height, width, data). Earlier stacks may have other sizes and be turned; they are laid
on the current stack's grid, where a sample outside their footprint weighs nothing. Stacks are placed and measured side by side,
one task a stack, against the current lead plane; the sums run by tiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions import detect
from skyfold.functions import kernels as K
from skyfold.functions import registration as R
from skyfold.operators import tiles as T
from skyfold.operators.image_ops import _array, _kinds

#: Share of the current stack that an earlier one must cover, and how alike they must be there (fixed values).
LEAST_OVERLAP, LEAST_CORRELATION = 0.25, 0.15

PLACED = {"dy": "double", "dx": "double", "angle": "double", "method": "string", "overlap": "double", "correlation": "double"}


def embedded(a: np.ndarray, shape: tuple[int, int], fill: float) -> np.ndarray:
    """The frame at the top left of a canvas, cut where it is larger."""
    out = np.full(shape, fill)
    h, w = min(a.shape[0], shape[0]), min(a.shape[1], shape[1])
    out[:h, :w] = a[:h, :w]
    return out


def laid(a: np.ndarray, shape: tuple[int, int], dy: float, dx: float, angle: float) -> np.ndarray:
    """The frame on a canvas under a placement; not a number outside its footprint. Less than a twentieth pixel is no move."""
    if max(abs(dy), abs(dx), abs(angle) * np.hypot(*shape)) < 0.05:
        return embedded(a, shape, np.nan)
    moved, cover = K.lanczos_warp(a, R.matrix(shape, dy, dx, angle), shape)
    return np.where(cover, moved, np.nan)


def likeness(current: np.ndarray, other: np.ndarray, step: int = 4, least: int = 100) -> tuple[float, float | None]:
    """Share of the current frame that the other covers, and their correlation over every `step`-th line and column; null where
    fewer than `least` samples speak."""
    there = np.isfinite(other)
    few = there[::step, ::step]
    if few.sum() <= least:
        return float(there.mean()), None
    a, b = current[::step, ::step][few], other[::step, ::step][few]
    spread = a.std() * b.std()
    return float(there.mean()), float(((a - a.mean()) * (b - b.mean())).mean() / spread) if spread > 1e-18 else 0.0


def place(earlier: DataFrame, current: DataFrame, keys: Sequence[str], sigma: float = 5.0) -> DataFrame:
    """(keys..., stack, PLACED..., allowed): each earlier lead plane on its current one (keys..., height, width, data), one a key.

    A correlation that too few samples give does not forbid.
    """
    joined = earlier.select(*keys, "stack", "height", "width", "data").join(current.select(*keys, F.col("height").alias("c_height"), F.col("width").alias("c_width"), F.col("data").alias("c_data")), list(keys))
    named = [*keys, "stack"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            size = ("height", "width", "c_height", "c_width")
            for d, c, h, w, ch, cw in zip(batch.column("data"), batch.column("c_data"), *(batch.column(n).to_pylist() for n in size), strict=True):
                reference, a = _array(c, ch, cw), _array(d, h, w)
                canvas = embedded(a, (ch, cw), float(np.median(a)))
                fit = R.register(reference, detect.detect(reference, k=sigma), canvas, detect.detect(canvas, k=sigma))
                found.append((fit.dy, fit.dx, fit.angle, fit.method, *likeness(reference, laid(a, (ch, cw), fit.dy, fit.dx, fit.angle))))
            types = {"double": pa.float64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in named), *(pa.array([f[i] for f in found], types[t]) for i, t in enumerate(PLACED.values()))], names=[*named, *PLACED])

    placed = joined.mapInArrow(run, f"{_kinds(earlier, named)}, " + ", ".join(f"{n} {t}" for n, t in PLACED.items()))
    return placed.withColumn("allowed", (F.col("overlap") >= LEAST_OVERLAP) & (F.coalesce("correlation", F.lit(1.0)) >= LEAST_CORRELATION))


def merge(current: DataFrame, earlier: DataFrame, placements: DataFrame, keys: Sequence[str], size: int | None = None) -> DataFrame:
    """Combined tiles (keys..., channel, y0, x0, th, tw, value, n_used, n_rejected) of stacks with their `frames`.

    `placements` (keys..., stack, dy, dx, angle) says which earlier stacks go in and where. Fewer than one frame counts as one.
    n_used counts stacks.
    """
    keys = list(keys)
    named = [*keys, "channel", "stack", "weight"]
    weigh = lambda df: df.withColumn("weight", F.greatest(F.coalesce(F.col("frames"), F.lit(1)), F.lit(1)).cast("double"))
    shapes = current.select(*keys, "channel", F.col("height").alias("c_height"), F.col("width").alias("c_width"))
    others = weigh(earlier).join(placements.select(*keys, "stack", "dy", "dx", "angle"), [*keys, "stack"]).join(shapes, [*keys, "channel"])
    if size is None:
        most = others.groupBy(*keys, "channel").count().agg(F.max("count")).first()[0] or 0
        size = T.side(most + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("height", "width", "c_height", "c_width", "dy", "dx", "angle"))
            for i, (d, h, w, ch, cw, dy, dx, angle) in enumerate(zip(batch.column("data"), *columns, strict=True)):
                parts = T.cut_array(laid(_array(d, h, w), (ch, cw), dy, dx, angle), size)
                at = pa.array([i] * len(parts))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in named), *T.blocks(parts)], names=[*named, *T.NAMES])

    moved = others.select(*named, "height", "width", "c_height", "c_width", "dy", "dx", "angle", "data").mapInArrow(run, f"{_kinds(others, named)}, {T.KINDS}")
    return T.combine_tiles(T.cut(weigh(current), named, size).unionByName(moved), [*keys, "channel"], "mean", "stack", "weight")
