"""Stacks of whole frames by tiles: blocks of samples travel as binary, and a tile's stack is combined as vectors.

A row a sample costs a key, a shuffle record and a sort entry for every number; a tile's block costs one. Frames (keys...,
order, height, width, data[, weight]) are cut into square tiles whose side follows from the number of frames, so that one
tile's stack stays within `BUDGET` bytes; one shuffle brings the blocks of a tile together, and the combiners of
`operators.combine` run over it with the samples of a pixel along the fast axis. Results equal those of the row form.

Samples that are missing are NaN. A pixel without samples gives 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.operators.combine import MAD_SCALE, TINY, esd_limit

#: Bytes of one tile's stack, and the largest and smallest side of a tile.
BUDGET, LARGEST, SMALLEST = 48 << 20, 256, 4


def side(frames: int, budget: int = BUDGET) -> int:
    """Side of a tile of which `frames` blocks stay within the budget."""
    return int(min(max((budget / (8 * max(frames, 1))) ** 0.5, SMALLEST), LARGEST))


def cut_array(a: np.ndarray, size: int) -> list[tuple[int, int, np.ndarray]]:
    return [(y, x, a[y : y + size, x : x + size]) for y in range(0, a.shape[0], size) for x in range(0, a.shape[1], size)]


def blocks(parts: list[tuple[int, int, np.ndarray]]) -> list[pa.Array]:
    """Columns y0, x0, th, tw, block of cut parts."""
    return [*(pa.array(v, pa.int32()) for v in ([p[0] for p in parts], [p[1] for p in parts], [p[2].shape[0] for p in parts], [p[2].shape[1] for p in parts])), pa.array([np.ascontiguousarray(p[2], "<f8").tobytes() for p in parts], pa.binary())]


NAMES = ["y0", "x0", "th", "tw", "block"]
KINDS = "y0 int, x0 int, th int, tw int, block binary"


def cut(frames: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Rows (keys..., y0, x0, th, tw, block) of frames (keys..., height, width, data)."""
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            for i, (d, h, w) in enumerate(zip(batch.column("data"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)):
                parts = cut_array(np.asarray(d.values.to_numpy(zero_copy_only=False), float).reshape(h, w), size)
                at = pa.array([i] * len(parts))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *blocks(parts)], names=[*keys, *NAMES])

    return frames.select(*keys, "height", "width", "data").mapInArrow(run, f"{kinds}, {KINDS}")


class Stack:
    """Samples of many pixels, sorted along each pixel's axis (missing ones last), with their weights."""

    def __init__(self, v: np.ndarray, w: np.ndarray | None = None):
        if w is None:
            self.v, self.w = np.sort(v, axis=1), None
        else:
            order = np.argsort(v, axis=1, kind="stable")
            self.v, self.w = np.take_along_axis(v, order, 1), np.take_along_axis(w, order, 1)
        self.n = self.v.shape[1] - np.isnan(self.v).sum(1)
        self.at = np.arange(self.v.shape[1])
        self.rows = np.arange(len(self.v))
        # sums are taken about a sample in the middle, so that they stay exact enough for spreads
        self.base = np.where(self.n > 0, self.v[self.rows, np.maximum(self.n - 1, 0) // 2], 0.0)
        d = np.nan_to_num(self.v - self.base[:, None])
        self.c1, self.c2 = _prefix(d), _prefix(d * d)
        self.cw = self.cwv = None
        if self.w is not None:
            own = np.where(np.isnan(self.v), 0.0, self.w)
            self.cw, self.cwv = _prefix(own), _prefix(own * d)

    def _sum(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return c[self.rows, hi] - c[self.rows, lo]

    def mean(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.base + self._sum(self.c1, lo, hi) / np.maximum(hi - lo, 1)

    def deviation(self, lo: np.ndarray, hi: np.ndarray, ddof: int = 0) -> np.ndarray:
        n = np.maximum(hi - lo, 1)
        s = self._sum(self.c1, lo, hi)
        return np.sqrt(np.maximum(self._sum(self.c2, lo, hi) - s * s / n, 0) / np.maximum(n - ddof, 1))

    def weighted(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Weighted mean of a range; 0 where it is empty or weighs nothing."""
        if self.w is None:
            return np.where(hi > lo, self.mean(lo, hi), 0.0)
        total = self._sum(self.cw, lo, hi)
        mean = self.base + self._sum(self.cwv, lo, hi) / np.where(total == 0, 1.0, total)
        return np.where((hi > lo) & (total != 0), mean, 0.0)

    def median(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        a, b = np.maximum((lo + hi - 1) // 2, 0), np.minimum((lo + hi) // 2, self.v.shape[1] - 1)
        return (self.v[self.rows, a] + self.v[self.rows, b]) / 2

    def inside(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.at >= lo[:, None]) & (self.at < hi[:, None])

    def mad(self, lo: np.ndarray, hi: np.ndarray, centre: np.ndarray) -> np.ndarray:
        """Scaled median distance from a centre within a range."""
        d = np.where(self.inside(lo, hi), np.abs(self.v - centre[:, None]), np.inf)
        d.sort(axis=1)
        n = np.maximum(hi - lo, 1)
        return MAD_SCALE * (d[self.rows, (n - 1) // 2] + d[self.rows, n // 2 - (n // 2 >= d.shape[1])]) / 2

    def narrowed(self, lo: np.ndarray, hi: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of a range where a test holds that holds on an interval; the range itself where it holds nowhere."""
        n = keep.sum(1)
        first = keep.argmax(1)
        return np.where(n > 0, first, lo), np.where(n > 0, first + n, hi)


def _prefix(a: np.ndarray) -> np.ndarray:
    out = np.zeros((a.shape[0], a.shape[1] + 1))
    np.cumsum(a, axis=1, out=out[:, 1:])
    return out


def _clipped(s: Stack, sigma: float, iterations: int, robust: bool) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.zeros(len(s.v), int), s.n.copy()
    for _ in range(iterations):
        middle = s.median(lo, hi)
        mad, deviation = s.mad(lo, hi, middle), s.deviation(lo, hi)
        first, second = (mad, deviation) if robust else (deviation, mad)
        centre = middle if robust else s.mean(lo, hi)
        spread = np.where(first < TINY, second, first)
        lo, hi = s.narrowed(lo, hi, s.inside(lo, hi) & (np.abs(s.v - centre[:, None]) <= (sigma * spread)[:, None]))
    return lo, hi


def _mean(s: Stack):
    return s.weighted(np.zeros_like(s.n), s.n), s.n


def _median(s: Stack):
    return np.where(s.n > 0, s.median(np.zeros_like(s.n), s.n), 0.0), s.n


def _sigma_clip(s: Stack, sigma: float = 3.0, iterations: int = 3, robust: bool = True, winsorize: bool = False):
    lo, hi = _clipped(s, sigma, iterations, robust)
    if not winsorize:
        return s.weighted(lo, hi), hi - lo
    centre = s.median(lo, hi) if robust else s.mean(lo, hi)
    spread = np.maximum(s.mad(lo, hi, centre) if robust else s.deviation(lo, hi), TINY)
    pulled = np.clip(s.v, (centre - sigma * spread)[:, None], (centre + sigma * spread)[:, None])
    valid = ~np.isnan(s.v)
    w = np.where(valid, 1.0 if s.w is None else s.w, 0.0)
    total = w.sum(1)
    return np.where(s.n > 0, (w * np.where(valid, pulled, 0.0)).sum(1) / np.where(total == 0, 1.0, total), 0.0), s.n


def _percentile(s: Stack, low: float = 20.0, high: float = 80.0):
    def at(q: float) -> np.ndarray:
        place = q / 100 * np.maximum(s.n - 1, 0)
        i = np.floor(place).astype(int)
        a, b = s.v[s.rows, i], s.v[s.rows, np.minimum(i + 1, np.maximum(s.n - 1, 0))]
        return a + (place - i) * (b - a)

    keep = s.inside(np.zeros_like(s.n), s.n) & (s.v >= at(low)[:, None]) & (s.v <= at(high)[:, None])
    lo, hi = s.narrowed(np.zeros_like(s.n), s.n, keep)
    return s.weighted(lo, hi), hi - lo


def _linear_fit(s: Stack, sigma_low: float = 4.0, sigma_high: float = 2.0, iterations: int = 5):
    keep = s.inside(np.zeros_like(s.n), s.n)
    v = np.nan_to_num(s.v - s.base[:, None])
    x = s.at.astype(float)
    for _ in range(iterations):
        n = np.maximum(keep.sum(1), 1)
        mx, my = (keep * x).sum(1) / n, (keep * v).sum(1) / n
        dx, dy = x - mx[:, None], v - my[:, None]
        xx = (keep * dx * dx).sum(1)
        slope = np.where(keep.sum(1) >= 2, (keep * dx * dy).sum(1) / np.where(xx <= TINY, 1.0, xx), 0.0)
        r = dy - slope[:, None] * dx
        spread = np.maximum(np.sqrt((keep * r * r).sum(1) / np.maximum(keep.sum(1) - 1, 1)), 1e-6)[:, None]
        out = keep & ((r < -sigma_low * spread) | (r > sigma_high * spread))
        taken = (keep.sum(1) >= 2) & (keep.sum(1) - out.sum(1) >= 2)
        keep = keep & ~(out & taken[:, None])
    w = np.where(keep, 1.0 if s.w is None else s.w, 0.0)
    total = w.sum(1)
    return np.where((s.n > 0) & (total != 0), s.base + (w * v).sum(1) / np.where(total == 0, 1.0, total), 0.0), keep.sum(1)


def _trimmed(s: Stack, low: float = 0.1, high: float = 0.1):
    lo, hi = np.floor(s.n * low).astype(int), np.floor(s.n * high).astype(int)
    none = (lo + hi >= s.n) & (s.n > 0)
    lo, end = np.where(none, 0, lo), np.where(none, 1, s.n - hi)
    return s.weighted(lo, np.maximum(end, lo)), np.maximum(end - lo, 0)


def _esd(s: Stack, most: int | None = None, significance: float = 0.05):
    """The farthest sample of a sorted range is its first or its last, so each step moves an end."""
    lo, hi = np.zeros_like(s.n), s.n.copy()
    steps = np.maximum(1, s.n // 4) if most is None else np.full_like(s.n, most)
    limits = np.array([esd_limit(k, significance) for k in range(s.v.shape[1] + 1)])
    going = s.n > 2
    for i in range(int(steps.max(initial=0))):
        going = going & (i < steps) & (s.n - 2 * i > 2)
        if not going.any():
            break
        mean, spread = s.mean(lo, hi), np.maximum(s.deviation(lo, hi, 1), TINY)
        below = mean - s.v[s.rows, np.minimum(lo, s.v.shape[1] - 1)]
        above = s.v[s.rows, np.maximum(hi - 1, 0)] - mean
        far = np.maximum(below, above) / spread
        going = going & (far > limits[np.clip(s.n - 2 * i, 0, len(limits) - 1)])
        lo, hi = lo + (going & (below >= above)), hi - (going & (below < above))
    return s.weighted(lo, hi), hi - lo


#: Combiners over sorted stacks: (values, numbers of samples used); others are rejected.
VECTOR: dict[str, Callable[..., tuple[np.ndarray, np.ndarray]]] = {
    "mean": _mean,
    "median": _median,
    "sigma_clip": _sigma_clip,
    "winsorized": lambda s, **p: _sigma_clip(s, winsorize=True, **p),
    "percentile": _percentile,
    "linear_fit": _linear_fit,
    "trimmed_mean": _trimmed,
    "esd": _esd,
}


def combine_stack(v: np.ndarray, method: str, w: np.ndarray | None = None, **params: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, used and rejected samples of pixels (pixel, frame); weights are a number a frame."""
    s = Stack(v, None if w is None else np.broadcast_to(w, v.shape))
    value, used = VECTOR[method](s, **params)
    return value, used, s.n - used


def combine_tiles(tiles: DataFrame, keys: Sequence[str], method: str, order: str, weight: str | None = None, **params: object) -> DataFrame:
    """Tiles (keys..., y0, x0, th, tw, value, n_used, n_rejected), the last three arrays in row order, of blocks with an `order`.

    One shuffle; a task holds one tile's stack, whose size `side` bounds.
    """
    if method not in VECTOR:
        raise ValueError(f"no vector form of combiner {method!r}")
    by = [*keys, "y0", "x0", "th", "tw"]
    kinds = ", ".join(f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in by)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        v = np.stack([np.frombuffer(b.as_buffer(), "<f8") for c in table.column("block").chunks for b in c], axis=1)
        w = None if weight is None else table.column(weight).to_numpy().astype(float)
        value, used, rejected = combine_stack(v, method, w, **params)
        first = table.select(by).slice(0, 1)
        out = [pa.array([value], pa.list_(pa.float64())), pa.array([used.astype(np.int64)], pa.list_(pa.int64())), pa.array([rejected.astype(np.int64)], pa.list_(pa.int64()))]
        return pa.table([*first.columns, *out], names=[*by, "value", "n_used", "n_rejected"])

    return tiles.select(*by, order, "block", *([weight] if weight else [])).groupBy(*by).applyInArrow(run, f"{kinds}, value array<double>, n_used array<bigint>, n_rejected array<bigint>")


def to_pixels(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., y, x, value, n_used, n_rejected) of combined tiles."""
    p = tiles.select(*keys, "y0", "x0", "tw", F.posexplode(F.arrays_zip("value", "n_used", "n_rejected")).alias("p", "s"))
    return p.select(*keys, (F.col("y0") + F.floor(F.col("p") / F.col("tw"))).cast("int").alias("y"), (F.col("x0") + F.col("p") % F.col("tw")).cast("int").alias("x"), "s.value", "s.n_used", "s.n_rejected")


def to_planes(tiles: DataFrame, keys: Sequence[str], column: str = "value") -> DataFrame:
    """Frames (keys..., height, width, data) of combined tiles; a plane is laid out by one task from its tiles."""
    kinds = ", ".join(f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in keys)

    def run(table: pa.Table) -> pa.Table:
        place = [table.column(c).to_numpy() for c in ("y0", "x0", "th", "tw")]
        out = np.zeros((int((place[0] + place[2]).max()), int((place[1] + place[3]).max())))
        for y, x, h, w, v in zip(*place, (v for c in table.column(column).chunks for v in c), strict=True):
            out[y : y + h, x : x + w] = np.asarray(v.values.to_numpy(zero_copy_only=False), float).reshape(h, w)
        first = table.select(list(keys)).slice(0, 1)
        return pa.table([*first.columns, pa.array([out.shape[0]], pa.int32()), pa.array([out.shape[1]], pa.int32()), pa.array([out.ravel()], pa.list_(pa.float64()))], names=[*keys, "height", "width", "data"])

    return tiles.select(*keys, "y0", "x0", "th", "tw", column).groupBy(*keys).applyInArrow(run, f"{kinds}, height int, width int, data array<double>")


def stack_frames(frames: DataFrame, keys: Sequence[str], order: str, method: str = "sigma_clip", weight: str | None = None, size: int | None = None, **params: object) -> DataFrame:
    """Combined tiles of frames (keys..., order, height, width, data[, weight]); the tiles' side follows from the largest group."""
    if size is None:
        size = side(frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1)
    return combine_tiles(cut(frames, [*keys, order, *([weight] if weight else [])], size), keys, method, order, weight, **params)
