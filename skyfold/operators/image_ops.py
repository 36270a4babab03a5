"""Neighbourhood operators: array kernels over frames in Arrow batches, tiles with halos, shifts, drizzle.

A frame is a row (keys..., height, width, data array<double> in row order). A batch holds whole frames, so a kernel sees its
full neighbourhood; frames too large for a task are cut into tiles that carry a halo as wide as the kernel's reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions import collaborative, detect
from skyfold.functions import kernels as K
from skyfold.functions import registration as R
from skyfold.functions import restore
from skyfold.operators import tiles as T


def _array(row_data: pa.Scalar, height: int, width: int) -> np.ndarray:
    return np.asarray(row_data.values.to_numpy(zero_copy_only=False), float).reshape(height, width)


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def map_frames(frames: DataFrame, keys: Sequence[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Frames with the kernel's result as data; a kernel may change the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.asarray(kernel(_array(d, h, w)), float) for d, h, w in zip(batch.column("data"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array([a.shape[0] for a in out], pa.int32()), pa.array([a.shape[1] for a in out], pa.int32()), pa.array([a.ravel() for a in out], pa.list_(pa.float64()))], names=[*keys, "height", "width", "data"]
            )

    return frames.select(*keys, "height", "width", "data").mapInArrow(run, f"{_kinds(frames, keys)}, height int, width int, data array<double>")


def flat_map_frames(frames: DataFrame, keys: Sequence[str], columns: dict[str, str], kernel: Callable[[np.ndarray], Sequence[Sequence]]) -> DataFrame:
    """Rows that a kernel finds in each frame, with the frame's keys: a table function over frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [{"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}[t] for t in columns.values()]
        for batch in batches:
            row, found = [], []
            for i, (d, h, w) in enumerate(zip(batch.column("data"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)):
                mine = list(kernel(_array(d, h, w)))
                row += [i] * len(mine)
                found += mine
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *(pa.array([f[j] for f in found], t) for j, t in enumerate(types))], names=[*keys, *columns])

    return frames.select(*keys, "height", "width", "data").mapInArrow(run, f"{_kinds(frames, keys)}, " + ", ".join(f"`{n}` {t}" for n, t in columns.items()))


def to_pixels(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., y, x, v) of frames."""
    p = frames.select(*keys, "width", F.posexplode("data").alias("p", "v"))
    return p.select(*keys, F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), "v")


def tiles(frames: DataFrame, keys: Sequence[str], size: int, halo: int) -> DataFrame:
    """Tiles (keys..., ty, tx, y0, x0, frame_height, frame_width) as frames whose data include the halo; outside is mirrored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (d, h, w) in enumerate(zip(batch.column("data"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)):
                p = np.pad(_array(d, h, w), halo, mode="symmetric")
                cuts = [(y, x, p[y : min(y + size, h) + 2 * halo, x : min(x + size, w) + 2 * halo]) for y in range(0, h, size) for x in range(0, w, size)]
                n = len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([batch.column(k)[i].as_py()] * n, batch.column(k).type) for k in keys),
                        *(pa.array(v, pa.int32()) for v in ([c[0] for c in cuts], [c[1] for c in cuts], [h] * n, [w] * n, [c[2].shape[0] for c in cuts], [c[2].shape[1] for c in cuts])),
                        pa.array([c[2].ravel() for c in cuts], pa.list_(pa.float64())),
                    ],
                    names=[*keys, "y0", "x0", "frame_height", "frame_width", "height", "width", "data"],
                )

    return frames.select(*keys, "height", "width", "data").mapInArrow(run, f"{_kinds(frames, keys)}, y0 int, x0 int, frame_height int, frame_width int, height int, width int, data array<double>")


def tile_pixels(cut: DataFrame, keys: Sequence[str], halo: int) -> DataFrame:
    """Pixels of filtered tiles without their halos, at their places in the frame."""
    p = to_pixels(cut.withColumn("_h", F.col("height")).withColumn("_w", F.col("width")), [*keys, "y0", "x0", "_h", "_w"])
    inner = p.filter((F.col("y") >= halo) & (F.col("x") >= halo) & (F.col("y") < F.col("_h") - halo) & (F.col("x") < F.col("_w") - halo))
    return inner.select(*keys, (F.col("y") - halo + F.col("y0")).alias("y"), (F.col("x") - halo + F.col("x0")).alias("x"), "v")


def shifts_to_reference(frames: DataFrame, references: DataFrame, group: Sequence[str], frame: str) -> DataFrame:
    """(group..., frame, dy, dx): each frame against its group's reference (group..., r_data), one row per group."""
    joined = frames.join(references, list(group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [K.phase_shift(_array(r, h, w), _array(d, h, w)) for d, r, h, w in zip(batch.column("data"), batch.column("r_data"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*group, frame)), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=[*group, frame, "dy", "dx"])

    return joined.select(*group, frame, "height", "width", "data", "r_data").mapInArrow(run, f"{_kinds(frames, (*group, frame))}, dy double, dx double")


FITS = {"dy": "double", "dx": "double", "angle": "double", "method": "string", "matched": "int", "residual": "double"}


def register_to_reference(frames: DataFrame, references: DataFrame, group: Sequence[str], frame: str, sigma: float = 5.0, cells: int = 0) -> DataFrame:
    """(group..., frame, dy, dx, angle, method, matched, residual): rigid placement of each frame on its group's reference.

    References are one row a group (group..., r_data). Stars decide; `method` says whether they were paired near the
    correlation's shift (`stars`), by their distances (`distances`), or whether the shift alone was left (`shift`, with null
    residual). A reference's stars are detected once for consecutive frames of its group. With `cells`, a column `field` holds
    what the stars lack after that, as a smooth grid (cells, cells, 2), or null where too few stars agree.
    """
    joined = frames.join(references, list(group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"double": pa.float64(), "int": pa.int32(), "string": pa.string()}
        held, reference, stars = None, None, None
        for batch in batches:
            found = []
            names = zip(*(batch.column(k).to_pylist() for k in group), strict=True)
            for name, d, r, h, w in zip(names, batch.column("data"), batch.column("r_data"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True):
                if held != (name, h, w):
                    held, reference = (name, h, w), _array(r, h, w)
                    stars = detect.detect(reference, k=sigma)
                a = _array(d, h, w)
                # a reference with too few stars leaves the shift, whatever the frame holds
                found.append(R.register(reference, stars, a, detect.detect(a, k=sigma) if len(stars) >= R.LEAST_PAIRS else stars[:0]))
            arrays = [*(batch.column(k) for k in (*group, frame)), *(pa.array([getattr(f, n) for f in found], types[t]) for n, t in FITS.items())]
            if cells:
                sizes = zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)
                fields = [None if f.places is None else restore.displacement_field(f.places, f.brought, size, cells) for f, size in zip(found, sizes, strict=True)]
                arrays.append(pa.array([None if f is None else f.ravel() for f in fields], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(arrays, names=[*group, frame, *FITS, *(["field"] if cells else [])])

    kinds = FITS | ({"field": "array<double>"} if cells else {})
    return joined.select(*group, frame, "height", "width", "data", "r_data").mapInArrow(run, f"{_kinds(frames, (*group, frame))}, " + ", ".join(f"{n} {t}" for n, t in kinds.items()))


DEBAYER = {"bilinear": K.debayer_bilinear, "gradient": K.debayer_gradient, "directional": K.debayer_directional}


def debayer(frames: DataFrame, keys: Sequence[str], method: str) -> DataFrame:
    """Mosaics as three planes a frame: (keys..., channel, height, width, data), channel 0 to 2 for red, green and blue."""
    kernel = DEBAYER[method]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (d, h, w) in enumerate(zip(batch.column("data"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)):
                rgb = np.asarray(kernel(_array(d, h, w)), float)
                planes = pa.array([rgb[..., c].ravel() for c in range(3)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array([i] * 3)) for k in keys), *(pa.array(v, pa.int32()) for v in (range(3), [h] * 3, [w] * 3)), planes], names=[*keys, "channel", "height", "width", "data"])

    return frames.select(*keys, "height", "width", "data").mapInArrow(run, f"{_kinds(frames, keys)}, channel int, height int, width int, data array<double>")


def pieces(batch: pa.RecordBatch, kernel: Callable[[int], np.ndarray], most: int = 1 << 18) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """The kernel's results for a batch's rows, by numbers of rows: `most` samples at once, or one row's where these are more."""
    rows, out, held = [], [], 0
    for i in range(batch.num_rows):
        rows.append(i)
        out.append(np.asarray(kernel(i), float))
        held += out[-1].size
        if held >= most:
            yield pa.array(rows), out
            rows, out, held = [], [], 0
    if rows:
        yield pa.array(rows), out


def colour_batch(batch: pa.RecordBatch, keys: Sequence[str], rows: pa.Array, out: Sequence[np.ndarray]) -> pa.RecordBatch:
    """Colour frames (height, width, 3) as rows (keys..., height, width, r, g, b), keys from the batch's rows."""
    planes = [pa.array([a[..., c].ravel() for a in out], pa.list_(pa.float64())) for c in range(3)]
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in keys), *(pa.array([a.shape[n] for a in out], pa.int32()) for n in (0, 1)), *planes], names=[*keys, "height", "width", "r", "g", "b"])


def debayer_colour(frames: DataFrame, keys: Sequence[str], method: str) -> DataFrame:
    """Mosaics as colour frames (keys..., height, width, r, g, b): the planes of `debayer` in one row, without a shuffle."""
    kernel = DEBAYER[method]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, height, width = batch.column("data"), batch.column("height").to_pylist(), batch.column("width").to_pylist()
            for rows, out in pieces(batch, lambda i, d=data, h=height, w=width: kernel(_array(d[i], h[i], w[i]))):
                yield colour_batch(batch, keys, rows, out)

    return frames.select(*keys, "height", "width", "data").mapInArrow(run, f"{_kinds(frames, keys)}, height int, width int, r array<double>, g array<double>, b array<double>")


_PLACED = ("height", "width", "dy", "dx", "angle", "field")


def _placed(frames: DataFrame) -> DataFrame:
    return frames.withColumns({n: F.lit(v).cast(t) for n, v, t in (("angle", 0.0, "double"), ("field", None, "array<double>")) if n not in frames.columns})


def _warped(batch: pa.RecordBatch, scale: float = 1.0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, resampled frame and coverage of each row of a batch."""
    for i, (d, h, w, dy, dx, angle, field) in enumerate(zip(batch.column("data"), *(batch.column(c).to_pylist() for c in _PLACED), strict=True)):
        size, moved = (round(h * scale), round(w * scale)), None
        if field:
            cells = round((len(field) // 2) ** 0.5)
            grid = np.reshape(field, (cells, cells, 2)) * scale
            moved = np.stack([restore.upsample(grid[..., axis], size) for axis in (0, 1)], -1)
        yield i, *K.lanczos_warp(_array(d, h, w), np.diag([scale, scale, 1.0]) @ R.matrix((h, w), dy, dx, angle), size, moved=moved)


def warp_frames(frames: DataFrame, keys: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Frames (with dy, dx and, where they turn or bend, angle and field) resampled onto the reference grid, `scale` times finer: pixels (keys..., y, x, v) that are covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, a, cover in _warped(batch, scale):
                y, x = np.nonzero(cover)
                yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(k)[i].as_py()] * len(y), batch.column(k).type) for k in keys), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(a[y, x])], names=[*keys, "y", "x", "v"])

    return _placed(frames).select(*keys, "data", *(c for c in _PLACED if c not in keys)).mapInArrow(run, f"{_kinds(frames, keys)}, y int, x int, v double")


def warp_tiles(frames: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """The same as blocks of tiles (keys..., y0, x0, th, tw, block); samples that are not covered are NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, a, cover in _warped(batch):
                parts = T.cut_array(np.where(cover, a, np.nan), size)
                at = pa.array([i] * len(parts))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *T.blocks(parts)], names=[*keys, *T.NAMES])

    return _placed(frames).select(*keys, "data", *(c for c in _PLACED if c not in keys)).mapInArrow(run, f"{_kinds(frames, keys)}, {T.KINDS}")


def align_frames(frames: DataFrame, keys: Sequence[str], crop: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The same, as whole frames (keys..., height, width, data) cut to rows top to bottom and columns left to right; zero where not covered."""
    top, bottom, left, right = crop or (0, None, 0, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, a, _ in _warped(batch):
                cut, at = a[top:bottom, left:right], pa.array([i])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *(pa.array([n], pa.int32()) for n in cut.shape), pa.array([cut.ravel()], pa.list_(pa.float64()))], names=[*keys, "height", "width", "data"])

    return _placed(frames).select(*keys, "data", *_PLACED).mapInArrow(run, f"{_kinds(frames, keys)}, height int, width int, data array<double>")


def drizzle(frames: DataFrame, keys: Sequence[str], frame: str, scale: float = 2.0) -> DataFrame:
    """Weighted mean of the frames (with dy, dx, weight) on a finer grid; pixels that no frame covers are absent."""
    warped = warp_frames(frames, [*keys, frame, "weight"], scale)
    return warped.groupBy(*keys, "y", "x").agg((F.sum(F.col("weight") * F.col("v")) / F.greatest(F.sum("weight"), F.lit(1e-12))).alias("value"), F.count(F.lit(1)).alias("frames"))


#: The image chain by name: frame kernels with their default parameters.
FILTERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "median": lambda a: K.median_filter(a, 1),
    "hot_pixels": lambda a: K.fix_hot_pixels(a, 5.0),
    "hot_bayer": lambda a: K.fix_hot_bayer(a, 5.0),
    "cosmics": lambda a: K.reject_cosmics(a)[0],
    "trails": lambda a: K.fill_trails(a)[0],
    "gaussian": lambda a: K.gaussian(a, 1.0),
    "starlet": lambda a: K.denoise_starlet(a, 2),
    "bayes_shrink": lambda a: K.denoise_bayes_shrink(a, 2),
    "bilateral": lambda a: K.bilateral(a, 60.0),
    "non_local_means": lambda a: K.non_local_means(a, 80.0),
    "median_cascade": lambda a: K.median_cascade(a, 2),
    "contrast": lambda a: K.contrast_denoise(a),
    "block_match": lambda a: collaborative.block_match(a, K.mad_sigma(a)),
    "rotational_gradient": lambda a: collaborative.rotational_gradient(a, (a.shape[0] - 1) / 2, (a.shape[1] - 1) / 2),
    "diffusion": lambda a: K.diffuse(a, 5, 200.0),
    "richardson_lucy": lambda a: K.richardson_lucy(a, K.moffat_psf(5, 1.2, 2.5), 5),
    "tv_deconvolution": lambda a: K.tv_deconvolve(a, K.moffat_psf(5, 1.2, 2.5), 10),
    "background_mesh": lambda a: a - K.background(a) + np.median(a),
    "background_surface": lambda a: a - K.surface(a) + np.median(a),
    "background_starlet": lambda a: a - K.starlet(a, 2)[-1] + np.median(a),
    "reduce_stars": lambda a: K.reduce_stars(a, K.star_mask(a.shape, K.detect_stars(a, k=3.0), 2.0)),
    "local_contrast": lambda a: K.local_contrast(a),
    "deconvolve_by_place": lambda a: restore.deconvolve_by_place(a, K.detect_stars(a, k=3.0), 5, 2, least=1, radius=2, size=5),
    "saturated": lambda a: restore.repair_saturated(a, least=1, radius=3),
    "halos": lambda a: restore.remove_halos(a, K.detect_stars(a, k=3.0), 2.0, 0.75),
    "sky_residual": lambda a: restore.sky_residual(a, 2, wide=1.0),
    "bior_shrink": lambda a: restore.denoise_bior(a, 2),
    "green_bilinear": lambda a: K.debayer_bilinear(a)[..., 1],
    "green_gradient": lambda a: K.debayer_gradient(a)[..., 1],
    "green_directional": lambda a: K.debayer_directional(a)[..., 1],
}


def register(name: str, kernel: Callable[[np.ndarray], np.ndarray]) -> None:
    FILTERS[name] = kernel


def chain(frames: DataFrame, keys: Sequence[str], steps: Sequence[str]) -> DataFrame:
    """Applies filters one after the other inside one pass over the frames."""
    unknown = [s for s in steps if s not in FILTERS]
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    kernels = [FILTERS[s] for s in steps]

    def run(a: np.ndarray) -> np.ndarray:
        for k in kernels:
            a = k(np.where(np.isfinite(a), a, 0.0))
        return a

    return map_frames(frames, keys, run)
