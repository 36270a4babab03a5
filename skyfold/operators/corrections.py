"""Corrections of frames and stacks: vignette maps, local background surfaces, colour repairs, session rules, merged headers.

Pixels are (keys, y, x[, c], v) rows; colour frames are rows (keys..., height, width, r, g, b) with arrays in row order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.functions import kernels as K
from skyfold.functions import restore as R
from skyfold.operators import image_ops as I


def _cell(c: str, size: int) -> Column:
    return F.floor(F.col(c) / size).cast("int")


def vignette_map(px: DataFrame, session: str, frame: str, block: int, mesh: int) -> DataFrame:
    """(cy, cx, value): what all sessions' frames share at the scale of a mesh of blocks.

    Block means, their median in each mesh cell, less the frame's median cell; then medians over a session's frames and over
    sessions, so that neither a long session nor one object decides.
    """
    blocks = px.groupBy(session, frame, _cell("y", block).alias("by"), _cell("x", block).alias("bx")).agg(F.avg("v").alias("v"))
    cells = blocks.groupBy(session, frame, _cell("by", mesh).alias("cy"), _cell("bx", mesh).alias("cx")).agg(F.median("v").alias("v"))
    level = cells.withColumn("v", F.col("v") - F.median("v").over(Window.partitionBy(session, frame)))
    own = level.groupBy(session, "cy", "cx").agg(F.median("v").alias("v"))
    return own.groupBy("cy", "cx").agg(F.median("v").alias("value"))


def spread_grid(grid: DataFrame, keys: Sequence[str], height: int, width: int, cell: int) -> DataFrame:
    """A grid of cell values (keys..., cy, cx, value) at every pixel (keys..., y, x, value), bilinear between cell centres.

    Every cell gives to the pixels it reaches, so the work is four rows a pixel and one shuffle, whatever the number of keys.
    """
    ny, nx = -(-height // cell), -(-width // cell)

    def near(c: str, size: int) -> Column:
        first, last = F.greatest((F.col(c) - 1) * cell, F.lit(0)), F.least((F.col(c) + 2) * cell, F.lit(size)) - 1
        return F.explode(F.sequence(first.cast("int"), last.cast("int")))

    def share(at: str, c: str, cells: int) -> Column:
        place = F.greatest(F.least((F.col(at) + 0.5) / cell - 0.5, F.lit(cells - 1.0)), F.lit(0.0))
        return F.greatest(1 - F.abs(place - F.col(c)), F.lit(0.0))

    p = grid.withColumn("y", near("cy", height)).withColumn("_y", share("y", "cy", ny)).filter("_y > 0")
    p = p.withColumn("x", near("cx", width)).withColumn("_w", F.col("_y") * share("x", "cx", nx)).filter("_w > 0")
    return p.groupBy(*keys, "y", "x").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))


def subtract_map(px: DataFrame, correction: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pixels less a map with one row a pixel (and key); pixels that the map lacks stay. Values may fall below zero."""
    on = [*keys, "y", "x"]
    return px.join(correction.select(*on, F.col("value").alias("_c")), on, "left").withColumn("v", F.col("v") - F.coalesce("_c", F.lit(0.0))).select(*px.columns)


def local_surface(samples: DataFrame, keys: Sequence[str], cells: tuple[int, int], sigma: float, reach: int, rounds: int = 2, tukey: float = 4.685) -> DataFrame:
    """(keys..., cy, cx, value): Gaussian-weighted local planes through grid samples (keys..., cy, cx, level), by sums alone.

    A sample gives its nine sums to the grid places within `reach` cells, so a fit is one explode and one partial aggregation.
    After each round but the last, Tukey's biweight lowers samples that lie off. Where the samples around a place do not span a
    plane, their weighted mean stands.
    """
    ny, nx = cells
    s = samples.select(*keys, "cy", "cx", "level").withColumn("_r", F.lit(1.0))

    def fit(of: DataFrame) -> DataFrame:
        to = lambda c, n: F.explode(F.sequence(F.greatest(F.col(c) - reach, F.lit(0)).cast("int"), F.least(F.col(c) + reach, F.lit(n - 1)).cast("int")))
        p = of.withColumn("gy", to("cy", ny)).withColumn("gx", to("cx", nx)).withColumns({"_y": (F.col("cy") - F.col("gy")) / sigma, "_x": (F.col("cx") - F.col("gx")) / sigma})
        p = p.withColumn("_w", F.col("_r") * F.exp(-0.5 * (F.col("_y") * F.col("_y") + F.col("_x") * F.col("_x"))))
        names = {"s": "1", "y": "_y", "x": "_x", "yy": "_y * _y", "yx": "_y * _x", "xx": "_x * _x", "v": "level", "yv": "_y * level", "xv": "_x * level"}
        a = p.groupBy(*keys, "gy", "gx").agg(*[F.sum(F.expr(f"_w * {e}")).alias(n) for n, e in names.items()])
        a = a.withColumns({"yy": F.expr("yy + 0.001 * s"), "xx": F.expr("xx + 0.001 * s")})
        # cofactors of the first row: the constant term by Cramer's rule
        a = a.withColumns({"_a": F.expr("yy * xx - yx * yx"), "_b": F.expr("x * yx - y * xx"), "_c": F.expr("y * yx - x * yy")})
        a = a.withColumn("_d", F.expr("s * _a + y * _b + x * _c"))
        value = F.when(F.col("s") < 1e-12, None).when(F.abs("_d") < 1e-10 * F.col("s") * F.col("yy") * F.col("xx"), F.col("v") / F.col("s")).otherwise(F.expr("(v * _a + yv * _b + xv * _c) / _d"))
        return a.select(*keys, F.col("gy").alias("cy"), F.col("gx").alias("cx"), value.alias("value"))

    for _ in range(rounds - 1):
        w = Window.partitionBy(*keys)
        m = s.join(fit(s), [*keys, "cy", "cx"]).withColumn("_e", F.col("level") - F.col("value"))
        m = m.withColumn("_m", F.median("_e").over(w)).withColumn("_s", F.greatest(K.MAD_SCALE * F.median(F.abs(F.col("_e") - F.col("_m"))).over(w), F.lit(1e-6)))
        u = F.col("_e") / (tukey * F.col("_s"))
        s = m.withColumn("_r", F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)).select(*keys, "cy", "cx", "level", "_r")
    return fit(s)


def border_level(px: DataFrame, keys: Sequence[str], height: int, width: int, share: float = 0.12, least: int = 10) -> DataFrame:
    """Median, deviation and number of each frame's samples in its border strips."""
    by, bx = (max(least, int(n * share)) for n in (height, width))
    rim = px.filter((F.col("y") < by) | (F.col("y") >= height - by) | (F.col("x") < bx) | (F.col("x") >= width - bx))
    return rim.groupBy(*keys).agg(F.median("v").alias("level"), F.stddev_pop("v").alias("spread"), F.count(F.lit(1)).alias("n"))


def fix_stars(px: DataFrame, strength: float = 1.0, stars: Sequence[str] | None = None) -> DataFrame:
    """Takes the colour of narrow-band stars (r, g, b in [0, 1], mask): towards their luminance, or, with the names of a
    broadband image's three columns, towards its colour ratios at the narrow-band luminance."""
    luma = lambda cs: sum(k * F.col(c) for k, c in zip((0.299, 0.587, 0.114), cs, strict=True))
    held = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    m, lum = held(F.col("mask")) * min(max(strength, 0.0), 1.0), luma("rgb")
    to = {c: lum if stars is None else held(lum * F.col(s) / F.greatest(luma(stars), F.lit(1e-4))) for c, s in zip("rgb", stars or "rgb", strict=True)}
    return px.withColumns({c: held(F.col(c) * (1 - m) + to[c] * m) for c in "rgb"})


def level_planes(px: DataFrame, keys: Sequence[str], channel: str = "c") -> DataFrame:
    """Lifts every plane of a frame so that all medians equal the highest one."""
    m = px.groupBy(*keys, channel).agg(F.median("v").alias("_m"))
    lift = m.withColumn("_l", F.max("_m").over(Window.partitionBy(*keys)) - F.col("_m")).select(*keys, channel, "_l")
    return px.join(lift, [*keys, channel]).withColumn("v", F.greatest(F.col("v") + F.col("_l"), F.lit(0.0))).select(*px.columns)


def colour_frames(planes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planes (keys..., channel 0 to 2, height, width, data) as colour frames."""
    return planes.groupBy(*keys, "height", "width").agg(*[F.max(F.when(F.col("channel") == i, F.col("data"))).alias(c) for i, c in enumerate("rgb")])


def map_colour(frames: DataFrame, keys: Sequence[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Colour frames with the kernel's result (height, width, 3); one frame at a time, small results in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes, height, width = [batch.column(c) for c in "rgb"], batch.column("height").to_pylist(), batch.column("width").to_pylist()
            for rows, out in I.pieces(batch, lambda i, p=planes, h=height, w=width: kernel(np.stack([I._array(c[i], h[i], w[i]) for c in p], -1))):
                yield I.colour_batch(batch, keys, rows, out)

    return frames.select(*keys, "height", "width", "r", "g", "b").mapInArrow(run, f"{I._kinds(frames, keys)}, height int, width int, r array<double>, g array<double>, b array<double>")


def colour_pixels(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., y, x, r, g, b) of colour frames."""
    p = frames.select(*keys, "width", F.posexplode(F.arrays_zip("r", "g", "b")).alias("p", "_v"))
    return p.select(*keys, F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), *[F.col(f"_v.{c}").alias(c) for c in "rgb"])


def _stars(a: np.ndarray, k: float = 3.0) -> np.ndarray:
    return K.detect_stars(R.luminance(a), k=k)


#: Colour steps by name, with their default parameters.
COLOUR: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "chroma": lambda a: R.reduce_chroma(a, 2.0),
    "chroma_wide": lambda a: R.reduce_chroma(a, 2.0, wide=12.0),
    "saturated": lambda a: R.repair_saturated(a),
    "halos": lambda a: R.remove_halos(a, stars := _stars(a), K.measure_fwhm(R.luminance(a), stars)),
    "hot_colour": lambda a: K.fix_hot_colour(a),
    "neutralise": lambda a: R.neutralise(a, K.star_mask(a.shape[:2], _stars(a), 2.5), max(64.0, min(a.shape[:2]) / 8)),
}


#: Header and session values whose object names no target (fixed values).
NO_OBJECT = ("", "unknown", "none", "target", "object", "n/a", "na", "light", "lights", "flat", "dark", "bias", "test")


def usable_object(name: Column) -> Column:
    """Whether an object's name says anything; null does not."""
    return ~F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(*NO_OBJECT)


def first_seen(rows: DataFrame, fields: Column, order: Column) -> DataFrame:
    """(field, place): all fields that the rows' arrays name, numbered by the first row and place they occur in.

    The aggregation leaves one row a field, so the numbering works on the few distinct names.
    """
    each = rows.select(order.alias("_o"), F.posexplode(fields).alias("_p", "field"))
    first = each.groupBy("field").agg(F.min(F.struct("_o", "_p")).alias("_f"))
    return first.select("field", F.row_number().over(Window.orderBy("_f", "field")).alias("place"))


def ordered_outputs(rows: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Rows numbered by their path within their folder, so that later steps do not depend on the listing's order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(path)))


def merged_headers(headers: DataFrame, keys: Sequence[str], most: int = 20) -> DataFrame:
    """Header of a merged stack from its sources' (source, frames, seconds, first, last): totals, span and the first `most`
    sources by name, which is what a header has room for."""
    ranked = headers.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("source")))
    agg = ranked.groupBy(*keys).agg(
        F.sum("frames").alias("frames"), F.sum("seconds").alias("seconds"), F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("merged"), F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.substring("source", 1, 68)))).alias("_s")
    )
    return agg.withColumn("sources", F.concat_ws(",", "_s")).drop("_s")


def age_hours(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 3.6e9


def exposure_seconds(value: Column) -> Column:
    """Exposures of 1000 and more are milliseconds."""
    return F.when(value >= 1000, value / 1000).otherwise(value)


#: Settings of a session before the rules (fixed starting values).
SETTINGS = {"combine": "auto", "sigma": 3.0, "iterations": 3, "consensus": False, "deconvolve": True, "deconvolve_iterations": 15, "tv": False, "tv_iterations": 50, "median_cascade": False, "median_strength": 3.0, "wavelet": False, "wavelet_strength": 3.0, "contrast": False, "block_match": False, "patch_weights": False, "black": 2.5}


def session_rules(sessions: DataFrame, explicit: Sequence[str] = (), auto_strength: bool = True) -> DataFrame:
    """Settings from a session's size and quality: rows (..., n, snr, fwhm, strehl, dispersion, suited) get the columns of
    SETTINGS, changed by the rules in order. Columns that the rows bring already are their starting values, and those named in
    `explicit` stay as they are. `suited` is the weight of target classes that block matching suits."""
    n, snr, fwhm, strehl, dispersion = (F.col(c) for c in ("n", "snr", "fwhm", "strehl", "dispersion"))
    out = sessions.withColumns({k: F.lit(v) for k, v in SETTINGS.items() if k not in sessions.columns})
    seen = snr > 0
    auto = F.col("combine") == "auto"
    out = out.withColumn("_auto", auto)
    steps = F.col("deconvolve_iterations")
    rules: list[tuple[str, Column, Column]] = [
        ("sigma", F.col("_auto") & n.between(15, 19), F.lit(3.0)),
        ("sigma", F.col("_auto") & (n >= 20), F.lit(2.8)),
        ("iterations", F.col("_auto") & (n >= 20), F.lit(4)),
        ("combine", F.col("_auto"), F.when(n < 8, "percentile").when(n < 15, "trimmed_mean").otherwise("sigma_clip")),
        ("consensus", n >= 20, F.lit(True)),
        ("wavelet_strength", F.lit(not auto_strength) & seen, F.when(snr < 5, 4.5).when(snr < 10, 3.5).when(snr > 20, 2.0).otherwise(F.col("wavelet_strength"))),
        ("deconvolve_iterations", F.col("deconvolve") & (fwhm > 4), F.least(steps + F.floor((fwhm - 3) * 3), F.lit(30)).cast("int")),
        ("median_strength", F.col("median_cascade") & seen, F.when(snr < 5, 4.0).when(snr < 10, 3.5).when(snr > 20, 2.0).otherwise(F.col("median_strength"))),
        ("contrast", seen & (snr < 5) & ~F.col("median_cascade") & ~F.col("wavelet") & ~F.col("block_match"), F.lit(True)),
        ("block_match", (F.col("suited") > 0.5) & (snr >= 12) & (n >= 20), F.lit(True)),
        ("tv_iterations", F.col("tv"), F.when(seen & (snr < 8), F.greatest(F.col("tv_iterations") - 10, F.lit(30))).when(snr > 20, F.least(F.col("tv_iterations") + 20, F.lit(80))).otherwise(F.col("tv_iterations"))),
        ("deconvolve", (strehl > 0) & (strehl < 0.15), F.lit(False)),
        ("tv", (strehl > 0) & (strehl < 0.15), F.lit(False)),
        ("deconvolve_iterations", (strehl >= 0.15) & (strehl < 0.25), F.greatest(F.floor(steps / 2).cast("int"), F.lit(8))),
        ("deconvolve", dispersion > 3, F.lit(False)),
        ("tv", dispersion > 3, F.lit(False)),
        ("deconvolve_iterations", (dispersion > 1.5) & (dispersion <= 3), F.greatest(F.floor(steps * 0.6).cast("int"), F.lit(5))),
        ("patch_weights", (n >= 15) & (fwhm > 0), F.lit(True)),
        ("black", (F.col("black") > 1) & (n < 20), F.lit(1.0)),
        ("black", (F.col("black") > 2) & (n < 60), F.lit(2.0)),
        # one luminance denoiser is left: the first of the list that is on
        ("contrast", F.col("block_match") | F.col("median_cascade") | F.col("wavelet"), F.lit(False)),
        ("wavelet", F.col("block_match") | F.col("median_cascade"), F.lit(False)),
        ("median_cascade", F.col("block_match"), F.lit(False)),
    ]
    for name, when, value in rules:
        if name not in explicit:
            out = out.withColumn(name, F.when(when, value).otherwise(F.col(name)))
    return out.drop("_auto")
