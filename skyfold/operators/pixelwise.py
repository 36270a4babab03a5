"""Image operators that need no neighbourhood: calibration, colour, sky, blends. Pixels are (keys, y, x[, c], v) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calibrate(px: DataFrame, dark: DataFrame, flat: DataFrame, scale: float = 1.0) -> DataFrame:
    """(v - scaled dark) / flat, not below zero. Masters have one row a pixel and are joined on the position."""
    joined = px.join(dark.select("y", "x", F.col("value").alias("_d")), ["y", "x"], "left").join(flat.select("y", "x", F.col("value").alias("_f")), ["y", "x"], "left")
    v = (F.col("v") - F.coalesce("_d", F.lit(0.0)) * scale) / F.coalesce("_f", F.lit(1.0))
    return joined.select(*px.columns[: px.columns.index("v")], F.greatest(v, F.lit(0.0)).alias("v"))


def flat_norm(flat: DataFrame) -> DataFrame:
    """A master flat over its median, held to [0.4, 2.5]; the median is one number, found by its own aggregation."""
    middle = flat.agg(F.median("value")).first()[0]
    return flat.withColumn("value", F.greatest(F.least(F.col("value") / F.lit(middle), F.lit(2.5)), F.lit(0.4)))


def cfa(y: Column, x: Column, pattern: str = "RGGB") -> Column:
    """Colour filter over a mosaic pixel: R, G1, G2 or B."""
    names, seen = [], 0
    for c in pattern:
        seen += c == "G"
        names.append(f"G{seen}" if c == "G" else c)
    return F.element_at(F.array(*[F.lit(n) for n in names]), ((y % 2) * 2 + x % 2 + 1).cast("int"))


def green_equalize(px: DataFrame, keys: Sequence[str], pattern: str = "RGGB", limit: float = 0.2) -> DataFrame:
    """Scales the second green lattice to the first one's median where they differ by less than the limit."""
    w = Window.partitionBy(*keys)
    f = px.withColumn("_c", cfa(F.col("y"), F.col("x"), pattern))
    m = [F.median(F.when(F.col("_c") == c, F.col("v"))).over(w) for c in ("G1", "G2")]
    f = f.withColumn("_k", m[0] / m[1])
    return f.withColumn("v", F.when((F.col("_c") == "G2") & (F.abs(F.col("_k") - 1) < limit), F.col("v") * F.col("_k")).otherwise(F.col("v"))).select(*px.columns)


def bayer_orientation(px: DataFrame, keys: Sequence[str], threshold: float = 1.2) -> DataFrame:
    """Whether the mosaic's rows are flipped: the green lattices' medians disagree."""
    f = px.withColumn("_c", cfa(F.col("y"), F.col("x")))
    agg = f.groupBy(*keys).agg(F.median(F.when(F.col("_c") == "G1", F.col("v"))).alias("g1"), F.median(F.when(F.col("_c") == "G2", F.col("v"))).alias("g2"))
    ratio = F.greatest("g1", "g2") / F.greatest(F.least("g1", "g2"), F.lit(1e-12))
    return agg.select(*keys, ratio.alias("ratio"), F.when(ratio > threshold, "flipped").otherwise("as given").alias("orientation"))


def phase_offsets(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Removes the 2x2 lattice offsets of a mosaic: each phase's median is brought to their mean."""
    w = Window.partitionBy(*keys, F.col("y") % 2, F.col("x") % 2)
    m = px.withColumn("_m", F.median("v").over(w))
    whole = Window.partitionBy(*keys)
    spread = F.max("_m").over(whole) - F.min("_m").over(whole)
    m = m.withColumn("_s", spread).withColumn("_o", F.col("_m") - F.avg("_m").over(whole))
    return m.withColumn("v", F.when(F.col("_s").between(0.01, 100), F.col("v") - F.col("_o")).otherwise(F.col("v"))).select(*px.columns)


def hot_pixels(dark: DataFrame, sigma: float = 5.0) -> DataFrame:
    """Positions of a master dark (y, x, value) over the robust threshold, whose two numbers come from aggregations."""
    middle, deviation = dark.agg(F.median("value"), F.stddev_pop("value")).first()
    spread = dark.agg(1.4826 * F.median(F.abs(F.col("value") - F.lit(middle)))).first()[0]
    limit = (middle or 0.0) + sigma * (spread if spread and spread >= 1e-12 else deviation or 0.0)
    return dark.filter(F.col("value") > limit).select("y", "x", "value")


def gray_world(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brings every channel (c) to the mean of the channels' means."""
    means = px.groupBy(*keys, "c").agg(F.avg("v").alias("_m"))
    means = means.withColumn("_k", F.avg("_m").over(Window.partitionBy(*keys)) / F.greatest("_m", F.lit(1e-9))).select(*keys, "c", "_k")
    return px.join(means, [*keys, "c"]).withColumn("v", F.greatest(F.col("v") * F.col("_k"), F.lit(0.0))).select(*px.columns)


def white_patch(px: DataFrame, keys: Sequence[str], percentile: float = 99.5) -> DataFrame:
    """Brings every channel's bright end to the channels' mean bright end."""
    tops = px.groupBy(*keys, "c").agg(F.percentile("v", F.lit(percentile / 100)).alias("_p"))
    tops = tops.withColumn("_k", F.avg("_p").over(Window.partitionBy(*keys)) / F.greatest("_p", F.lit(1e-9))).select(*keys, "c", "_k")
    return px.join(tops, [*keys, "c"]).withColumn("v", F.greatest(F.col("v") * F.col("_k"), F.lit(0.0))).select(*px.columns)


def normalise(px: DataFrame, keys: Sequence[str], low: float = 0.1, high: float = 99.9) -> DataFrame:
    """Clips to two percentiles and scales to [0, 1]."""
    p = px.withColumn("_p", F.percentile("v", F.array(F.lit(low / 100), F.lit(high / 100))).over(Window.partitionBy(*keys)))
    lo, hi = F.col("_p")[0], F.col("_p")[1]
    return p.withColumn("v", F.when(hi - lo < 1e-12, 0.0).otherwise((F.greatest(F.least("v", hi), lo) - lo) / (hi - lo))).select(*px.columns)


def sanitize(v: Column) -> Column:
    return F.greatest(F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), 0.0).otherwise(v), F.lit(0.0))


def sky_floor(px: DataFrame, keys: Sequence[str], clip: bool = True, sigma: float = 2.5, rounds: int = 3) -> DataFrame:
    """Subtracts each group's clipped median sky if it is above zero (clip), or in any case (no clip)."""
    w = Window.partitionBy(*keys)
    s = px.withColumn("_k", F.lit(True))
    for _ in range(rounds):
        kept = F.when(F.col("_k"), F.col("v"))
        s = s.withColumns({"_m": F.median(kept).over(w), "_d": F.stddev_pop(kept).over(w)})
        s = s.withColumn("_k", F.col("_k") & (F.abs(F.col("v") - F.col("_m")) < sigma * F.greatest("_d", F.lit(1e-9))))
    s = s.withColumn("_m", F.coalesce(F.median(F.when(F.col("_k"), F.col("v"))).over(w), F.col("_m")))
    v = F.greatest(F.when(F.col("_m") > 0, F.col("v") - F.col("_m")).otherwise(F.col("v")), F.lit(0.0)) if clip else F.col("v") - F.col("_m")
    return s.withColumn("v", v).select(*px.columns)


def pedestal(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lifts each group so that its median lies eight deviations over zero."""
    w = Window.partitionBy(*keys)
    s = px.withColumn("_m", F.median("v").over(w)).withColumn("_s", 1.4826 * F.median(F.abs(F.col("v") - F.col("_m"))).over(w))
    return s.withColumn("v", F.col("v") + F.greatest(8 * F.col("_s") - F.col("_m"), F.lit(0.0))).select(*px.columns)


def gradient_plane(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Subtracts each group's least-squares plane (its mean stays), from sums alone."""
    w = Window.partitionBy(*keys)
    s = px.withColumns({"_y": F.col("y") - F.avg("y").over(w), "_x": F.col("x") - F.avg("x").over(w), "_v": F.col("v") - F.avg("v").over(w)})
    names = {"_yy": ("_y", "_y"), "_xx": ("_x", "_x"), "_yx": ("_y", "_x"), "_yv": ("_y", "_v"), "_xv": ("_x", "_v")}
    s = s.withColumns({n: F.sum(F.col(a) * F.col(b)).over(w) for n, (a, b) in names.items()})
    det = F.col("_yy") * F.col("_xx") - F.col("_yx") * F.col("_yx")
    ky = F.when(F.abs(det) < 1e-12, 0.0).otherwise((F.col("_yv") * F.col("_xx") - F.col("_xv") * F.col("_yx")) / det)
    kx = F.when(F.abs(det) < 1e-12, 0.0).otherwise((F.col("_xv") * F.col("_yy") - F.col("_yv") * F.col("_yx")) / det)
    return s.withColumn("v", F.greatest(F.col("v") - ky * F.col("_y") - kx * F.col("_x"), F.lit(0.0))).select(*px.columns)


def stack_snr(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean excess of the pixels five deviations over the sky, in deviations; of the top 0.1 % where there are fewer than five."""
    w = Window.partitionBy(*keys)
    s = px.withColumn("_m", F.median("v").over(w)).withColumn("_s", F.greatest(1.4826 * F.median(F.abs(F.col("v") - F.col("_m"))).over(w), F.lit(1e-6)))
    s = s.withColumn("_p", F.percentile("v", F.lit(0.999)).over(w)).withColumn("_b", F.col("v") > F.col("_m") + 5 * F.col("_s"))
    agg = s.groupBy(*keys).agg(F.count(F.when(F.col("_b"), 1)).alias("n"), F.avg(F.when(F.col("_b"), F.col("v"))).alias("a"), F.first("_p").alias("p"), F.first("_m").alias("m"), F.first("_s").alias("s"))
    return agg.select(*keys, ((F.when(F.col("n") >= 5, F.col("a")).otherwise(F.col("p")) - F.col("m")) / F.col("s")).alias("snr"))


def hdr_blend(long: DataFrame, short: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replaces what is bright in the long exposure by the scaled short one, over a ramp around its 98th percentile."""
    j = long.select(*keys, "y", "x", F.col("v").alias("_l")).join(short.select(*keys, "y", "x", F.col("v").alias("_s")), [*keys, "y", "x"])
    w = Window.partitionBy(*keys)
    j = j.withColumns({"_k": F.avg("_l").over(w) / F.greatest(F.avg("_s").over(w), F.lit(1e-9)), "_p": F.percentile("_l", F.lit(0.98)).over(w)})
    mask = F.greatest(F.least((F.col("_l") - 0.9 * F.col("_p")) / (0.2 * F.col("_p")), F.lit(1.0)), F.lit(0.0))
    return j.select(*keys, "y", "x", (F.col("_l") * (1 - mask) + F.col("_s") * F.col("_k") * mask).alias("v"))


def comet_blend(stars: DataFrame, comet: DataFrame, keys: Sequence[str], cy: float, cx: float, sigma: float) -> DataFrame:
    """The comet's stack around the nucleus, the stars' stack elsewhere, by a Gaussian mask."""
    j = stars.select(*keys, "y", "x", F.col("v").alias("_a")).join(comet.select(*keys, "y", "x", F.col("v").alias("_b")), [*keys, "y", "x"])
    mask = F.exp(-((F.col("y") - cy) ** 2 + (F.col("x") - cx) ** 2) / (2 * sigma * sigma))
    return j.select(*keys, "y", "x", (F.col("_a") * (1 - mask) + F.col("_b") * mask).alias("v"))


def lrgb(px: DataFrame, boost: float = 1.0) -> DataFrame:
    """Layers a luminance channel over colours: rows (y, x, l, r, g, b)."""
    old = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    k = F.col("l") / F.greatest(old, F.lit(1e-9))
    lifted = {c: F.greatest(F.col("l") + (F.col(c) * k - F.col("l")) * boost, F.lit(0.0)) for c in ("r", "g", "b")}
    return px.withColumns(lifted)


#: Which of the narrow bands feeds red, green and blue (fixed values).
PALETTES = {"sho": ("sii", "ha", "oiii"), "hoo": ("ha", "oiii", "oiii"), "hos": ("ha", "oiii", "sii"), "hso": ("ha", "sii", "oiii"), "oho": ("oiii", "ha", "oiii"), "shs": ("sii", "ha", "sii")}


def narrowband(px: DataFrame, palette: str) -> DataFrame:
    """(y, x, ha, oiii, sii) to (y, x, r, g, b)."""
    r, g, b = PALETTES[palette]
    return px.select("y", "x", F.col(r).alias("r"), F.col(g).alias("g"), F.col(b).alias("b"))


def patch_weighted(px: DataFrame, grid: DataFrame, keys: Sequence[str], frame: str, patch: int, cells: int) -> DataFrame:
    """Mean over frames with weights interpolated bilinearly from each frame's patch grid (frame, gy, gx, w)."""
    gy = F.greatest(F.least((F.col("y") + 0.5) / patch - 0.5, F.lit(cells - 1.0)), F.lit(0.0))
    gx = F.greatest(F.least((F.col("x") + 0.5) / patch - 0.5, F.lit(cells - 1.0)), F.lit(0.0))
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    p = px.withColumns({"_gy": gy, "_gx": gx}).withColumn("_k", corners)
    iy, ix = F.floor("_gy"), F.floor("_gx")
    fy, fx = F.col("_gy") - iy, F.col("_gx") - ix
    share = F.when(F.col("_k.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("_k.b") == 1, fx).otherwise(1 - fx)
    p = p.withColumns({"gy": F.least(iy + F.col("_k.a"), F.lit(cells - 1)).cast("int"), "gx": F.least(ix + F.col("_k.b"), F.lit(cells - 1)).cast("int"), "_share": share})
    j = p.join(grid.select(frame, "gy", "gx", F.col("w").alias("_w")), [frame, "gy", "gx"])
    return j.groupBy(*keys).agg((F.sum(F.col("_share") * F.col("_w") * F.col("v")) / F.greatest(F.sum(F.col("_share") * F.col("_w")), F.lit(1e-12))).alias("value"))
