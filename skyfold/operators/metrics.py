"""Per-frame metrics as grouped aggregates over pixels (frame keys, y, x, v) and over star tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def pixel_metrics(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Brightness, contrast, percentiles, robust noise and signal-to-noise of each frame."""
    w = Window.partitionBy(*keys)
    s = px.withColumn("_m", F.median("v").over(w))
    agg = s.groupBy(*keys).agg(
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("contrast"),
        F.first("_m").alias("background"),
        F.greatest(MAD_SCALE * F.median(F.abs(F.col("v") - F.col("_m"))), F.lit(1e-6)).alias("noise"),
        F.percentile("v", F.array(*[F.lit(p) for p in (0.01, 0.5, 0.75, 0.95, 0.99)])).alias("_p"),
        F.max("v").alias("peak"),
        F.count("v").alias("n"),
    )
    named = {name: F.col("_p")[i] for i, name in enumerate(("p01", "p50", "p75", "p95", "p99"))}
    out = agg.withColumns(named).withColumn("dynamic_range", F.col("p99") - F.col("p01"))
    return out.withColumn("snr", (F.col("p95") - F.col("background")) / F.col("noise")).drop("_p")


def quality_score(snr: Column, stars: Column, fwhm: Column) -> Column:
    """0 to 100 from signal, star count and seeing."""
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    over = F.greatest(fwhm - 2, F.lit(0.0))
    return clip(snr / 2) * F.greatest(clip(stars / 50), F.lit(0.01)) * F.greatest(F.lit(0.1), 1 / (1 + 0.02 * over * over)) * 100


def brenner(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean squared difference of samples two columns apart."""
    ahead = F.lead("v", 2).over(Window.partitionBy(*keys, "y").orderBy("x"))
    return px.withColumn("_d", ahead - F.col("v")).groupBy(*keys).agg(F.avg(F.col("_d") * F.col("_d")).alias("brenner"))


def laplacian_variance(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Variance of the four-neighbour Laplacian, edges reflected."""
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    v = F.col("v")
    near = lambda w: F.coalesce(F.lag("v").over(w), v) + F.coalesce(F.lead("v").over(w), v)
    return px.withColumn("_h", near(row)).withColumn("_l", F.col("_h") + near(column) - 4 * v).groupBy(*keys).agg(F.var_pop("_l").alias("laplacian_var"))


def local_maxima(px: DataFrame, keys: Sequence[str], above: float = 1.0) -> DataFrame:
    """Star candidates: samples over their eight neighbours and `above` robust deviations over the median; brightest first."""
    w = Window.partitionBy(*keys)
    s = px.withColumn("_m", F.median("v").over(w)).withColumn("_s", F.greatest(MAD_SCALE * F.median(F.abs(F.col("v") - F.col("_m"))).over(w), F.lit(1e-6)))
    row = Window.partitionBy(*keys, "y").orderBy("x")
    band = F.greatest(F.coalesce(F.lag("v").over(row), F.lit(-1e300)), F.coalesce(F.lead("v").over(row), F.lit(-1e300)))
    s = s.withColumn("_row", band).withColumn("_full", F.greatest("v", "_row"))
    column = Window.partitionBy(*keys, "x").orderBy("y")
    s = s.withColumn("_col", F.greatest(F.coalesce(F.lag("_full").over(column), F.lit(-1e300)), F.coalesce(F.lead("_full").over(column), F.lit(-1e300))))
    stars = s.filter((F.col("v") > F.col("_row")) & (F.col("v") > F.col("_col")) & (F.col("v") > F.col("_m") + above * F.col("_s")))
    rank = F.row_number().over(w.orderBy(F.desc("flux"), "y", "x"))
    return stars.select(*keys, "y", "x", (F.col("v") - F.col("_m")).alias("flux")).withColumn("star", rank)


def patch_scores(px: DataFrame, keys: Sequence[str], patch: int) -> DataFrame:
    """Brenner sharpness of each patch of a frame."""
    cell = [F.floor(F.col("y") / patch).cast("int").alias("py"), F.floor(F.col("x") / patch).cast("int").alias("px")]
    cut = px.select(*keys, *cell, "y", "x", "v")
    return brenner(cut, [*keys, "py", "px"])


def patch_entropy(px: DataFrame, keys: Sequence[str], bins: int = 16) -> DataFrame:
    """Shannon entropy (bits) of each frame's histogram."""
    w = Window.partitionBy(*keys)
    s = px.withColumns({"_lo": F.min("v").over(w), "_hi": F.max("v").over(w)})
    width = F.col("_hi") - F.col("_lo")
    bucket = F.when(width < 1e-12, 0).otherwise(F.least(F.floor((F.col("v") - F.col("_lo")) / width * bins), F.lit(bins - 1)))
    counts = s.groupBy(*keys, bucket.alias("_b")).count()
    p = F.col("count") / F.sum("count").over(w)
    return counts.withColumn("_p", p).groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def sky_sigma(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Noise from neighbour differences between samples that both lie in (0, p80)."""
    s = px.withColumn("_p80", F.percentile("v", F.lit(0.8)).over(Window.partitionBy(*keys)))
    sky = (F.col("v") > 0) & (F.col("v") < F.col("_p80"))
    kept = s.withColumn("_v", F.when(sky, F.col("v")))
    steps = [F.lead("_v").over(Window.partitionBy(*keys, a).orderBy(b)) - F.col("_v") for a, b in (("y", "x"), ("x", "y"))]
    diffs = kept.select(*keys, steps[0].alias("_d")).unionByName(kept.select(*keys, steps[1].alias("_d"))).filter("_d IS NOT NULL")
    d = diffs.withColumn("_m", F.median("_d").over(Window.partitionBy(*keys)))
    return d.groupBy(*keys).agg((F.median(F.abs(F.col("_d") - F.col("_m"))) / (0.6745 * 2**0.5)).alias("sky_sigma"))


def psf_anisotropy(stars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median elongation of the stars (a, b, theta) and the spread of their directions."""
    a, b = F.col("a"), F.col("b")
    agg = stars.groupBy(*keys).agg(
        F.median((a * a - b * b) / (a * a + b * b)).alias("ellipticity"), F.avg(F.sin(2 * F.col("theta"))).alias("_s"), F.avg(F.cos(2 * F.col("theta"))).alias("_c")
    )
    r = F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c"))
    scatter = F.degrees(F.sqrt(-2 * F.log(F.greatest(r, F.lit(1e-12))))) / 2
    kind = F.when(F.col("ellipticity") < 0.15, "round").when(F.col("_sc") < 20, "tracking").otherwise("optical")
    return agg.withColumn("_sc", scatter).select(*keys, "ellipticity", F.col("_sc").alias("scatter"), kind.alias("kind"))


def gray_locus(fluxes: DataFrame, keys: Sequence[str], rounds: int = 3) -> DataFrame:
    """White-balance scales from star colours: clipped medians of the channel fractions."""
    total = F.col("r") + F.col("g") + F.col("b")
    s = fluxes.filter((F.col("r") > 0) & (F.col("g") > 0) & (F.col("b") > 0))
    s = s.select(*keys, (F.col("r") / total).alias("fr"), (F.col("g") / total).alias("fg"), (F.col("b") / total).alias("fb")).withColumn("_k", F.lit(True))
    w = Window.partitionBy(*keys)
    for _ in range(rounds):
        inside = F.col("_k")
        for top in ("fr", "fb"):
            ratio = F.col(top) / F.col("fg")
            s = s.withColumn(f"_q{top}", ratio).withColumn(f"_m{top}", F.median(F.when(F.col("_k"), ratio)).over(w))
            s = s.withColumn(f"_s{top}", MAD_SCALE * F.median(F.when(F.col("_k"), F.abs(F.col(f"_q{top}") - F.col(f"_m{top}")))).over(w))
            inside = inside & ((F.col(f"_s{top}") < 1e-12) | (F.abs(F.col(f"_q{top}") - F.col(f"_m{top}")) < 3 * F.col(f"_s{top}")))
        s = s.withColumn("_i", inside).withColumn("_n", F.count(F.when(F.col("_i"), 1)).over(w))
        s = s.withColumn("_k", F.when(F.col("_n") >= 5, F.col("_i")).otherwise(F.col("_k")))
    medians = s.filter("_k").groupBy(*keys).agg(*[F.median(c).alias(c) for c in ("fr", "fg", "fb")], F.count(F.lit(1)).alias("n_stars"))
    return medians.select(*keys, (F.col("fg") / F.col("fr")).alias("scale_r"), F.lit(1.0).alias("scale_g"), (F.col("fg") / F.col("fb")).alias("scale_b"), "n_stars")


def validate(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reason why a frame cannot be used, or null."""
    bad = F.isnan("v") | F.col("v").isNull() | (F.abs("v") == float("inf"))
    w = Window.partitionBy(*keys)
    s = px.withColumn("_top", F.max("v").over(w))
    agg = s.groupBy(*keys).agg(
        F.count(F.when(bad, 1)).alias("bad"), F.stddev_pop("v").alias("sd"), F.avg((F.col("v") == F.col("_top")).cast("double")).alias("top"),
        F.avg((F.col("v") == 0).cast("double")).alias("zero"), F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("_p"),
    )
    reason = (
        F.when(F.col("bad") > 0, "not finite").when(F.col("sd") < 0.1, "constant").when(F.col("top") > 0.95, "saturated").when(F.col("zero") > 0.5, "mostly zero")
        .when(F.col("_p")[1] - F.col("_p")[0] < 10, "low dynamic range")
    )
    return agg.select(*keys, reason.alias("reason"))
