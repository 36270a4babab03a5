"""Frame selection: the quality gate, registration outliers, reference frames, crops, dither and target classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quality_gate(frames: DataFrame, keys: Sequence[str], stages: Sequence[str] = ("hard_limit", "statistical", "percentile"), sigma: float = 2.5, threshold: float = 50.0) -> DataFrame:
    """Adds accepted and reject_reason to frames with snr, star_count, contrast, dynamic_range and score.

    Three stages in order, each over the survivors of the one before: hard limits; at least two of three metrics `sigma`
    deviations from their group (of more than three frames); a score more than `threshold` percent below the group's 90th
    percentile (ten frames or more) or maximum.
    """
    w = Window.partitionBy(*keys)
    f = frames.withColumn("_r", F.lit(None).cast("string"))
    if "hard_limit" in stages:
        f = f.withColumn("_r", F.when(F.col("star_count") == 0, "no stars detected").when(F.col("snr") < 0.5, "extremely low SNR").when(F.col("contrast") < 2, "extremely low contrast").when(F.col("dynamic_range") < 20, "extremely low dynamic range"))
    if "statistical" in stages:
        alive = F.col("_r").isNull()
        f = f.withColumn("_n", F.count(F.when(alive, 1)).over(w))
        names = ("snr", "star_count", "contrast")
        f = f.withColumns({f"_m{c}": F.avg(F.when(alive, F.col(c))).over(w) for c in names} | {f"_s{c}": F.stddev_pop(F.when(alive, F.col(c))).over(w) for c in names})
        out = [F.when(F.col(f"_s{c}") < 1e-6, 0).when(F.abs((F.col(c) - F.col(f"_m{c}")) / F.col(f"_s{c}")) < sigma, 0).otherwise(1) for c in names]
        f = f.withColumn("_o", out[0] + out[1] + out[2])
        f = f.withColumn("_r", F.when(F.col("_r").isNull() & (F.col("_n") > 3) & (F.col("_o") >= 2), "statistical outlier").otherwise(F.col("_r")))
    if "percentile" in stages:
        score = F.when(F.col("_r").isNull(), F.col("score"))
        f = f.withColumns({"_n": F.count(score).over(w), "_p": F.percentile(score, F.lit(0.9)).over(w), "_x": F.max(score).over(w)})
        ref = F.when(F.col("_n") >= 10, F.col("_p")).otherwise(F.col("_x"))
        low = (ref > 1e-6) & (F.col("score") < ref * (1 - threshold / 100))
        f = f.withColumn("_r", F.when(F.col("_r").isNull() & low, "score below reference").otherwise(F.col("_r")))
    return f.select(*frames.columns, F.col("_r").isNull().alias("accepted"), F.col("_r").alias("reject_reason"))


def reason_category(reason: Column) -> Column:
    """Coarse class of a rejection reason; the order of the tests counts."""
    has = lambda *words: F.greatest(*[reason.contains(x).cast("int") for x in words], F.lit(0)) == 1
    return (
        F.when(has("score"), "Below quality threshold").when(has("outlier"), "Statistical outlier").when(has("brightness", "contrast", "dynamic", "noise"), "Poor quality")
        .when(has("star"), "No stars detected").when(has("load", "empty"), "Load/data errors").when(reason.isNotNull(), "Other")
    )


def shift_outliers(frames: DataFrame, keys: Sequence[str], sigma: float = 3.5) -> DataFrame:
    """Adds shift_ok: the shift's magnitude is within the group's robust limit."""
    w = Window.partitionBy(*keys)
    f = frames.withColumn("_g", F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))).withColumn("_m", F.median("_g").over(w))
    f = f.withColumn("_s", F.greatest(1.4826 * F.median(F.abs(F.col("_g") - F.col("_m"))).over(w), F.lit(1.0)))
    return f.select(*frames.columns, (F.col("_g") <= F.col("_m") + sigma * F.col("_s")).alias("shift_ok"))


def common_crop(frames: DataFrame, keys: Sequence[str], height: int, width: int, margin: int = 2) -> DataFrame:
    """Region that every shifted frame of a group covers."""
    edge = lambda c, most: F.least(F.greatest(c, F.lit(0)), F.lit(most)).cast("int")
    agg = frames.groupBy(*keys).agg(F.max("dy").alias("y1"), F.min("dy").alias("y0"), F.max("dx").alias("x1"), F.min("dx").alias("x0"))
    top, left = edge(F.ceil(F.greatest(F.col("y1"), F.lit(0.0))) + margin, height), edge(F.ceil(F.greatest(F.col("x1"), F.lit(0.0))) + margin, width)
    bottom, right = edge(height + F.floor(F.least(F.col("y0"), F.lit(0.0))) - margin, height), edge(width + F.floor(F.least(F.col("x0"), F.lit(0.0))) - margin, width)
    crop = agg.select(*keys, top.alias("_t"), bottom.alias("_b"), left.alias("_l"), right.alias("_r"))
    empty = (F.col("_t") >= F.col("_b")) | (F.col("_l") >= F.col("_r"))
    return crop.select(*keys, F.when(empty, 0).otherwise(F.col("_t")).alias("top"), F.when(empty, height).otherwise(F.col("_b")).alias("bottom"), F.when(empty, 0).otherwise(F.col("_l")).alias("left"), F.when(empty, width).otherwise(F.col("_r")).alias("right"))


def dither(frames: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Pattern of a group's shifts: aligned, dithered or drifting."""
    w = Window.partitionBy(*keys).orderBy(order)
    f = frames.withColumn("_g", F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")))
    f = f.withColumns({"_y": F.col("dy") - F.lag("dy").over(w), "_x": F.col("dx") - F.lag("dx").over(w)})
    f = f.withColumns({"_py": F.lag("_y").over(w), "_px": F.lag("_x").over(w)})
    far = F.col("_g") > 0.5
    angle = F.atan2("dy", "dx")
    lagged = lambda c, p, s: F.when(F.col(s) > 1e-6, F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    a = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_g").alias("mean_magnitude"), F.countDistinct(F.rint("dy"), F.rint("dx")).alias("unique_positions"),
        F.count(F.when(far, 1)).alias("_nf"), F.avg(F.when(far, F.sin(angle))).alias("_s"), F.avg(F.when(far, F.cos(angle))).alias("_c"),
        F.corr("_py", "_y").alias("_cy"), F.corr("_px", "_x").alias("_cx"), F.stddev_pop("_y").alias("_sy"), F.stddev_pop("_x").alias("_sx"),
    )
    spread = F.degrees(F.sqrt(-2 * F.log(F.greatest(F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c")), F.lit(1e-12)))))
    a = a.withColumn("direction_spread", F.when(F.col("_nf") >= 3, spread).otherwise(0.0))
    a = a.withColumn("autocorrelation", F.when(F.col("n") >= 4, (lagged("_cx", "_px", "_sx") + lagged("_cy", "_py", "_sy")) / 2).otherwise(0.0))
    random_direction, independent = F.col("direction_spread") > 40, F.abs("autocorrelation") < 0.5
    pattern = (
        F.when((F.col("n") < 3) | (F.col("mean_magnitude") < 1), "aligned")
        .when(random_direction & independent & (F.col("unique_positions") >= F.col("n") * 0.5), "dithered")
        .when(~random_direction | ~independent, "tracking_drift").otherwise("dithered")
    )
    return a.select(*keys, "n", "mean_magnitude", "unique_positions", "direction_spread", "autocorrelation", pattern.alias("pattern"), (pattern == "dithered").alias("is_dithered"))


def geometric_median(points: DataFrame, keys: Sequence[str], rounds: int = 10) -> DataFrame:
    """Weiszfeld's iteration from the mean, unrolled over one partitioning: (keys, gy, gx)."""
    w = Window.partitionBy(*keys)
    p = points.withColumns({"_gy": F.avg("dy").over(w), "_gx": F.avg("dx").over(w)})
    for _ in range(rounds):
        d = F.greatest(F.sqrt((F.col("dy") - F.col("_gy")) ** 2 + (F.col("dx") - F.col("_gx")) ** 2), F.lit(1e-9))
        p = p.withColumn("_w", 1 / d)
        p = p.withColumns({"_gy": F.sum(F.col("dy") * F.col("_w")).over(w) / F.sum("_w").over(w), "_gx": F.sum(F.col("dx") * F.col("_w")).over(w) / F.sum("_w").over(w)})
    return p.groupBy(*keys).agg(F.first("_gy").alias("gy"), F.first("_gx").alias("gx"))


def reference_frame(frames: DataFrame, keys: Sequence[str], frame: str, centrality: float = 0.3) -> DataFrame:
    """Frame with the best mix of score and closeness to the shifts' geometric median; ties go to the smaller frame."""
    w = Window.partitionBy(*keys)
    f = frames.join(geometric_median(frames, keys), list(keys))
    f = f.withColumn("_d", F.sqrt((F.col("dy") - F.col("gy")) ** 2 + (F.col("dx") - F.col("gx")) ** 2))
    mixed = (1 - centrality) * F.col("score") / F.greatest(F.max("score").over(w), F.lit(1e-9)) + centrality * (1 - F.col("_d") / F.greatest(F.max("_d").over(w), F.lit(1e-9)))
    best = f.withColumn("_q", F.round(mixed, 9)).groupBy(*keys).agg(F.max_by(frame, F.struct("_q", -F.col(frame))).alias(frame), F.max("_q").alias("quality"))
    return best


def consensus_reference(frames: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """Frame closest to the median shift."""
    w = Window.partitionBy(*keys)
    f = frames.withColumns({"_my": F.median("dy").over(w), "_mx": F.median("dx").over(w)})
    d = (F.col("dy") - F.col("_my")) ** 2 + (F.col("dx") - F.col("_mx")) ** 2
    return f.withColumn("_d", d).groupBy(*keys).agg(F.min_by(frame, F.struct("_d", frame)).alias(frame))


#: Anchors of the target classes on the signal axes (fill, diffuse, peak, concentration), fixed values of the advisor.
def classify_target(fill: Column, diffuse: Column, peak: Column, stars: Column) -> Column:
    """Target class from ordered thresholds on a session's signals."""
    return (
        F.when((peak > 0.8) & (stars > 500), "globular").when((fill > 0.6) & (diffuse < 0.2), "wide_field").when((peak > 0.6) & (diffuse > 0.3), "planetary")
        .when((stars > 200) & (diffuse < 0.15), "star_field").when(diffuse > 0.5, "emission").when((diffuse > 0.25) & (peak > 0.3), "galaxy").when(diffuse > 0.15, "reflection").otherwise("unknown")
    )


def blend_weights(signals: DataFrame, anchors: Sequence[tuple], keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Weights of the anchor presets (name, place on each axis) for each signal row: 1 / (distance + 0.05)^2, normalised."""
    table = F.array(*[F.struct(F.lit(name).alias("preset"), *[F.lit(float(x)).alias(f"_{axis}") for axis, x in zip(axes, place, strict=True)]) for name, *place in anchors])
    joined = signals.withColumn("_a", F.explode(table)).select(*keys, *axes, "_a.*")
    d = F.sqrt(sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in axes), F.lit(0.0)))
    raw = joined.withColumn("_w", 1 / (d + 0.05) ** 2)
    return raw.select(*keys, "preset", (F.col("_w") / F.sum("_w").over(Window.partitionBy(*keys))).alias("weight"))
