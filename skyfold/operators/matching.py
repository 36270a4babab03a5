"""Joins: calibration matching, stars by distance, equal-distance pairs, cones, catalogues, resumes and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_darks(lights: DataFrame, darks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Darks that suit each group's lights best; all ties at the top score stay.

    Both sides have iso, exptime, dims and temp. The lights' profile is the majority of iso, rounded exposure and dims (ties by
    smallest) and the mean temperature.
    """
    def majority(c: Column, name: str) -> DataFrame:
        n = lights.groupBy(*keys, c.alias(name)).count()
        return n.groupBy(*keys).agg(F.min_by(name, F.struct(-F.col("count"), F.col(name))).alias(f"l_{name}"))

    profile = lights.groupBy(*keys).agg(F.avg("temp").alias("l_temp"))
    for name, c in (("iso", F.col("iso")), ("exptime", F.bround("exptime", 1)), ("dims", F.col("dims"))):
        profile = profile.join(majority(c, name), list(keys))
    d = darks.join(profile, list(keys))
    dt, de = F.abs(F.col("temp") - F.col("l_temp")), F.abs(F.col("exptime") - F.col("l_exptime"))
    score = (
        F.when(F.col("dims") != F.col("l_dims"), -1000).otherwise(0)
        + F.when(F.col("iso") == F.col("l_iso"), 100).otherwise(-100)
        + F.when(dt <= 1, 30).when(dt <= 3, 15).when(dt <= 7, 5).otherwise(-30)
        + F.when(de < 0.5, 10).when(de < 0.5 * F.col("l_exptime"), 5).otherwise(0)
    )
    scored = d.withColumn("score", score).withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("score"))))
    return scored.filter("_r = 1").select(*darks.columns, "score")


def match_flats(lights: DataFrame, flats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flats that suit each group's lights best by filter and dims; all ties at the top score stay.

    Both sides have filter and dims; the lights' profile is their majority (ties by smallest). A null filter counts as an
    empty one, which neither agrees nor differs, and a flat without dims is not held against them. Letter case is ignored.
    """
    def majority(c: Column, name: str) -> DataFrame:
        n = lights.groupBy(*keys, c.alias(name)).count()
        return n.groupBy(*keys).agg(F.min_by(name, F.struct(-F.col("count"), F.col(name))).alias(f"l_{name}"))

    own = F.coalesce("filter", F.lit(""))
    profile = majority(own, "filter").join(majority(F.col("dims"), "dims"), list(keys))
    score = F.when(F.col("dims") != F.col("l_dims"), -1000).otherwise(0) + F.when((own == "") | (F.col("l_filter") == ""), 0).when(F.lower(own) == F.lower("l_filter"), 50).otherwise(-50)
    scored = flats.join(profile, list(keys)).withColumn("score", score)
    best = scored.withColumn("_m", F.max("score").over(Window.partitionBy(*keys)))
    return best.filter("score = _m").select(*flats.columns, "score")


def _neighbours(c: Column, size: float) -> Column:
    cell = F.floor(c / size).cast("int")
    return F.array(cell - 1, cell, cell + 1)


def nearest_stars(stars: DataFrame, reference: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """For each star (y, x) the nearest reference star (ry, rx) of its group within the radius, by grid cells of that size."""
    near = reference.withColumn("_cy", F.explode(_neighbours(F.col("ry"), radius))).withColumn("_cx", F.explode(_neighbours(F.col("rx"), radius)))
    own = stars.withColumns({"_cy": F.floor(F.col("y") / radius).cast("int"), "_cx": F.floor(F.col("x") / radius).cast("int")})
    joined = own.join(near, [*keys, "_cy", "_cx"]).withColumn("_d2", (F.col("y") - F.col("ry")) ** 2 + (F.col("x") - F.col("rx")) ** 2).filter(F.col("_d2") <= radius * radius)
    by = [c for c in stars.columns]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_d2", "ry", "rx"))
    return joined.withColumn("_r", rank).filter("_r = 1").select(*by, "ry", "rx", F.sqrt("_d2").alias("distance"))


def star_pairs(stars: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Pairs of a frame's `most` brightest stars with their distance; `star` is the brightness rank."""
    top = stars.filter(F.col("star") <= most)
    a = top.select(*keys, F.col("star").alias("a"), F.col("y").alias("ay"), F.col("x").alias("ax"))
    b = top.select(*keys, F.col("star").alias("b"), F.col("y").alias("by"), F.col("x").alias("bx"))
    d = F.sqrt((F.col("ay") - F.col("by")) ** 2 + (F.col("ax") - F.col("bx")) ** 2)
    return a.join(b, list(keys)).filter("a < b").withColumn("length", d)


def equal_distance_pairs(pairs: DataFrame, reference: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Band join of pairs (length) with reference pairs (r_length) of their group whose lengths differ by `tolerance` at most."""
    wide = reference.withColumn("_b", F.explode(_neighbours(F.col("r_length"), tolerance)))
    own = pairs.withColumn("_b", F.floor(F.col("length") / tolerance).cast("int"))
    return own.join(wide, [*keys, "_b"]).filter(F.abs(F.col("length") - F.col("r_length")) <= tolerance).drop("_b")


def separation(ra: Column, dec: Column, ra0: Column, dec0: Column) -> Column:
    """Great-circle distance in degrees."""
    s = F.sin(F.radians(dec - dec0) / 2) ** 2 + F.cos(F.radians(dec)) * F.cos(F.radians(dec0)) * F.sin(F.radians(ra - ra0) / 2) ** 2
    return F.degrees(2 * F.asin(F.least(F.sqrt(s), F.lit(1.0))))


def cone_search(catalog: DataFrame, cones: DataFrame, radius: float) -> DataFrame:
    """Catalogue rows (ra, dec) within the radius of each cone (cone, ra0, dec0), by declination bands of the radius."""
    bands = cones.withColumn("_b", F.explode(_neighbours(F.col("dec0"), radius)))
    own = catalog.withColumn("_b", F.floor(F.col("dec") / radius).cast("int"))
    found = own.join(bands, "_b").withColumn("separation", separation(F.col("ra"), F.col("dec"), F.col("ra0"), F.col("dec0")))
    return found.filter(F.col("separation") <= radius).drop("_b", "ra0", "dec0")


def same_paths(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: how many paths stand on one side alone, and whether a saved state can be resumed."""
    left, right = a.select(column).distinct(), b.select(column).distinct()
    only = left.exceptAll(right).unionByName(right.exceptAll(left))
    return only.agg(F.count(F.lit(1)).alias("differing")).withColumn("can_resume", F.col("differing") == 0)


def restore_state(frames: DataFrame, state: DataFrame, path: str) -> DataFrame:
    """Frames with what an earlier run saved for their path."""
    return frames.join(state, path, "left")


def unseen(frames: DataFrame, seen: DataFrame, path: str) -> DataFrame:
    return frames.join(seen.select(path), path, "left_anti")


def merge_stacks(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two stacks (keys, value, frames) by frame count; a pixel that one side lacks comes from the other."""
    joined = a.select(*keys, F.col("value").alias("_a"), F.col("frames").alias("_na")).join(b.select(*keys, F.col("value").alias("_b"), F.col("frames").alias("_nb")), list(keys), "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = zero("_na") + zero("_nb")
    return joined.select(*keys, ((zero("_na") * F.coalesce("_a", F.lit(0.0)) + zero("_nb") * F.coalesce("_b", F.lit(0.0))) / n).alias("value"), n.alias("frames"))


def merge_guard(a: DataFrame, b: DataFrame, keys: Sequence[str], pixels: int, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one of each `by`: overlap and correlation of two stacks, and whether they may be merged (25 % overlap, correlation 0.15)."""
    keys = [*by, *keys]
    both = a.select(*keys, F.col("value").alias("_a")).join(b.select(*keys, F.col("value").alias("_b")), keys)
    s = both.groupBy(*by).agg((F.count(F.lit(1)) / pixels).alias("overlap"), F.corr("_a", "_b").alias("correlation"))
    return s.withColumn("allowed", (F.col("overlap") >= 0.25) & (F.col("correlation") >= 0.15))


def mosaic(panels: DataFrame, height: int, width: int) -> DataFrame:
    """Panels (panel, y, x, v, oy, ox) on one grid: feathered weights fall towards each panel's edges."""
    sky = F.percentile("v", F.lit(0.5)).over(Window.partitionBy("panel"))
    edge = F.least(F.col("y") + 1, F.lit(height) - F.col("y"), F.col("x") + 1, F.lit(width) - F.col("x")).cast("double")
    w = panels.withColumn("_v", F.col("v") - sky).withColumn("_w", edge)
    return w.groupBy((F.col("y") + F.col("oy")).alias("gy"), (F.col("x") + F.col("ox")).alias("gx")).agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("value"), F.count(F.lit(1)).alias("panels"))
