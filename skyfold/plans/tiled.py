"""Registered queries of the tile stacks and of matched calibration, over the frame table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.operators import tiles as T
from skyfold.plans import calibration, neighbourhood, post, stacking
from skyfold.plans.files import shared_folder
from skyfold.plans.live import _stream
from skyfold.plans.run import StackPlan
from skyfold.plans.stacking import PIXELS_SQL, _rounded
from skyfold.plans.tables import SIDE, table
from skyfold.streaming import tile_stack as L
from skyfold.streaming.session import Masters


def _stack(method: str, **params: object):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = T.stack_frames(neighbourhood.frames(spark, sf_dir), ["session"], "frame_id", method, **params)
        return _rounded(T.to_pixels(found, ["session"]), "value").select("session", "y", "x", "value", "n_used", "n_rejected")

    return query


def tile_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality-weighted mean by tiles; the weights are the live stack's."""
    f = neighbourhood.frames(spark, sf_dir).withColumn("weight", 0.5 + (F.col("frame_id") % 10) / 10.0)
    return _rounded(T.to_pixels(T.stack_frames(f, ["session"], "frame_id", "mean", "weight"), ["session"]), "value").select("session", "y", "x", "value", "n_used")


def live_tile_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that arrive in two batches, folded into per-tile states; every frame lies on the same grid."""
    e = _stream(spark, sf_dir, "embeddings", "vec_id")
    data = F.expr("transform(embedding, (e, p) -> 1000 + 1000 * cast(e as double) + CASE WHEN (vec_id * 7 + p) % 53 = 0 THEN 5000.0D ELSE 0.0D END)")
    stream = e.select(F.col("label").cast("long").alias("session"), F.col("vec_id").alias("frame_id"), F.col("vec_id").alias("seq"), F.lit(0).alias("channel"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(1.0).alias("exposure"), data.alias("data"))
    found = L.to_pixels(L.advance(spark, stream, Masters(), StackPlan(clean=()), shared_folder(spark, "tile-stack"), register=False))
    return _rounded(found.select(F.col("session").cast("int").alias("session"), "y", "x", "value", F.col("n_used").alias("n")), "value")


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames as lights (half of them), darks and flats (a quarter each) with exposures, sensitivities, temperatures and filters."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"))
    i = F.col("frame_id")
    step = lambda n: F.floor(i / n)
    kind = F.element_at(F.array(F.lit("light"), F.lit("dark"), F.lit("light"), F.lit("flat")), (i % 4 + 1).cast("int"))
    exposure = F.when(kind == "flat", 1.0).otherwise(F.when(step(4) % 2 == 0, 30.0).otherwise(60.0))
    header = F.create_map(
        F.lit("EXPTIME"), exposure.cast("string"), F.lit("ISOSPEED"), F.when(step(8) % 2 == 0, "800").otherwise("1600"),
        F.lit("CCD-TEMP"), (i % 5 - 10).cast("string"), F.lit("FILTER"), F.when(step(16) % 2 == 0, "Ha").otherwise("OIII"),
    )
    sizes = e.select("frame_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))
    return calibration.settings(e.select("frame_id", kind.alias("frame_type"), header.alias("header")), sizes)


def _chosen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Settings (light_group, iso, exptime, filter) of the groups, and their calibration frames."""
    about = _settings(spark, sf_dir)
    grouped, chosen = calibration.matched(about)
    names = about.filter("frame_type = 'light'").join(grouped.select("frame_id", "light_group"), "frame_id").groupBy("light_group").agg(F.first("iso").alias("iso"), F.first("exptime").alias("exptime"), F.first("filter").alias("filter"))
    return names, chosen


def calibration_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The darks and flats that suit each group of lights best."""
    names, chosen = _chosen(spark, sf_dir)
    return chosen.join(names, "light_group").select(names["iso"], names["exptime"], "filter", "kind", "frame_id")


def matched_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median masters of each group's matching frames, by tiles."""
    names, chosen = _chosen(spark, sf_dir)
    frames = neighbourhood.frames(spark, sf_dir).drop("session").join(chosen.select("light_group", "kind", "frame_id"), "frame_id")
    found = T.to_pixels(T.stack_frames(frames, ["light_group", "kind"], "frame_id", "median"), ["light_group", "kind"])
    return _rounded(found.join(names, "light_group").select("iso", "exptime", "filter", "kind", "y", "x", "value", F.col("n_used").alias("frames")), "value")


def post_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's clipped stack through a stored post-processing plan, with the reasons of refused steps."""
    planes = T.to_planes(T.stack_frames(neighbourhood.frames(spark, sf_dir), ["session"], "frame_id", "sigma_clip"), ["session"])
    images = planes.select("session", F.lit(1).alias("channels"), "height", "width", "data")
    steps = ("hot_pixels", "saturated", "flatten", "chroma", "cascade", "sharpen", "reduce_stars", "local_contrast")
    done, said = post.run_chain(spark, images, ["session"], steps, shared_folder(spark, "post-plan"))
    refused = said.groupBy("session").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("skipped").isNotNull(), F.concat("applied", F.lit(": "), "skipped")))), "; ").alias("refused"))
    px = done.join(refused, "session").select("session", "refused", F.posexplode("data").alias("p", "v"))
    return _rounded(px.select("session", F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).cast("int").alias("x"), "v", "refused"), "v")


_METHODS = ("median", "sigma_clip", "winsorized", "percentile", "linear_fit", "trimmed_mean", "esd")
QUERIES = {f"tile_{m}": _stack(m) for m in _METHODS} | {q.__name__: q for q in (tile_weighted_mean, live_tile_stack, calibration_sets, matched_masters, post_plan)}

_SETS_SQL = """about AS (SELECT vec_id AS frame_id, ['light', 'dark', 'light', 'flat'][1 + vec_id % 4] AS kind, CASE WHEN vec_id % 4 = 3 THEN 1.0 WHEN vec_id // 4 % 2 = 0 THEN 30.0 ELSE 60.0 END::DOUBLE AS exptime,
        CASE WHEN vec_id // 8 % 2 = 0 THEN '800' ELSE '1600' END AS iso, vec_id % 5 - 10 AS temp, CASE WHEN vec_id // 16 % 2 = 0 THEN 'Ha' ELSE 'OIII' END AS filter FROM embeddings),
    g AS (SELECT iso, exptime, filter, avg(temp) AS t FROM about WHERE kind = 'light' GROUP BY iso, exptime, filter),
    scored AS (SELECT g.iso, g.exptime, g.filter, c.kind, c.frame_id, CASE WHEN c.kind = 'flat' THEN CASE WHEN c.filter = g.filter THEN 50 ELSE -50 END
        ELSE CASE WHEN c.iso = g.iso THEN 100 ELSE -100 END + CASE WHEN abs(c.temp - t) <= 1 THEN 30 WHEN abs(c.temp - t) <= 3 THEN 15 WHEN abs(c.temp - t) <= 7 THEN 5 ELSE -30 END
            + CASE WHEN abs(c.exptime - g.exptime) < 0.5 THEN 10 WHEN abs(c.exptime - g.exptime) < 0.5 * g.exptime THEN 5 ELSE 0 END END AS score FROM g JOIN about c ON c.kind <> 'light'),
    chosen AS (SELECT iso, exptime, filter, kind, frame_id FROM (SELECT *, max(score) OVER (PARTITION BY iso, exptime, filter, kind) AS top FROM scored) WHERE score = top)"""
ORACLE_SQL = {f"tile_{m}": stacking.ORACLE_SQL[f"stack_{m}"] for m in _METHODS} | {
    "tile_weighted_mean": f"WITH {PIXELS_SQL} SELECT session, y, x, round(sum((0.5 + (frame_id % 10) / 10.0::DOUBLE) * v) / sum(0.5 + (frame_id % 10) / 10.0::DOUBLE), 3) AS value, count(*) AS n_used FROM px GROUP BY session, y, x",
    "live_tile_stack": f"SELECT session, y, x, value, n_used AS n FROM ({stacking.ORACLE_SQL['stack_online_clip']})",
    "calibration_sets": f"WITH {_SETS_SQL} SELECT * FROM chosen",
    "matched_masters": f"WITH {PIXELS_SQL}, {_SETS_SQL} SELECT iso, exptime, filter, kind, y, x, round(median(v), 3) AS value, count(*) AS frames FROM chosen JOIN px USING (frame_id) GROUP BY ALL",
}
