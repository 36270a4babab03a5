"""Registered queries of the star-shape metrics, photometry and rotation-free matching."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.functions import kernels as K
from skyfold.functions import stars as T
from skyfold.operators import image_ops as I
from skyfold.operators import metrics as M
from skyfold.plans.frames import PLAIN_SQL, SHIFTS_SQL, shifts
from skyfold.plans.neighbourhood import KEYS, frames
from skyfold.plans.stacking import PIXELS_SQL, _rounded
from skyfold.plans.tables import pixels


def star_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak sharpness, modes and detail entropy of each frame."""
    def measure(a: np.ndarray) -> list[tuple]:
        found = K.detect_stars(a, k=3.0, border=2)
        width = K.measure_fwhm(a, found, 2)
        z = T.zernike(a, found, 2)
        return [(T.strehl(a, found, width, 2), z["rms"], z["defocus"], z["astig"], z["coma"], T.wavelet_entropy_ratio(a))]

    names = ("strehl", "zernike_rms", "zernike_defocus", "zernike_astig", "zernike_coma", "wavelet_entropy_ratio")
    return _rounded(I.flat_map_frames(frames(spark, sf_dir), KEYS, dict.fromkeys(names, "double"), measure), *names)


def channel_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance between the colours' centroids of debayered frames."""
    def measure(a: np.ndarray) -> list[tuple]:
        rgb = K.debayer_bilinear(a)
        return [(T.dispersion(rgb, K.detect_stars(rgb[..., 1], k=3.0, border=2), 2),)]

    return _rounded(I.flat_map_frames(frames(spark, sf_dir), KEYS, {"dispersion": "double"}, measure), "dispersion")


def aperture_photometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars joined to their frame's pixels within the aperture and the ring."""
    px = pixels(spark, sf_dir)
    stars = M.local_maxima(px, KEYS, 3.0).select(*KEYS, "star", F.col("y").alias("sy"), F.col("x").alias("sx"))
    d2 = (F.col("y") - F.col("sy")) ** 2 + (F.col("x") - F.col("sx")) ** 2
    near = stars.join(px, KEYS).withColumn("d2", d2)
    inner, ring = F.col("d2") <= 2, (F.col("d2") >= 6) & (F.col("d2") <= 14)
    agg = near.groupBy(*KEYS, "star").agg(F.sum(F.when(inner, F.col("v"))).alias("s"), F.count(F.when(inner, 1)).alias("n"), F.median(F.when(ring, F.col("v"))).alias("sky"))
    return _rounded(agg.select(*KEYS, "star", (F.col("s") - F.col("n") * F.coalesce("sky", F.lit(0.0))).alias("flux")), "flux")


def blind_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation-free match of each frame's stars with its session's first frame, one group of a frame's bounded stars a task row."""
    stars = M.local_maxima(pixels(spark, sf_dir), KEYS, 1.0).filter("star <= 10")
    listed = stars.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("star", "y", "x"))).alias("own"))
    first = listed.groupBy("session").agg(F.min_by("own", "frame_id").alias("ref"))
    joined = listed.join(F.broadcast(first), "session")  # one row a session; by key, a session's frames would be one task's

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for own, ref in zip(batch.column("own").to_pylist(), batch.column("ref").to_pylist(), strict=True):
                src, dst = (np.array([(s["y"], s["x"]) for s in side], float) for side in (own, ref))
                m, n = T.rigid_from_pairs(src, dst, 0.6, least=3) if min(len(src), len(dst)) >= 2 else (np.eye(3), 0)
                out.append((n, float(np.degrees(np.arctan2(m[1, 0], m[0, 0]))), float(m[0, 2]), float(m[1, 2])))
            yield pa.RecordBatch.from_arrays([batch.column("session"), batch.column("frame_id"), pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[i] for o in out], pa.float64()) for i in (1, 2, 3))], names=["session", "frame_id", "inliers", "rotation", "dy", "dx"])

    return _rounded(joined.mapInArrow(run, "session int, frame_id long, inliers int, rotation double, dy double, dx double"), "rotation", "dy", "dx")


def field_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane through the star fluxes of each session's field, by sums alone, with the growth towards the corners."""
    stars = M.local_maxima(pixels(spark, sf_dir, False), KEYS, 1.0)
    w = Window.partitionBy("session")
    s = stars.select("session", (F.col("y") / 8.0 - 0.5).alias("y"), (F.col("x") / 8.0 - 0.5).alias("x"), "flux")
    s = s.withColumns({"cy": F.col("y") - F.avg("y").over(w), "cx": F.col("x") - F.avg("x").over(w), "cf": F.col("flux") - F.avg("flux").over(w)})
    a = s.groupBy("session").agg(*[F.sum(F.col(p) * F.col(q)).alias(n) for n, p, q in (("yy", "cy", "cy"), ("xx", "cx", "cx"), ("yx", "cy", "cx"), ("yf", "cy", "cf"), ("xf", "cx", "cf"))], F.corr(F.sqrt(F.col("y") ** 2 + F.col("x") ** 2), "flux").alias("radial"), F.count(F.lit(1)).alias("n"))
    det = F.col("yy") * F.col("xx") - F.col("yx") ** 2
    return _rounded(a.select("session", "n", ((F.col("yf") * F.col("xx") - F.col("xf") * F.col("yx")) / det).alias("tilt_y"), ((F.col("xf") * F.col("yy") - F.col("yf") * F.col("yx")) / det).alias("tilt_x"), "radial"), "tilt_y", "tilt_x", "radial")


def component_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame weights from powers of the normalised signal, width and star count."""
    f = shifts(spark, sf_dir).select(*KEYS, F.abs("score").alias("snr"), (2 + F.abs("dy") / 10).alias("fwhm"), (1 + F.floor(F.abs("dx"))).alias("stars"))
    w = Window.partitionBy("session")
    held = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.01))
    inverse = 1 / F.greatest("fwhm", F.lit(0.5))
    f = f.withColumn("_i", inverse).withColumn("_w", F.pow(held(F.col("snr") / F.max("snr").over(w)), F.lit(1.5)) * F.pow(held(F.col("_i") / F.max("_i").over(w)), F.lit(2.0)) * F.pow(held(F.col("stars") / F.max("stars").over(w)), F.lit(0.5)))
    return _rounded(f.select(*KEYS, F.sqrt(F.col("_w") / F.greatest(F.max("_w").over(w), F.lit(1e-9))).alias("weight")), "weight", places=6)


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistency of each session's frames: distinct sizes, spread of levels and a status."""
    px = pixels(spark, sf_dir)
    f = px.groupBy(*KEYS).agg(F.avg("v").alias("level"), F.count("v").alias("n"))
    s = f.groupBy("session").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("n").alias("sizes"), (F.max("level") - F.min("level")).alias("spread"))
    status = F.when(F.col("sizes") > 1, "mixed sizes").when(F.col("spread") > 250, "uneven levels").when(F.col("frames") < 10, "few frames").otherwise("good")
    return _rounded(s.withColumn("status", status), "spread")


QUERIES = {q.__name__: q for q in (star_shapes, channel_dispersion, aperture_photometry, blind_match, field_tilt, component_weights, health_report)}

_NB = "SELECT a.session, a.frame_id, a.y, a.x, any_value(a.v) AS v, max(b.v) AS around FROM px a JOIN px b ON a.session = b.session AND a.frame_id = b.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) GROUP BY ALL"
_STAR = "m0 AS (SELECT *, median(v) OVER (PARTITION BY session, frame_id) AS md FROM px), m1 AS (SELECT session, frame_id, any_value(md) AS md, greatest(1.4826 * median(abs(v - md)), 1e-6) AS s FROM m0 GROUP BY ALL)"

ORACLE_SQL = {
    "aperture_photometry": f"""WITH {PIXELS_SQL}, {_STAR}, nb AS ({_NB}), st AS (SELECT nb.session, nb.frame_id, y AS sy, x AS sx, CAST(row_number() OVER (PARTITION BY nb.session, nb.frame_id ORDER BY v - md DESC, y, x) AS INTEGER) AS star FROM nb JOIN m1 USING (session, frame_id) WHERE v > around AND v > md + 3 * s),
        d AS (SELECT st.session, st.frame_id, star, v, (y - sy) ** 2 + (x - sx) ** 2 AS d2 FROM st JOIN px USING (session, frame_id)),
        a AS (SELECT session, frame_id, star, sum(v) FILTER (d2 <= 2) AS s, count(*) FILTER (d2 <= 2) AS n, median(v) FILTER (d2 BETWEEN 6 AND 14) AS sky FROM d GROUP BY ALL) SELECT session, frame_id, star, round(s - n * coalesce(sky, 0), 3) AS flux FROM a""",
    "field_tilt": f"""WITH {PLAIN_SQL}, {_STAR}, nb AS ({_NB}), st AS (SELECT nb.session, y / 8.0::DOUBLE - 0.5 AS y, x / 8.0::DOUBLE - 0.5 AS x, v - md AS f FROM nb JOIN m1 USING (session, frame_id) WHERE v > around AND v > md + 1.0 * s),
        c AS (SELECT *, y - avg(y) OVER w AS cy, x - avg(x) OVER w AS cx, f - avg(f) OVER w AS cf FROM st WINDOW w AS (PARTITION BY session)),
        a AS (SELECT session, sum(cy * cy) AS yy, sum(cx * cx) AS xx, sum(cy * cx) AS yx, sum(cy * cf) AS yf, sum(cx * cf) AS xf, corr(sqrt(y * y + x * x), f) AS radial, count(*) AS n FROM c GROUP BY session)
        SELECT session, n, round((yf * xx - xf * yx) / (yy * xx - yx * yx), 3) AS tilt_y, round((xf * yy - yf * yx) / (yy * xx - yx * yx), 3) AS tilt_x, round(radial, 3) AS radial FROM a""",
    "component_weights": f"""WITH {SHIFTS_SQL}, f AS (SELECT session, frame_id, abs(score) AS snr, 1 / greatest(2 + abs(dy) / 10, 0.5) AS i, 1 + floor(abs(dx)) AS stars FROM sh),
        w AS (SELECT *, pow(greatest(least(snr / max(snr) OVER p, 1), 0.01), 1.5) * pow(greatest(least(i / max(i) OVER p, 1), 0.01), 2) * pow(greatest(least(stars / max(stars) OVER p, 1), 0.01), 0.5) AS w FROM f WINDOW p AS (PARTITION BY session))
        SELECT session, frame_id, round(sqrt(w / greatest(max(w) OVER (PARTITION BY session), 1e-9)), 6) AS weight FROM w""",
    "health_report": f"""WITH {PIXELS_SQL}, f AS (SELECT session, frame_id, avg(v) AS level, count(*) AS n FROM px GROUP BY ALL), s AS (SELECT session, count(*) AS frames, count(DISTINCT n) AS sizes, max(level) - min(level) AS spread FROM f GROUP BY session)
        SELECT session, frames, sizes, round(spread, 3) AS spread, CASE WHEN sizes > 1 THEN 'mixed sizes' WHEN spread > 250 THEN 'uneven levels' WHEN frames < 10 THEN 'few frames' ELSE 'good' END AS status FROM s""",
}
