"""Registered queries of the pixelwise image operators and the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import scalars as S
from skyfold.operators import combine as C
from skyfold.operators import pixelwise as P
from skyfold.plans.frames import PLAIN_SQL
from skyfold.plans.stacking import PIXELS_SQL, _rounded
from skyfold.plans.tables import pixels, table

FRAME = ["session", "frame_id"]
PIXEL = [*FRAME, "y", "x"]


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mean(pixels(spark, sf_dir, False), ["session", "y", "x"]).select("session", "y", "x", F.col("value").alias("v"))


def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames over a dark and a flat made of sessions 0 and 1."""
    px = pixels(spark, sf_dir)
    dark = C.median(px.filter("session = 0"), ["y", "x"]).withColumn("value", F.col("value") / 100)
    flat = P.flat_norm(C.median(px.filter("session = 1"), ["y", "x"]))
    return _rounded(P.calibrate(px.filter("session > 1"), dark, flat, 0.5).select(*PIXEL, "v"), "v")


def green_equalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.green_equalize(pixels(spark, sf_dir, False), FRAME), "v")


def bayer_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.bayer_orientation(pixels(spark, sf_dir, False), FRAME, 1.02), "ratio", places=5)


def phase_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.phase_offsets(pixels(spark, sf_dir, False), FRAME), "v")


def hot_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = C.mean(pixels(spark, sf_dir), ["y", "x"])
    return _rounded(P.hot_pixels(master, 1.0), "value")


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir, False).select(*PIXEL, (F.col("x") % 3).cast("int").alias("c"), "v")


def gray_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.gray_world(_channels(spark, sf_dir), FRAME), "v")


def white_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.white_patch(_channels(spark, sf_dir), FRAME), "v")


def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.normalise(pixels(spark, sf_dir), FRAME), "v", places=6)


def sky_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.sky_floor(pixels(spark, sf_dir), FRAME), "v")


def sky_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.sky_floor(pixels(spark, sf_dir), FRAME, clip=False), "v")


def pedestal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.pedestal(pixels(spark, sf_dir, False).withColumn("v", F.col("v") - 990), FRAME), "v")


def gradient_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.gradient_plane(pixels(spark, sf_dir), FRAME), "v")


def stack_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.stack_snr(pixels(spark, sf_dir), FRAME), "snr")


def hdr_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _means(spark, sf_dir).filter("session = 2").drop("session").withColumn("k", F.lit(1))
    short = _means(spark, sf_dir).filter("session = 3").drop("session").withColumn("k", F.lit(1)).withColumn("v", F.col("v") / 8)
    return _rounded(P.hdr_blend(long, short, ["k"]).select("y", "x", "v"), "v")


def comet_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars, comet = (_means(spark, sf_dir).filter(F.col("session") == s).drop("session").withColumn("k", F.lit(1)) for s in (4, 5))
    return _rounded(P.comet_blend(stars, comet, ["k"], 3.0, 4.0, 1.5).select("y", "x", "v"), "v")


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions 0 to 3 as image channels, pivoted by one aggregation."""
    m = _means(spark, sf_dir)
    return m.groupBy("y", "x").agg(*[F.max(F.when(F.col("session") == s, F.col("v"))).alias(n) for s, n in enumerate(("l", "r", "g", "b"))])


def lrgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.lrgb(_bands(spark, sf_dir), 1.2), "l", "r", "g", "b")


def narrowband(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six palettes of one band stack."""
    bands = _bands(spark, sf_dir).select("y", "x", F.col("r").alias("ha"), F.col("g").alias("oiii"), F.col("b").alias("sii"))
    out = None
    for name in sorted(P.PALETTES):
        one = P.narrowband(bands, name).withColumn("palette", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return _rounded(out, "r", "g", "b")


def patch_weighted_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    grid = px.groupBy("frame_id", F.floor(F.col("y") / 4).cast("int").alias("gy"), F.floor(F.col("x") / 4).cast("int").alias("gx")).agg((1 / (1 + F.var_pop("v"))).alias("w"))
    return _rounded(P.patch_weighted(px, grid, ["session", "y", "x"], "frame_id", 4, 2), "value")


def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = P.normalise(pixels(spark, sf_dir, False), FRAME)
    v = F.col("v")
    return _rounded(
        px.select(*PIXEL, S.hyperbolic_stretch(v, 0.0, 1.0, 5.0, 0.2).alias("ghs"), S.arcsinh_stretch(v, F.lit(0.02)).alias("arcsinh"), S.linear_rescale(v, F.lit(0.1), F.lit(0.9)).alias("linear"), S.soft_threshold(v - 0.5, 0.1).alias("soft")), "ghs", "arcsinh", "linear", "soft", places=6
    )


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bands(spark, sf_dir)
    r, g, bl = F.col("r"), F.col("g"), F.col("b")
    y, cb, cr = S.ycbcr(r, g, bl)
    r2, g2, b2 = S.rgb(y, cb, cr)
    return _rounded(b.select("y", "x", y.alias("lum"), cb.alias("cb"), cr.alias("cr"), S.scnr(g, r, bl, 0.8).alias("scnr"), F.greatest(F.abs(r2 - r), F.abs(g2 - g), F.abs(b2 - bl)).alias("loss")), "lum", "cb", "cr", "scnr", "loss")


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    f = table(spark, sf_dir, "embeddings")
    angle = S.rotation_degrees(e(0), e(1))
    wcs = S.tan_wcs(180 + 100 * e(0), 100 * e(1), F.lit(2.0), F.lit(1.5), F.lit(3000.0), F.lit(2000.0), angle)
    px, py = S.sky_to_pixel(180 + 100 * e(0), 100 * e(1), 180.0, 10.0, 0.01, 1500.0, 1000.0)
    shown = f.select("vec_id", angle.alias("angle"), S.circular_difference(angle, F.lit(170.0)).alias("turn"), S.compass(angle).alias("compass"), S.magnitude_to_flux(5 + 10 * e(2)).alias("flux"), S.moffat(F.abs(10 * e(3)), 100.0, 2.0, 2.5).alias("moffat"), S.gaussian(10 * e(3), 100.0, 2.0).alias("gauss"), (wcs["CD1_1"] * 1e6).alias("cd11"), (wcs["CD2_1"] * 1e6).alias("cd21"), px.alias("px"), py.alias("py"))
    return _rounded(shown, "angle", "turn", "flux", "moffat", "gauss", "cd11", "cd21", "px", "py", places=4)


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, identifiers and slugs out of page addresses."""
    p = table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1))
    name = F.concat(F.lit("ngc  00"), F.regexp_extract("path", r"(\d+)", 1))
    file, index = S.virtual_frame(F.concat(F.lit("/data/a.ser::"), F.col("page_id").cast("string")))
    return p.select("page_id", S.folder_label(F.col("path")).alias("label"), S.normalize_id(name).alias("catalog_id"), S.slug(F.col("url")).alias("slug"), S.hms(F.col("page_id") * 3661.5).alias("hms"), file.alias("file"), index.alias("frame_index"), S.strip_date(F.concat(F.lit("M51_2026-07-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))).alias("stem"), F.size(S.catalog_ids(F.concat(F.lit("see NGC 7000, M31 and ic 342 "), F.col("path")))).alias("n_ids"))


def frame_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of frames from names, header types and exposures."""
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("/n/"), F.when(F.col("p_partkey") % 7 == 0, "Dark_").when(F.col("p_partkey") % 7 == 1, "flat_").otherwise("img_"), F.col("p_partkey").cast("string"), F.lit(".fits"))
    kind = S.classify_frame(path, F.when(F.col("p_size") == 3, "BIAS"), F.col("p_size") % 5)
    return p.select("p_partkey", kind.alias("frame_type"), S.object_type(F.col("p_name")).alias("object_type"))


def event_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON headers coerced to numbers, with spans of time per user."""
    e = table(spark, sf_dir, "events")
    header = F.from_json("props", "map<string,string>")
    k = S.header_number(header, "GAIN", "k")
    return e.withColumn("k", k).groupBy("user_id").agg(F.count("k").alias("n"), F.round(F.avg("k"), 6).alias("gain"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("first"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm").alias("last"))


def running_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of a session's accumulated mean over its frames in order."""
    from pyspark.sql import Window

    f = pixels(spark, sf_dir, False).groupBy("session", "frame_id").agg(F.avg("v").alias("m"))
    w = Window.partitionBy("session").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    return _rounded(f.select("session", "frame_id", F.avg("m").over(w).alias("running"), F.count("m").over(w).alias("frames")), "running")


QUERIES = {
    q.__name__: q
    for q in (
        calibrate, green_equalize, bayer_orientation, phase_offsets, hot_pixels, gray_world, white_patch, normalise, sky_floor, sky_normalise, pedestal, gradient_plane, stack_snr, hdr_blend, comet_blend, lrgb, narrowband, patch_weighted_stack, stretches, colours, angles, page_names, frame_classes, event_header, running_snr,
    )
}

_W = "(PARTITION BY session, frame_id)"
_MEANS_SQL = f"{PLAIN_SQL}, mean AS (SELECT session, y, x, avg(v) AS v FROM px GROUP BY ALL)"
_BANDS_SQL = f"{_MEANS_SQL}, bands AS (SELECT y, x, max(v) FILTER (session = 0) AS l, max(v) FILTER (session = 1) AS r, max(v) FILTER (session = 2) AS g, max(v) FILTER (session = 3) AS b FROM mean GROUP BY y, x)"
_CFA = "CASE (y % 2) * 2 + x % 2 WHEN 0 THEN 'R' WHEN 1 THEN 'G1' WHEN 2 THEN 'G2' ELSE 'B' END"
_NORM_SQL = "q AS (SELECT *, quantile_cont(v, 0.001) OVER w AS lo, quantile_cont(v, 0.999) OVER w AS hi FROM px WINDOW w AS (PARTITION BY session, frame_id)), norm AS (SELECT session, frame_id, y, x, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (greatest(least(v, hi), lo) - lo) / (hi - lo) END AS v FROM q)"


def _sky_sql(clip: bool) -> str:
    parts = [PIXELS_SQL, "k0 AS (SELECT *, TRUE AS k FROM px)"]
    for i in range(3):
        parts.append(f"a{i} AS (SELECT *, median(v) FILTER (k) OVER w AS m, stddev_pop(v) FILTER (k) OVER w AS d FROM k{i} WINDOW w AS {_W})")
        parts.append(f"k{i + 1} AS (SELECT session, frame_id, y, x, v, k AND abs(v - m) < 2.5 * greatest(d, 1e-9) AS k FROM a{i})")
    parts.append(f"z AS (SELECT *, median(v) FILTER (k) OVER {_W} AS m FROM k3)")
    v = "greatest(CASE WHEN m > 0 THEN v - m ELSE v END, 0)" if clip else "v - m"
    return "WITH " + ", ".join(parts) + f" SELECT session, frame_id, y, x, round({v}, 3) AS v FROM z"


def _asinh(x: str) -> str:
    return f"(sign({x}) * ln(abs({x}) + sqrt(({x}) * ({x}) + 1)))"


_LADDER = "CASE " + " ".join(f"WHEN {_asinh(f'0.02 * {f}')} / {_asinh(f'{f}.0')} >= 0.15 THEN {_asinh(f'v * {f}')} / {_asinh(f'{f}.0')}" for f in (3, 5, 10, 20, 50)) + f" ELSE {_asinh('v * 100')} / {_asinh('100.0')} END"
_PALETTE_SQL = " UNION ALL ".join(f"SELECT y, x, round({r}, 3) AS r, round({g}, 3) AS g, round({b}, 3) AS b, '{n}' AS palette FROM nb" for n, (r, g, b) in sorted(P.PALETTES.items()))

ORACLE_SQL = {
    "calibrate": f"""WITH {PIXELS_SQL}, d AS (SELECT y, x, median(v) / 100 AS d FROM px WHERE session = 0 GROUP BY y, x), f0 AS (SELECT y, x, median(v) AS f FROM px WHERE session = 1 GROUP BY y, x),
        f AS (SELECT y, x, greatest(least(f / (SELECT median(f) FROM f0), 2.5), 0.4) AS f FROM f0) SELECT session, frame_id, y, x, round(greatest((v - d * 0.5) / f, 0), 3) AS v FROM px JOIN d USING (y, x) JOIN f USING (y, x) WHERE session > 1""",
    "green_equalize": f"""WITH {PLAIN_SQL}, c AS (SELECT *, {_CFA} AS c FROM px), k AS (SELECT *, median(v) FILTER (c = 'G1') OVER {_W} / median(v) FILTER (c = 'G2') OVER {_W} AS k FROM c)
        SELECT session, frame_id, y, x, round(CASE WHEN c = 'G2' AND abs(k - 1) < 0.2 THEN v * k ELSE v END, 3) AS v FROM k""",
    "bayer_orientation": f"""WITH {PLAIN_SQL}, c AS (SELECT *, {_CFA} AS c FROM px), g AS (SELECT session, frame_id, median(v) FILTER (c = 'G1') AS g1, median(v) FILTER (c = 'G2') AS g2 FROM c GROUP BY ALL),
        r AS (SELECT *, greatest(g1, g2) / greatest(least(g1, g2), 1e-12) AS ratio FROM g) SELECT session, frame_id, round(ratio, 5) AS ratio, CASE WHEN ratio > 1.02 THEN 'flipped' ELSE 'as given' END AS orientation FROM r""",
    "phase_offsets": f"""WITH {PLAIN_SQL}, m AS (SELECT *, median(v) OVER (PARTITION BY session, frame_id, y % 2, x % 2) AS m FROM px), o AS (SELECT *, max(m) OVER {_W} - min(m) OVER {_W} AS s, m - avg(m) OVER {_W} AS o FROM m)
        SELECT session, frame_id, y, x, round(CASE WHEN s BETWEEN 0.01 AND 100 THEN v - o ELSE v END, 3) AS v FROM o""",
    "hot_pixels": f"""WITH {PIXELS_SQL}, d AS (SELECT y, x, avg(v) AS value FROM px GROUP BY y, x), m AS (SELECT *, median(value) OVER () AS m, stddev_pop(value) OVER () AS sd FROM d), s AS (SELECT *, 1.4826 * median(abs(value - m)) OVER () AS s FROM m)
        SELECT y, x, round(value, 3) AS value FROM s WHERE value > m + 1.0 * CASE WHEN s < 1e-12 THEN sd ELSE s END""",
    "gray_world": f"""WITH {PLAIN_SQL}, c AS (SELECT *, CAST(x % 3 AS INTEGER) AS c FROM px), m AS (SELECT session, frame_id, c, avg(v) AS m FROM c GROUP BY ALL), k AS (SELECT *, avg(m) OVER {_W} / greatest(m, 1e-9) AS k FROM m)
        SELECT session, frame_id, y, x, c, round(greatest(v * k, 0), 3) AS v FROM c JOIN k USING (session, frame_id, c)""",
    "white_patch": f"""WITH {PLAIN_SQL}, c AS (SELECT *, CAST(x % 3 AS INTEGER) AS c FROM px), m AS (SELECT session, frame_id, c, quantile_cont(v, 0.995) AS m FROM c GROUP BY ALL), k AS (SELECT *, avg(m) OVER {_W} / greatest(m, 1e-9) AS k FROM m)
        SELECT session, frame_id, y, x, c, round(greatest(v * k, 0), 3) AS v FROM c JOIN k USING (session, frame_id, c)""",
    "normalise": f"WITH {PIXELS_SQL}, {_NORM_SQL} SELECT session, frame_id, y, x, round(v, 6) AS v FROM norm",
    "sky_floor": _sky_sql(True),
    "sky_normalise": _sky_sql(False),
    "pedestal": f"""WITH {PLAIN_SQL}, a AS (SELECT session, frame_id, y, x, v - 990 AS v FROM px), m AS (SELECT *, median(v) OVER {_W} AS m FROM a), s AS (SELECT *, 1.4826 * median(abs(v - m)) OVER {_W} AS s FROM m)
        SELECT session, frame_id, y, x, round(v + greatest(8 * s - m, 0), 3) AS v FROM s""",
    "gradient_plane": f"""WITH {PIXELS_SQL}, c AS (SELECT *, y - avg(y) OVER {_W} AS cy, x - avg(x) OVER {_W} AS cx, v - avg(v) OVER {_W} AS cv FROM px),
        s AS (SELECT *, sum(cy * cy) OVER {_W} AS yy, sum(cx * cx) OVER {_W} AS xx, sum(cy * cx) OVER {_W} AS yx, sum(cy * cv) OVER {_W} AS yv, sum(cx * cv) OVER {_W} AS xv FROM c)
        SELECT session, frame_id, y, x, round(greatest(v - (yv * xx - xv * yx) / (yy * xx - yx * yx) * cy - (xv * yy - yv * yx) / (yy * xx - yx * yx) * cx, 0), 3) AS v FROM s""",
    "stack_snr": f"""WITH {PIXELS_SQL}, m AS (SELECT *, median(v) OVER {_W} AS m, quantile_cont(v, 0.999) OVER {_W} AS p FROM px), s AS (SELECT *, greatest(1.4826 * median(abs(v - m)) OVER {_W}, 1e-6) AS s FROM m),
        a AS (SELECT session, frame_id, count(*) FILTER (v > m + 5 * s) AS n, avg(v) FILTER (v > m + 5 * s) AS a, any_value(p) AS p, any_value(m) AS m, any_value(s) AS s FROM s GROUP BY ALL)
        SELECT session, frame_id, round((CASE WHEN n >= 5 THEN a ELSE p END - m) / s, 3) AS snr FROM a""",
    "hdr_blend": f"""WITH {_MEANS_SQL}, j AS (SELECT a.y, a.x, a.v AS l, b.v / 8 AS s FROM mean a JOIN mean b USING (y, x) WHERE a.session = 2 AND b.session = 3), k AS (SELECT *, avg(l) OVER () / greatest(avg(s) OVER (), 1e-9) AS k, quantile_cont(l, 0.98) OVER () AS p FROM j),
        m AS (SELECT *, greatest(least((l - 0.9 * p) / (0.2 * p), 1), 0) AS m FROM k) SELECT y, x, round(l * (1 - m) + s * k * m, 3) AS v FROM m""",
    "comet_blend": f"""WITH {_MEANS_SQL}, j AS (SELECT a.y, a.x, a.v AS a, b.v AS b, exp(-((a.y - 3.0) ** 2 + (a.x - 4.0) ** 2) / (2 * 1.5 * 1.5)) AS m FROM mean a JOIN mean b USING (y, x) WHERE a.session = 4 AND b.session = 5) SELECT y, x, round(a * (1 - m) + b * m, 3) AS v FROM j""",
    "lrgb": f"""WITH {_BANDS_SQL}, k AS (SELECT *, l / greatest(0.299 * r + 0.587 * g + 0.114 * b, 1e-9) AS k FROM bands) SELECT y, x, round(l, 3) AS l, round(greatest(l + (r * k - l) * 1.2, 0), 3) AS r, round(greatest(l + (g * k - l) * 1.2, 0), 3) AS g, round(greatest(l + (b * k - l) * 1.2, 0), 3) AS b FROM k""",
    "narrowband": f"WITH {_BANDS_SQL}, nb AS (SELECT y, x, r AS ha, g AS oiii, b AS sii FROM bands) {_PALETTE_SQL}",
    "patch_weighted_stack": f"""WITH {PIXELS_SQL}, grid AS (SELECT frame_id, CAST(y // 4 AS INTEGER) AS gy, CAST(x // 4 AS INTEGER) AS gx, 1 / (1 + var_pop(v)) AS w FROM px GROUP BY ALL),
        c AS (SELECT *, greatest(least((y + 0.5) / 4 - 0.5, 1), 0) AS py, greatest(least((x + 0.5) / 4 - 0.5, 1), 0) AS px FROM px),
        k AS (SELECT c.*, a, b, least(floor(py) + a, 1)::INTEGER AS gy, least(floor(px) + b, 1)::INTEGER AS gx, (CASE WHEN a = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE WHEN b = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS share FROM c, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b))
        SELECT session, y, x, round(sum(share * w * v) / greatest(sum(share * w), 1e-12), 3) AS value FROM k JOIN grid USING (frame_id, gy, gx) GROUP BY session, y, x""",
    "stretches": f"""WITH {PLAIN_SQL}, {_NORM_SQL} SELECT session, frame_id, y, x, round(CASE WHEN v <= 0 THEN 0 WHEN v >= 1 THEN 1 ELSE ({_asinh('5 * (v - 0.2)')} - {_asinh('-1.0')}) / ({_asinh('4.0')} - {_asinh('-1.0')}) END, 6) AS ghs,
        round({_LADDER}, 6) AS arcsinh, round(greatest(least((v - 0.1) / (0.9 - 0.1), 1), 0), 6) AS linear, round(sign(v - 0.5) * greatest(abs(v - 0.5) - 0.1, 0), 6) + 0.0 AS soft FROM norm""",
    "colours": f"""WITH {_BANDS_SQL}, l AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS lum FROM bands) SELECT y, x, round(lum, 3) AS lum, round((b - lum) * 0.564, 3) AS cb, round((r - lum) * 0.713, 3) AS cr, round(greatest(g * (1 - 0.8) + least(g, (r + b) / 2) * 0.8, 0), 3) AS scnr, 0.0::DOUBLE AS loss FROM l""",
    "angles": """WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings), t AS (SELECT *, degrees(atan2(b, a)) AS angle FROM e),
        p AS (SELECT *, radians(100 * b) AS de, radians(180 + 100 * a - 180) AS ra, radians(10.0) AS d0, radians(angle) AS th FROM t), q AS (SELECT *, sin(d0) * sin(de) + cos(d0) * cos(de) * cos(ra) AS cc, angle - 170 + 180 AS u FROM p)
        SELECT vec_id, round(angle, 4) AS angle, round((u - 360 * floor(u / 360)) - 180, 4) AS turn, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[((round(angle / 45)::INTEGER % 8 + 8) % 8) + 1] AS compass, round(pow(10, -0.4 * (5 + 10 * c)), 4) AS flux,
        round(100 * pow(1 + (abs(10 * d) / 2) * (abs(10 * d) / 2), -2.5), 4) AS moffat, round(100 * exp(-0.5 * (10 * d / 2) * (10 * d / 2)), 4) AS gauss, round(-2.0 / 3000 * cos(th) * 1e6, 4) AS cd11, round(-2.0 / 3000 * sin(th) * 1e6, 4) AS cd21,
        round(1500 - degrees(cos(de) * sin(ra) / cc) / 0.01, 4) AS px, round(1000 + degrees((cos(d0) * sin(de) - sin(d0) * cos(de) * cos(ra)) / cc) / 0.01, 4) AS py FROM q""",
    "page_names": r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
        SELECT page_id, string_split(path, '/')[-2] AS label, 'NGC ' || ltrim(regexp_extract(path, '(\d+)', 1), '0') AS catalog_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
        printf('%02d:%02d:%02d', (page_id * 3661.5)::DOUBLE::BIGINT // 3600, (floor(page_id * 3661.5)::BIGINT // 60) % 60, floor(page_id * 3661.5)::BIGINT % 60) AS hms, '/data/a.ser' AS file, page_id::INTEGER AS frame_index, 'M51' AS stem, 3 AS n_ids FROM p""",
    "frame_classes": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'dark' WHEN p_partkey % 7 = 1 THEN 'flat' WHEN p_size = 3 THEN 'bias' WHEN p_size % 5 = 0 THEN 'bias' ELSE 'light' END AS frame_type,
        CASE WHEN contains(p_name, 'glob') THEN 'globular' WHEN contains(p_name, 'cl') OR contains(p_name, 'opc') THEN 'star_field' WHEN contains(p_name, 'pn') THEN 'planetary' WHEN contains(p_name, 'hii') OR contains(p_name, 'snr') OR contains(p_name, 'em') THEN 'emission'
        WHEN contains(p_name, 'rne') OR contains(p_name, 'ref') THEN 'reflection' WHEN contains(p_name, 'g') THEN 'galaxy' ELSE 'unknown' END AS object_type FROM part""",
    "event_header": """SELECT user_id, count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS n, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS gain, strftime(min(ts), '%Y-%m-%d %H:%M') AS "first", strftime(max(ts), '%Y-%m-%d %H:%M') AS "last" FROM events GROUP BY user_id""",
    "running_snr": f"""WITH {PLAIN_SQL}, f AS (SELECT session, frame_id, avg(v) AS m FROM px GROUP BY ALL) SELECT session, frame_id, round(avg(m) OVER w, 3) AS running, count(*) OVER w AS frames FROM f WINDOW w AS (PARTITION BY session ORDER BY frame_id ROWS UNBOUNDED PRECEDING)""",
}
