"""Registered queries of the corrections: vignette maps, local surfaces, colour repairs, session rules, merged headers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import kernels as K
from skyfold.functions import restore as R
from skyfold.operators import corrections as O
from skyfold.operators import image_ops as I
from skyfold.operators import metrics as M
from skyfold.operators import targets as T
from skyfold.plans.imaging import _BANDS_SQL, _bands
from skyfold.plans.neighbourhood import KEYS, _around, frames
from skyfold.plans.stacking import PIXELS_SQL, _rounded
from skyfold.plans.tables import SIDE, pixels, table


def vignette_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(O.vignette_map(pixels(spark, sf_dir), "session", "frame_id", 2, 1), "value")


def vignette_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame less the map that all sessions share."""
    px = pixels(spark, sf_dir)
    whole = O.spread_grid(O.vignette_map(px, "session", "frame_id", 2, 1), (), SIDE, SIDE, 2)
    return _rounded(O.subtract_map(px, whole), "v")


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = T.background_samples(pixels(spark, sf_dir), KEYS, 2).select(*KEYS, F.col("py").alias("cy"), F.col("px").alias("cx"), "level")
    return O.local_surface(samples, KEYS, (SIDE // 2, SIDE // 2), 1.0, 2)


def background_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local planes through every frame's background samples, with one robust round."""
    return _rounded(_surface(spark, sf_dir), "value")


def background_local_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame less its background surface over that surface's median."""
    grid = _surface(spark, sf_dir)
    level = grid.groupBy(*KEYS).agg(F.median("value").alias("_m"))
    over = grid.join(level, KEYS).withColumn("value", F.col("value") - F.col("_m"))
    return _rounded(O.subtract_map(pixels(spark, sf_dir), O.spread_grid(over, KEYS, SIDE, SIDE, 2), KEYS), "v")


def border_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(O.border_level(pixels(spark, sf_dir), KEYS, SIDE, SIDE, least=2), "level", "spread")


def star_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands' bright places, desaturated and recoloured by another image."""
    b = _bands(spark, sf_dir).select("y", "x", *[(F.col(c) / 2000).alias(c) for c in "rgb"], *[(F.col(s) / 1500).alias(f"s{c}") for c, s in zip("rgb", "lrg", strict=True)], ((F.col("l") - 950) / 100).alias("mask"))
    grey, other = O.fix_stars(b, 0.8), O.fix_stars(b, 0.8, ("sr", "sg", "sb"))
    return _rounded(grey.select("y", "x", "r", "g", "b", F.lit("grey").alias("mode")).unionByName(other.select("y", "x", "r", "g", "b", F.lit("stars").alias("mode"))), "r", "g", "b", places=6)


def level_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("c", (F.col("x") % 3).cast("int"))
    return _rounded(O.level_planes(px, KEYS), "v")


def _colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as three planes: the frame, its mirror image and its rows from below."""
    f = frames(spark, sf_dir)
    lines = lambda a: F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.slice(a, i * SIDE + 1, SIDE))
    return f.select(*KEYS, "height", "width", F.col("data").alias("r"), F.reverse("data").alias("g"), F.flatten(F.reverse(lines(F.col("data")))).alias("b"))


def chroma_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chroma smoothing of colour frames with a narrow Gaussian."""
    return _rounded(O.colour_pixels(O.map_colour(_colour(spark, sf_dir), KEYS, lambda a: R.reduce_chroma(a, 1.0)), KEYS), "r", "g", "b")


def neutral_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes flattened by their smooth level outside bright places and lifted to one median."""
    kernel = lambda a: R.neutralise(a, (R.luminance(a) > np.median(R.luminance(a)) + 500).astype(float), 1.0)
    return _rounded(O.colour_pixels(O.map_colour(_colour(spark, sf_dir), KEYS, kernel), KEYS), "r", "g", "b")


def resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at 5 x 11 pixels."""
    return _rounded(I.to_pixels(I.map_frames(frames(spark, sf_dir), KEYS, lambda a: R.resize(a, 5, 11)), KEYS), "v")


def colour_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red and blue moved by the shift that each frame's planes show against green."""
    def kernel(a: np.ndarray) -> np.ndarray:
        return R.shift_planes(a, tuple(K.phase_shift(a[..., 1], a[..., c]) for c in (0, 2)))

    return _rounded(O.colour_pixels(O.map_colour(_colour(spark, sf_dir), KEYS, kernel), KEYS), "r", "g", "b")


def colour_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debayered frames through the colour steps in order."""
    # a file may be one row group, hence one task; a given number of partitions is not merged again by their few bytes
    mosaics = frames(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEYS)
    rgb = I.debayer_colour(mosaics, KEYS, "bilinear")

    def kernel(a: np.ndarray) -> np.ndarray:
        for step in ("hot_colour", "saturated", "halos", "chroma_wide", "neutralise"):
            a = O.COLOUR[step](a)
        return a

    return _rounded(O.colour_pixels(O.map_colour(rgb, KEYS, kernel), KEYS), "r", "g", "b")


def tail_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction in which each frame's brightest spot falls off."""
    def measure(a: np.ndarray) -> list[tuple]:
        y, x = np.unravel_index(a.argmax(), a.shape)
        return [(int(y), int(x), R.tail_angle(a, y, x, 5.0))]

    return _rounded(I.flat_map_frames(frames(spark, sf_dir), KEYS, {"y": "int", "x": "int", "angle": "double"}, measure), "angle")


def session_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over the sessions' signals."""
    m = M.pixel_metrics(pixels(spark, sf_dir), KEYS)
    s = m.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.median("snr").alias("snr"), (F.median("dynamic_range") / 2000).alias("fwhm"))
    s = s.withColumns({"strehl": (F.col("session") % 5) / 10.0, "dispersion": (F.col("session") % 4) * 1.1, "suited": F.col("session") / 10.0, "median_cascade": F.col("session") % 3 == 0, "wavelet": F.col("session") % 2 == 0, "tv": F.col("session") > 4})
    return _rounded(O.session_rules(s, explicit=("consensus",)), "snr", "fwhm", "strehl", "dispersion", "suited")


def usable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 4 == 0, F.element_at(F.array(*[F.lit(v) for v in ("Unknown", " dark", "N/A", "")]), (F.col("p_size") % 3 + 1).cast("int"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", O.usable_object(name).alias("usable"))


def setting_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the events' settings use, in the order they are first seen."""
    e = table(spark, sf_dir, "events").filter("props IS NOT NULL")
    fields = F.array_union(F.json_object_keys("props"), F.array(F.col("event_type")))
    return O.first_seen(e.select("event_id", fields.alias("f")), F.col("f"), F.col("event_id"))


def ordered_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://([^/]+)", 1).alias("host"), F.concat("url", F.lit("#"), "page_id").alias("path"))
    return O.ordered_outputs(p, ["host"], "path").select("page_id", "host", "place")


def merged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged headers of each kind of event, with its users' sessions as sources."""
    e = table(spark, sf_dir, "events")
    own = e.groupBy("event_type", F.concat(F.lit("user-"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("source")).agg(F.count(F.lit(1)).alias("frames"), F.sum(O.exposure_seconds(F.col("value") * 10)).alias("seconds"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _rounded(O.merged_headers(own, ["event_type"]).select("event_type", "frames", "seconds", stamp("first"), stamp("last"), "merged", "sources"), "seconds")


def event_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours between each user's last event and the last one of all."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    last = e.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return _rounded(last.select("user_id", O.age_hours(F.lit(now), F.col("ts")).alias("age")), "age", places=4)


QUERIES = {
    q.__name__: q
    for q in (
        vignette_map, vignette_correction, background_local, background_local_removed, border_level, star_colours, level_planes, chroma_noise, neutral_sky, resized, colour_shift, colour_chain, tail_angles, session_rules, usable_objects, setting_names, ordered_outputs, merged_headers, event_ages,
    )
}

_MAP = """b AS (SELECT session, frame_id, y // 2 AS cy, x // 2 AS cx, avg(v) AS v FROM px GROUP BY ALL), l AS (SELECT session, cy, cx, v - median(v) OVER (PARTITION BY session, frame_id) AS v FROM b),
    o AS (SELECT session, cy, cx, median(v) AS v FROM l GROUP BY ALL), m AS (SELECT CAST(cy AS INTEGER) AS cy, CAST(cx AS INTEGER) AS cx, median(v) AS value FROM o GROUP BY ALL)"""


def _spread(source: str, keys: str) -> str:
    """Values of a 4 x 4 grid at every pixel of 8 x 8."""
    share = lambda c: f"greatest(1 - abs(greatest(least(({c} + 0.5) / 2 - 0.5, 3), 0) - c{c}), 0)"
    return f"""SELECT {keys} y, x, sum(value * {share("y")} * {share("x")}) AS value FROM {source}, (SELECT unnest(generate_series(0, 7)) AS y) ys, (SELECT unnest(generate_series(0, 7)) AS x) xs GROUP BY ALL"""


_SAMPLES = """c AS (SELECT session, frame_id, CAST(y // 2 AS INTEGER) AS cy, CAST(x // 2 AS INTEGER) AS cx, v FROM px), cm AS (SELECT *, median(v) OVER (PARTITION BY session, frame_id, cy, cx) AS m FROM c),
    cs AS (SELECT *, greatest(1.4826 * median(abs(v - m)) OVER (PARTITION BY session, frame_id, cy, cx), 1e-6) AS s FROM cm), s0 AS (SELECT session, frame_id, cy, cx, median(v) FILTER (abs(v - m) <= 2.5 * s) AS level, 1.0::DOUBLE AS r FROM cs GROUP BY ALL)"""


def _plane(n: int) -> str:
    """Local planes f{n} through the samples s{n}, solved by elimination of the normal equations' slopes."""
    w = "s.r * exp(-0.5 * ((s.cy - g.cy) * (s.cy - g.cy) + (s.cx - g.cx) * (s.cx - g.cx))::DOUBLE)"
    return f"""a{n} AS (SELECT g.session, g.frame_id, g.cy, g.cx, s.level AS v, (s.cy - g.cy)::DOUBLE AS dy, (s.cx - g.cx)::DOUBLE AS dx, {w} AS w FROM s{n} g JOIN s{n} s ON s.session = g.session AND s.frame_id = g.frame_id AND abs(s.cy - g.cy) <= 2 AND abs(s.cx - g.cx) <= 2),
        b{n} AS (SELECT session, frame_id, cy, cx, sum(w) AS n, sum(w * dy) / sum(w) AS my, sum(w * dx) / sum(w) AS mx, sum(w * v) / sum(w) AS mv, sum(w * dy * dy) / sum(w) + 0.001 AS yy, sum(w * dy * dx) / sum(w) AS yx, sum(w * dx * dx) / sum(w) + 0.001 AS xx, sum(w * dy * v) / sum(w) AS yv, sum(w * dx * v) / sum(w) AS xv FROM a{n} GROUP BY ALL),
        e{n} AS (SELECT *, yy - my * my AS cyy, yx - my * mx AS cyx, xx - mx * mx AS cxx, yv - my * mv AS cyv, xv - mx * mv AS cxv FROM b{n}),
        f{n} AS (SELECT session, frame_id, cy, cx, mv - my * (cyv * cxx - cxv * cyx) / (cyy * cxx - cyx * cyx) - mx * (cxv * cyy - cyv * cyx) / (cyy * cxx - cyx * cyx) AS value FROM e{n})"""


_SURFACE = f"""{_SAMPLES}, {_plane(0)}, r0 AS (SELECT s0.session, s0.frame_id, s0.cy, s0.cx, level, level - value AS e FROM s0 JOIN f0 USING (session, frame_id, cy, cx)), r1 AS (SELECT *, median(e) OVER (PARTITION BY session, frame_id) AS m FROM r0),
    r2 AS (SELECT *, e / (4.685 * greatest(1.4826 * median(abs(e - m)) OVER (PARTITION BY session, frame_id), 1e-6)) AS u FROM r1), s1 AS (SELECT session, frame_id, cy, cx, level, CASE WHEN abs(u) < 1 THEN (1 - u * u) * (1 - u * u) ELSE 0 END AS r FROM r2), {_plane(1)}"""

_STAR = "sb AS (SELECT y, x, r / 2000 AS r, g / 2000 AS g, b / 2000 AS b, l / 1500 AS sr, r / 1500 AS sg, g / 1500 AS sb, greatest(least((l - 950) / 100, 1), 0) * 0.8 AS m FROM bands), sl AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS lum, greatest(0.299 * sr + 0.587 * sg + 0.114 * sb, 1e-4) AS slum FROM sb)"
_HELD = "round(greatest(least({}, 1), 0), 6)"
_RGB_SQL = f"{PIXELS_SQL}, rgb AS (SELECT a.session, a.frame_id, a.y, a.x, a.v AS r, b.v AS g, c.v AS b, 0.299 * a.v + 0.587 * b.v + 0.114 * c.v AS lum FROM px a JOIN px b ON b.session = a.session AND b.frame_id = a.frame_id AND b.y = 7 - a.y AND b.x = 7 - a.x JOIN px c ON c.session = a.session AND c.frame_id = a.frame_id AND c.y = 7 - a.y AND c.x = a.x)"
_G = "(exp(-0.5 * dy * dy) * exp(-0.5 * dx * dx))"
_W = "(PARTITION BY session, frame_id)"


def _chroma_sql() -> str:
    parts = [_RGB_SQL, "k0 AS (SELECT *, TRUE AS k FROM rgb)"]
    for i in range(5):
        parts.append(f"q{i} AS (SELECT *, median(lum) FILTER (k) OVER w AS m, stddev_pop(lum) FILTER (k) OVER w AS d FROM k{i} WINDOW w AS {_W})")
        parts.append(f"k{i + 1} AS (SELECT session, frame_id, y, x, r, g, b, lum, k AND abs(lum - m) <= 3 * d AS k FROM q{i})")
    parts.append(f"z AS (SELECT *, 1 - greatest(least((lum - median(lum) FILTER (k) OVER w) / greatest(3 * stddev_pop(lum) FILTER (k) OVER w, 1e-12), 1), 0) AS sky FROM k5 WINDOW w AS {_W})")
    for c in "rgb":
        parts.append(f"p{c} AS (SELECT session, frame_id, y, x, struct_pack(s := sky, c := ({c} - lum) * sky) AS v FROM z), n{c} AS ({_around(4, f'p{c}')}), t{c} AS (SELECT session, frame_id, y, x, sum({_G} * u.c) / greatest(sum({_G} * u.s), 1e-9) AS {c}s FROM n{c} GROUP BY ALL)")
    joins = " ".join(f"JOIN t{c} USING (session, frame_id, y, x)" for c in "rgb")
    cols = ", ".join(f"round(greatest(lum + ({c} - lum) * (1 - sky) + {c}s * sky, 0), 3) AS {c}" for c in "rgb")
    return "WITH " + ", ".join(parts) + f" SELECT session, frame_id, y, x, {cols} FROM z {joins}"


def _neutral_sql() -> str:
    parts = [_RGB_SQL, f"z AS (SELECT *, CASE WHEN lum > median(lum) OVER w + 500 THEN 0.0::DOUBLE ELSE 1 END AS sky, median(r) OVER w AS rm, median(g) OVER w AS gm, median(b) OVER w AS bm FROM rgb WINDOW w AS {_W})"]
    for c in "rgb":
        parts.append(f"p{c} AS (SELECT session, frame_id, y, x, struct_pack(s := sky, c := {c} * sky) AS v FROM z), n{c} AS ({_around(4, f'p{c}')}), t{c} AS (SELECT session, frame_id, y, x, sum({_G} * u.c) / sum({_G}) / (sum({_G} * u.s) / sum({_G}) + 1e-6) AS {c}s FROM n{c} GROUP BY ALL)")
    joins = " ".join(f"JOIN t{c} USING (session, frame_id, y, x)" for c in "rgb")
    cols = ", ".join(f"round(greatest({c} - {c}s + greatest(rm, gm, bm), 0), 3) AS {c}" for c in "rgb")
    return "WITH " + ", ".join(parts) + f" SELECT session, frame_id, y, x, {cols} FROM z {joins}"


def _rules_sql() -> str:
    base = f"""{PIXELS_SQL}, a AS (SELECT *, median(v) OVER (PARTITION BY session, frame_id) AS m FROM px), f AS (SELECT session, frame_id, (quantile_cont(v, 0.95) - any_value(m)) / greatest(1.4826 * median(abs(v - m)), 1e-6) AS snr, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS d FROM a GROUP BY ALL),
        s AS (SELECT session, count(*) AS n, median(snr) AS snr, median(d) / 2000 AS fwhm, (session % 5) / 10.0::DOUBLE AS strehl, (session % 4) * 1.1::DOUBLE AS dispersion, session / 10.0::DOUBLE AS suited, session % 3 = 0 AS mc0, session % 2 = 0 AS wv0, session > 4 AS tv0 FROM f GROUP BY session),
        t AS (SELECT *, suited > 0.5 AND snr >= 12 AND n >= 20 AS bm, snr > 0 AND snr < 5 AND NOT mc0 AND NOT wv0 AS ct0, CASE WHEN fwhm > 4 THEN least(15 + floor((fwhm - 3) * 3), 30)::INTEGER ELSE 15 END AS i1 FROM s),
        u AS (SELECT *, CASE WHEN strehl >= 0.15 AND strehl < 0.25 THEN greatest(i1 // 2, 8) ELSE i1 END AS i2 FROM t)"""
    off = "((strehl > 0 AND strehl < 0.15) OR dispersion > 3)"
    return f"""WITH {base} SELECT session, n, round(snr, 3) AS snr, round(fwhm, 3) AS fwhm, round(strehl, 3) AS strehl, round(dispersion, 3) AS dispersion, round(suited, 3) AS suited, CASE WHEN n < 8 THEN 'percentile' WHEN n < 15 THEN 'trimmed_mean' ELSE 'sigma_clip' END AS combine,
        CASE WHEN n >= 20 THEN 2.8::DOUBLE ELSE 3 END AS sigma, CASE WHEN n >= 20 THEN 4 ELSE 3 END AS iterations, FALSE AS consensus, NOT {off} AS deconvolve, tv0 AND NOT {off} AS tv,
        CASE WHEN dispersion > 1.5 AND dispersion <= 3 THEN greatest(floor(i2 * 0.6::DOUBLE)::INTEGER, 5) ELSE i2 END AS deconvolve_iterations, CASE WHEN tv0 AND snr > 0 AND snr < 8 THEN 40 WHEN tv0 AND snr > 20 THEN 70 ELSE 50 END AS tv_iterations,
        mc0 AND NOT bm AS median_cascade, CASE WHEN NOT mc0 OR snr <= 0 THEN 3::DOUBLE WHEN snr < 5 THEN 4 WHEN snr < 10 THEN 3.5 WHEN snr > 20 THEN 2 ELSE 3 END AS median_strength, wv0 AND NOT bm AND NOT mc0 AS wavelet, 3.0::DOUBLE AS wavelet_strength,
        ct0 AND NOT bm AS contrast, bm AS block_match, n >= 15 AND fwhm > 0 AS patch_weights, CASE WHEN n < 20 THEN 1::DOUBLE WHEN n < 60 THEN 2 ELSE 2.5 END AS black FROM u"""


ORACLE_SQL = {
    "vignette_map": f"WITH {PIXELS_SQL}, {_MAP} SELECT cy, cx, round(value, 3) AS value FROM m",
    "vignette_correction": f"WITH {PIXELS_SQL}, {_MAP}, g AS ({_spread('m', '')}) SELECT session, frame_id, y, x, round(v - value, 3) AS v FROM px JOIN g USING (y, x)",
    "background_local": f"WITH {PIXELS_SQL}, {_SURFACE} SELECT session, frame_id, cy, cx, round(value, 3) AS value FROM f1",
    "background_local_removed": f"WITH {PIXELS_SQL}, {_SURFACE}, o AS (SELECT session, frame_id, cy, cx, value - median(value) OVER {_W} AS value FROM f1), g AS ({_spread('o', 'session, frame_id,')}) SELECT session, frame_id, y, x, round(v - value, 3) AS v FROM px JOIN g USING (session, frame_id, y, x)",
    "border_level": f"WITH {PIXELS_SQL} SELECT session, frame_id, round(median(v), 3) AS level, round(stddev_pop(v), 3) AS spread, count(*) AS n FROM px WHERE y NOT BETWEEN 2 AND 5 OR x NOT BETWEEN 2 AND 5 GROUP BY ALL",
    "star_colours": f"WITH {_BANDS_SQL}, {_STAR} SELECT y, x, " + ", ".join(f"{_HELD.format(f'{c} * (1 - m) + lum * m')} AS {c}" for c in "rgb") + ", 'grey' AS mode FROM sl UNION ALL SELECT y, x, " + ", ".join(f"{_HELD.format(f'{c} * (1 - m) + greatest(least(lum * s{c} / slum, 1), 0) * m')} AS {c}" for c in "rgb") + ", 'stars' FROM sl",
    "level_planes": f"WITH {PIXELS_SQL}, c AS (SELECT *, CAST(x % 3 AS INTEGER) AS c FROM px), m AS (SELECT *, median(v) OVER (PARTITION BY session, frame_id, c) AS m FROM c) SELECT session, frame_id, y, x, c, round(greatest(v + max(m) OVER {_W} - m, 0), 3) AS v FROM m",
    "chroma_noise": _chroma_sql(),
    "neutral_sky": _neutral_sql(),
    "resized": f"""WITH {PIXELS_SQL}, g AS (SELECT y, x, y * 7 / 4.0::DOUBLE AS py, x * 7 / 10.0::DOUBLE AS px FROM (SELECT unnest(generate_series(0, 4))::INTEGER AS y) ys, (SELECT unnest(generate_series(0, 10))::INTEGER AS x) xs)
        SELECT session, frame_id, g.y, g.x, round(sum(v * greatest(1 - abs(p.y - py), 0) * greatest(1 - abs(p.x - px), 0)), 3) AS v FROM g, px p WHERE abs(p.y - py) < 1 AND abs(p.x - px) < 1 GROUP BY ALL""",
    "session_rules": _rules_sql(),
    "usable_objects": """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN FALSE ELSE lower(trim(coalesce(p_name, ''))) NOT IN ('', 'unknown', 'none', 'target', 'object', 'n/a', 'na', 'light', 'lights', 'flat', 'dark', 'bias', 'test') END AS usable FROM part""",
    "setting_names": """WITH k AS (SELECT event_id, 0 AS p, unnest(json_keys(props)) AS field FROM events UNION ALL SELECT event_id, 1, event_type FROM events WHERE props IS NOT NULL), f AS (SELECT field, min((event_id, p)) AS f FROM k GROUP BY field) SELECT field, row_number() OVER (ORDER BY f, field)::INTEGER AS place FROM f""",
    "ordered_outputs": """WITH p AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, url || '#' || page_id AS path FROM pages) SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY path)::INTEGER AS place FROM p""",
    "merged_headers": """WITH o AS (SELECT event_type, 'user-' || lpad(user_id::VARCHAR, 8, '0') AS source, count(*) AS frames, sum(CASE WHEN value * 10 >= 1000 THEN value * 10 / 1000 ELSE value * 10 END) AS seconds, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY source) AS r FROM o)
        SELECT event_type, sum(frames)::BIGINT AS frames, round(sum(seconds), 3) AS seconds, strftime(min(a), '%Y-%m-%d %H:%M:%S') AS "first", strftime(max(b), '%Y-%m-%d %H:%M:%S') AS "last", count(*) AS merged, string_agg(source, ',' ORDER BY source) FILTER (r <= 20) AS sources FROM r GROUP BY event_type""",
    "event_ages": "SELECT user_id, round((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 3.6e9, 4) AS age FROM events GROUP BY user_id",
}
