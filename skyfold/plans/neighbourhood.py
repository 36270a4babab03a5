"""Registered queries of the neighbourhood operators: filters, star detection, registration, warps and the whole batch stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import detect as D
from skyfold.functions import kernels as K
from skyfold.operators import combine as C
from skyfold.operators import image_ops as I
from skyfold.operators import selection as S
from skyfold.plans.stacking import PIXELS_SQL, _rounded
from skyfold.plans.tables import SIDE, table

KEYS = ["session", "frame_id"]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, frame_id, height, width, data) with the cosmic-ray hits of the pixel view."""
    e = table(spark, sf_dir, "embeddings")
    data = F.expr("transform(embedding, (e, p) -> 1000 + 1000 * cast(e as double) + CASE WHEN (vec_id * 7 + p) % 53 = 0 THEN 5000.0D ELSE 0.0D END)")
    return e.select(F.col("label").cast("int").alias("session"), F.col("vec_id").alias("frame_id"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), data.alias("data"))


def _filtered(*steps: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(I.to_pixels(I.chain(frames(spark, sf_dir), KEYS, steps), KEYS), "v")

    return query


def tiled_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median filter over tiles with halos: the same result as over whole frames."""
    cut = I.tiles(frames(spark, sf_dir), KEYS, 4, 1)
    done = I.map_frames(cut, [*KEYS, "y0", "x0"], I.FILTERS["median"])
    return _rounded(I.tile_pixels(done, KEYS, 1), "v")


def detect_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.flat_map_frames(frames(spark, sf_dir), KEYS, {"y": "double", "x": "double", "flux": "double", "peak": "double", "roundness": "double"}, lambda a: K.detect_stars(a, k=3.0, border=1).tolist())
    return _rounded(found, "y", "x", "flux", "peak", "roundness")


def local_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection on the local noise map, with significance and the number of samples over the noise."""
    columns = {"y": "double", "x": "double", "flux": "double", "peak": "double", "roundness": "double", "snr": "double", "samples": "double"}
    found = I.flat_map_frames(frames(spark, sf_dir), KEYS, columns, lambda a: D.detect(a, k=3.0, border=1, least_samples=1, roundest=1.0).tolist())
    return _rounded(found, *columns)


def frame_fwhm(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(a):
        stars = K.detect_stars(a, k=3.0, border=1)
        return [(K.measure_fwhm(a, stars), len(stars))]

    return _rounded(I.flat_map_frames(frames(spark, sf_dir), KEYS, {"fwhm": "double", "stars": "int"}, measure), "fwhm")


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    first = f.groupBy("session").agg(F.min_by("data", "frame_id").alias("r_data"))  # one frame a session
    return I.register_to_reference(f, first, ["session"], "frame_id")


def register_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of every frame on its session's first frame, by stars where enough agree."""
    return _rounded(_registered(spark, sf_dir), "dy", "dx", "angle", "residual", places=4)


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).join(S.shift_outliers(_registered(spark, sf_dir), ["session"]).filter("shift_ok"), KEYS)


def drizzle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _aligned(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return _rounded(I.drizzle(moved, ["session"], "frame_id", 2.0), "value")


def batch_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main run: clean, register, gate by shift, warp and combine with sigma clipping."""
    cleaned = I.chain(frames(spark, sf_dir), KEYS, ("cosmics",))
    first = cleaned.groupBy("session").agg(F.min_by("data", "frame_id").alias("r_data"))
    shifts = S.shift_outliers(I.register_to_reference(cleaned, first, ["session"], "frame_id"), ["session"]).filter("shift_ok")
    warped = I.warp_frames(cleaned.join(shifts, KEYS), KEYS)
    return _rounded(C.sigma_clip(warped, ["session", "y", "x"]), "value")


def postprocess_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The post-processing chain over the sessions' clipped stacks."""
    from skyfold.plans.tables import pixels

    stack = C.sigma_clip(pixels(spark, sf_dir), ["session", "y", "x"])
    data = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "value"))), lambda p: p["value"])
    whole = stack.groupBy("session").agg(data.alias("data")).withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})
    return _rounded(I.to_pixels(I.chain(whole, ["session"], ("hot_pixels", "background_mesh", "median_cascade", "reduce_stars", "local_contrast")), ["session"]), "v")


QUERIES = {f"filter_{name}": _filtered(name) for name in I.FILTERS} | {q.__name__: q for q in (tiled_median, detect_stars, local_stars, frame_fwhm, register_frames, drizzle, batch_stack, postprocess_chain)}

_MEDIAN_SQL = f"""WITH {PIXELS_SQL}, n AS (SELECT a.session, a.frame_id, a.y, a.x, b.v FROM px a, (VALUES (-1), (0), (1)) s(dy), (VALUES (-1), (0), (1)) t(dx), px b
    WHERE b.session = a.session AND b.frame_id = a.frame_id AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7))
    SELECT session, frame_id, y, x, round(median(v), 3) AS v FROM n GROUP BY ALL"""


def _around(radius: int, source: str = "px") -> str:
    """Neighbours (dy, dx, u) of every pixel of a source (session, frame_id, y, x, v) within a square, edges mirrored."""
    steps = f"(SELECT unnest(generate_series(-{radius}, {radius})) AS d)"
    mirror = lambda c: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > 7 THEN 15 - ({c}) ELSE {c} END"
    return f"""SELECT a.session, a.frame_id, a.y, a.x, a.v, s.d AS dy, t.d AS dx, b.v AS u FROM {source} a, {steps} s, {steps} t, {source} b
        WHERE b.session = a.session AND b.frame_id = a.frame_id AND b.y = {mirror("a.y + s.d")} AND b.x = {mirror("a.x + t.d")}"""


def _diffusion_sql(rounds: int, kappa: float, gamma: float) -> str:
    parts = [PIXELS_SQL, "d0 AS (SELECT * FROM px)"]
    flow = " + ".join(f"({n}.v - a.v) * exp(-(({n}.v - a.v) / {kappa}) * (({n}.v - a.v) / {kappa}))" for n in "pqrs")
    for i in range(rounds):
        near = " ".join(f"JOIN d{i} {n} ON {n}.session = a.session AND {n}.frame_id = a.frame_id AND {n}.y = (a.y + {8 + dy}) % 8 AND {n}.x = (a.x + {8 + dx}) % 8" for n, (dy, dx) in zip("pqrs", ((1, 0), (-1, 0), (0, 1), (0, -1)), strict=True))
        parts.append(f"d{i + 1} AS (SELECT a.session, a.frame_id, a.y, a.x, a.v + {gamma} * ({flow}) AS v FROM d{i} a {near})")
    return "WITH " + ", ".join(parts) + f" SELECT session, frame_id, y, x, round(v, 3) AS v FROM d{rounds}"


def _lattice_sql(radius: int) -> str:
    """Neighbours with their own places (ny, nx); edges mirrored between the outer samples and beyond (radius 1) or at them (2)."""
    at = (lambda c: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > 7 THEN 15 - ({c}) ELSE {c} END") if radius == 1 else (lambda c: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END")
    steps = f"(SELECT unnest(generate_series(-{radius}, {radius})) AS d)"
    return f"""SELECT a.session, a.frame_id, a.y, a.x, a.v, s.d AS dy, t.d AS dx, b.y AS ny, b.x AS nx, b.v AS u FROM px a, {steps} s, {steps} t, px b
        WHERE b.session = a.session AND b.frame_id = a.frame_id AND b.y = {at("a.y + s.d")} AND b.x = {at("a.x + t.d")}"""


def _rotational_sql(shift: float = 1.0, degrees: float = 15.0) -> str:
    """Bilinear samples at the places turned by both signs of the angle and moved inwards, from four joins each."""
    parts = [PIXELS_SQL, f"polar AS (SELECT *, y - 3.5::DOUBLE AS dy, x - 3.5::DOUBLE AS dx, greatest(sqrt((y - 3.5::DOUBLE) * (y - 3.5::DOUBLE) + (x - 3.5::DOUBLE) * (x - 3.5::DOUBLE)) - {shift}, 0) / sqrt((y - 3.5::DOUBLE) * (y - 3.5::DOUBLE) + (x - 3.5::DOUBLE) * (x - 3.5::DOUBLE)) AS k FROM px)"]
    for name, t in (("a", degrees), ("b", -degrees)):
        c, s = f"cos(radians({t}::DOUBLE))", f"sin(radians({t}::DOUBLE))"
        parts.append(f"{name}0 AS (SELECT session, frame_id, y, x, least(greatest(3.5 + k * (dy * {c} - dx * {s}), 0), 7) AS sy, least(greatest(3.5 + k * (dy * {s} + dx * {c}), 0), 7) AS sx FROM polar)")
        parts.append(f"{name}1 AS (SELECT *, least(floor(sy), 6)::INTEGER AS iy, least(floor(sx), 6)::INTEGER AS ix FROM {name}0)")
        parts.append(f"{name} AS (SELECT t.session, t.frame_id, t.y, t.x, sum((CASE WHEN p.y = iy THEN 1 - (sy - iy) ELSE sy - iy END) * (CASE WHEN p.x = ix THEN 1 - (sx - ix) ELSE sx - ix END) * p.v) AS v FROM {name}1 t JOIN px p ON p.session = t.session AND p.frame_id = t.frame_id AND p.y IN (iy, iy + 1) AND p.x IN (ix, ix + 1) GROUP BY ALL)")
    return "WITH " + ", ".join(parts) + " SELECT session, frame_id, y, x, round(2 * px.v - a.v - b.v, 3) AS v FROM px JOIN a USING (session, frame_id, y, x) JOIN b USING (session, frame_id, y, x)"


_WEIGHT = "exp(-0.5 * dy * dy) * exp(-0.5 * dx * dx)"
ORACLE_SQL = {
    "filter_median": _MEDIAN_SQL,
    "tiled_median": _MEDIAN_SQL,
    "filter_hot_pixels": f"""WITH {PIXELS_SQL}, n AS ({_around(1)}), m AS (SELECT session, frame_id, y, x, any_value(v) AS v, median(u) AS m FROM n GROUP BY ALL),
        s AS (SELECT *, 1.4826 * median(abs(v - m)) OVER w AS s, stddev_pop(v - m) OVER w AS sd FROM m WINDOW w AS (PARTITION BY session, frame_id)) SELECT session, frame_id, y, x, round(CASE WHEN v - m > 5 * CASE WHEN s >= 1e-6 THEN s ELSE sd END THEN m ELSE v END, 3) AS v FROM s""",
    "filter_cosmics": f"""WITH {PIXELS_SQL}, n5 AS ({_around(2)}), m5 AS (SELECT session, frame_id, y, x, any_value(v) AS v, median(u) AS m5, greatest(4 * any_value(v) - sum(u) FILTER (abs(dy) + abs(dx) = 1), 0) AS edge FROM n5 GROUP BY ALL),
        e AS (SELECT session, frame_id, y, x, v AS a, m5, edge / (2 * greatest(sqrt(greatest(m5, 0) + 6.5 * 6.5), 1e-6)) AS v FROM m5), n3 AS ({_around(1, "e")}), m3 AS (SELECT session, frame_id, y, x, median(u) AS m3 FROM n3 GROUP BY ALL)
        SELECT session, frame_id, y, x, round(CASE WHEN e.v > 4.5 AND e.v / greatest(m3, 1e-6) > 5 THEN m5 ELSE a END, 3) AS v FROM e JOIN m3 USING (session, frame_id, y, x)""",
    "filter_median_cascade": f"""WITH {PIXELS_SQL}, n1 AS ({_around(1)}), c1 AS (SELECT session, frame_id, y, x, any_value(v) AS a, median(u) AS v FROM n1 GROUP BY ALL), n2 AS ({_around(2, "c1")}), c2 AS (SELECT session, frame_id, y, x, median(u) AS v FROM n2 GROUP BY ALL),
        d AS (SELECT session, frame_id, y, x, a - c1.v AS d1, c1.v - c2.v AS d2, c2.v AS c FROM c1 JOIN c2 USING (session, frame_id, y, x)), t AS (SELECT *, 3 * greatest(median(abs(d1)) OVER (PARTITION BY session, frame_id) / 0.6745, 1e-12) AS t FROM d)
        SELECT session, frame_id, y, x, round(c + sign(d1) * greatest(abs(d1) - t, 0) + sign(d2) * greatest(abs(d2) - t / sqrt(2), 0), 3) AS v FROM t""",
    "filter_gaussian": f"WITH {PIXELS_SQL}, n AS ({_around(4)}) SELECT session, frame_id, y, x, round(sum({_WEIGHT} * u) / sum({_WEIGHT}), 3) AS v FROM n GROUP BY session, frame_id, y, x",
    "filter_bilateral": f"""WITH {PIXELS_SQL}, n AS ({_around(3)}), w AS (SELECT *, exp(-(dy * dy + dx * dx) / 4.5::DOUBLE) * exp(-((u - v) * (u - v)) / 7200.0::DOUBLE) AS w FROM n)
        SELECT session, frame_id, y, x, round(sum(w * u) / sum(w), 3) AS v FROM w GROUP BY session, frame_id, y, x""",
    "filter_rotational_gradient": _rotational_sql(),
    "filter_green_bilinear": f"""WITH {PIXELS_SQL}, n AS ({_lattice_sql(1)})
        SELECT session, frame_id, y, x, round(CASE WHEN (y + x) % 2 = 1 THEN any_value(v)
            ELSE sum((2 - abs(dy)) * (2 - abs(dx)) * u) FILTER ((ny + nx) % 2 = 1) / sum((2 - abs(dy)) * (2 - abs(dx))) FILTER ((ny + nx) % 2 = 1) END, 3) AS v
        FROM n GROUP BY session, frame_id, y, x""",
    "filter_green_gradient": f"""WITH {PIXELS_SQL}, n AS ({_lattice_sql(2)})
        SELECT session, frame_id, y, x, round(CASE WHEN (y + x) % 2 = 1 THEN any_value(v)
            ELSE (4 * any_value(v) + 2 * sum(u) FILTER (abs(dy) + abs(dx) = 1) - sum(u) FILTER (abs(dy) + abs(dx) = 2 AND dy * dx = 0)) / 8 END, 3) AS v
        FROM n GROUP BY session, frame_id, y, x""",
    "filter_diffusion": _diffusion_sql(5, 200.0, 0.1),
}
