"""Registered queries of the joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.operators import combine as C
from skyfold.operators import matching as J
from skyfold.operators import metrics as M
from skyfold.plans.stacking import PIXELS_SQL, _rounded
from skyfold.plans.tables import pixels, table

FRAME = ["session", "frame_id"]


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_type").alias("camera"), F.col("p_brand").alias("iso"), (F.col("p_size") * 2.0 + 1).cast("double").alias("exptime"), F.substring_index("p_name", " ", -1).alias("dims"), (F.col("p_size") - 25).cast("double").alias("temp"))


def dark_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for calibration frames: brand is the gain, size the temperature."""
    lib = _library(spark, sf_dir)
    return J.match_darks(lib.filter("p_partkey % 5 = 0"), lib.filter("p_partkey % 5 <> 0"), ["camera"]).select("p_partkey", "camera", "iso", "score")


def flat_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for calibration frames: brand is the optical filter, in capitals on the lights."""
    lib = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("camera"), F.col("p_brand").alias("filter"), F.element_at(F.split("p_name", " "), -1).alias("dims"))
    lights = lib.filter("p_partkey % 5 = 0").withColumn("filter", F.upper("filter"))
    return J.match_flats(lights, lib.filter("p_partkey % 5 <> 0"), ["camera"]).select("p_partkey", "camera", "filter", "score")


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.local_maxima(pixels(spark, sf_dir), FRAME, 1.0)


def _reference(stars: DataFrame) -> DataFrame:
    first = stars.groupBy("session").agg(F.min("frame_id").alias("frame_id"))
    return stars.join(first, FRAME, "left_semi")


def star_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars of every frame against the session's first frame, nearest within three pixels."""
    stars = _stars(spark, sf_dir)
    ref = _reference(stars).select("session", F.col("y").cast("double").alias("ry"), F.col("x").cast("double").alias("rx"))
    own = stars.select(*FRAME, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    return _rounded(J.nearest_stars(own, ref, ["session"], 3.0), "distance", places=6)


def registration_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square distance of the matched stars of each frame."""
    return _rounded(star_match(spark, sf_dir).groupBy(*FRAME).agg(F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("rms"), F.count(F.lit(1)).alias("matched")), "rms", places=4)


def pair_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-distance star pairs between each frame and its session's first frame."""
    stars = _stars(spark, sf_dir).select(*FRAME, "star", "y", "x")
    pairs = J.star_pairs(stars, FRAME, 6)
    ref = J.star_pairs(_reference(stars), FRAME, 6).select("session", F.col("length").alias("r_length"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    return J.equal_distance_pairs(pairs, ref, ["session"], 0.25).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("hypotheses"))


def cone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sky positions; every fiftieth one is a cone's centre."""
    e = lambda i: F.col("embedding")[i].cast("double")
    sky = table(spark, sf_dir, "embeddings").select("vec_id", (180 + 100 * e(0)).alias("ra"), (100 * e(1)).alias("dec"))
    cones = sky.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("cone"), F.col("ra").alias("ra0"), F.col("dec").alias("dec0"))
    return _rounded(J.cone_search(sky, cones, 5.0), "separation", places=4).select("cone", "vec_id", "separation")


def brightest_in_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest catalogue rows of each cone."""
    found = cone_search(spark, sf_dir)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("cone").orderBy("separation", "vec_id"))
    return found.withColumn("rank", rank).filter("rank <= 3")


def _stack(spark: SparkSession, sf_dir: str, rest: int, keep: str) -> DataFrame:
    """Every other frame of each session; the two stacks cover different parts of the field."""
    px = pixels(spark, sf_dir).filter(F.col("frame_id") % 2 == rest).filter(keep)
    return px.groupBy("session", "y", "x").agg(F.avg("v").alias("value"), F.count(F.lit(1)).alias("frames"))


def merge_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = J.merge_stacks(_stack(spark, sf_dir, 0, "y < 6"), _stack(spark, sf_dir, 1, "x > 0"), ["session", "y", "x"])
    return _rounded(merged, "value")


def merge_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (_stack(spark, sf_dir, i, k) for i, k in ((0, "y < 6"), (1, "x > 0")))
    return _rounded(J.merge_guard(a, b, ["y", "x"], 64, by=["session"]), "overlap", "correlation", places=4)


def resume_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the labelled documents are the stored ones."""
    return J.same_paths(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def unseen_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label: an anti join."""
    return J.unseen(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


def restored_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    state = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("accepted"))
    return J.restore_state(docs, state, "doc_id").groupBy("lang", "accepted").agg(F.count(F.lit(1)).alias("n"))


def mosaic_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session means as panels that overlap by half."""
    means = C.mean(pixels(spark, sf_dir), ["session", "y", "x"])
    panels = means.select(F.col("session").alias("panel"), "y", "x", F.col("value").alias("v"), (F.floor(F.col("session") / 4) * 4).cast("int").alias("oy"), ((F.col("session") % 4) * 4).cast("int").alias("ox"))
    return _rounded(J.mosaic(panels, 8, 8), "value")


def session_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all sessions pooled by sign of their class, with the distinct classes that a run would warn about."""
    a = table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.col("source").alias("session"))
    b = table(spark, sf_dir, "conversations").select(F.col("role").alias("kind"), F.lit("talk").alias("session"))
    return a.unionByName(b).groupBy("session").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("kind").alias("kinds"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("listed"))


def header_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a stack: counts, sums, spans and distinct sorted lists over its frames, here the orders of each segment."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("nframes"), F.round(F.sum("o_totalprice"), 2).alias("totexp"), F.min("o_orderdate").cast("string").alias("date_first"), F.max("o_orderdate").cast("string").alias("date_last"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.round(F.stddev_pop("o_totalprice"), 2).alias("price_std"),
    )


def object_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent object name of each group, ties by name."""
    n = table(spark, sf_dir, "part").groupBy("p_type", "p_name").count()
    return n.groupBy("p_type").agg(F.min_by("p_name", F.struct(-F.col("count"), F.col("p_name"))).alias("object"), F.max("count").alias("n"))


QUERIES = {
    q.__name__: q
    for q in (
        dark_match, flat_match, star_match, registration_residual, pair_band, cone_search, brightest_in_cone, merge_stacks, merge_guard, resume_check, unseen_frames, restored_state, mosaic_panels, session_union, header_summary, object_mode,
    )
}

_STARS_SQL = f"""{PIXELS_SQL}, m0 AS (SELECT *, median(v) OVER (PARTITION BY session, frame_id) AS md FROM px),
    m1 AS (SELECT session, frame_id, any_value(md) AS md, greatest(1.4826 * median(abs(v - md)), 1e-6) AS s FROM m0 GROUP BY ALL),
    nb AS (SELECT a.session, a.frame_id, a.y, a.x, any_value(a.v) AS v, max(b.v) AS around FROM px a JOIN px b ON a.session = b.session AND a.frame_id = b.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) GROUP BY ALL),
    stars AS (SELECT nb.session, nb.frame_id, y, x, row_number() OVER (PARTITION BY nb.session, nb.frame_id ORDER BY v - md DESC, y, x) AS star FROM nb JOIN m1 ON nb.session = m1.session AND nb.frame_id = m1.frame_id WHERE v > around AND v > md + 1.0 * s),
    ref AS (SELECT stars.* FROM stars JOIN (SELECT session, min(frame_id) AS frame_id FROM stars GROUP BY session) USING (session, frame_id))"""
_MATCH_SQL = f"""WITH {_STARS_SQL}, d AS (SELECT s.session, s.frame_id, s.y::DOUBLE AS y, s.x::DOUBLE AS x, r.y::DOUBLE AS ry, r.x::DOUBLE AS rx, (s.y - r.y) ** 2 + (s.x - r.x) ** 2 AS d2 FROM stars s JOIN ref r ON s.session = r.session WHERE (s.y - r.y) ** 2 + (s.x - r.x) ** 2 <= 9),
    k AS (SELECT *, row_number() OVER (PARTITION BY session, frame_id, y, x ORDER BY d2, ry, rx) AS k FROM d), matched AS (SELECT session, frame_id, y, x, ry, rx, round(sqrt(d2), 6) AS distance FROM k WHERE k = 1)"""
_CONE_SQL = """WITH sky AS (SELECT vec_id, 180 + 100 * CAST(embedding[1] AS DOUBLE) AS ra, 100 * CAST(embedding[2] AS DOUBLE) AS dec FROM embeddings),
    sep AS (SELECT c.vec_id AS cone, s.vec_id, degrees(2 * asin(least(sqrt(sin(radians(s.dec - c.dec) / 2) ** 2 + cos(radians(s.dec)) * cos(radians(c.dec)) * sin(radians(s.ra - c.ra) / 2) ** 2), 1))) AS d FROM sky s JOIN sky c ON c.vec_id % 50 = 0),
    found AS (SELECT cone, vec_id, round(d, 4) AS separation FROM sep WHERE d <= 5)"""
_MERGE_SQL = f"""WITH {PIXELS_SQL}, a AS (SELECT session, y, x, avg(v) AS v, count(*) AS n FROM px WHERE frame_id % 2 = 0 AND y < 6 GROUP BY ALL), b AS (SELECT session, y, x, avg(v) AS v, count(*) AS n FROM px WHERE frame_id % 2 = 1 AND x > 0 GROUP BY ALL)"""

ORACLE_SQL = {
    "dark_match": """WITH lib AS (SELECT p_partkey, p_type AS camera, p_brand AS iso, p_size * 2.0 + 1 AS exptime, string_split(p_name, ' ')[-1] AS dims, p_size - 25 AS temp FROM part),
        l AS (SELECT * FROM lib WHERE p_partkey % 5 = 0),
        i AS (SELECT camera, iso, row_number() OVER (PARTITION BY camera ORDER BY count(*) DESC, iso) AS r FROM l GROUP BY camera, iso),
        e AS (SELECT camera, exptime, row_number() OVER (PARTITION BY camera ORDER BY count(*) DESC, exptime) AS r FROM l GROUP BY camera, exptime),
        d AS (SELECT camera, dims, row_number() OVER (PARTITION BY camera ORDER BY count(*) DESC, dims) AS r FROM l GROUP BY camera, dims),
        p AS (SELECT camera, avg(temp) AS t FROM l GROUP BY camera),
        s AS (SELECT lib.*, CASE WHEN lib.dims <> d.dims THEN -1000 ELSE 0 END + CASE WHEN lib.iso = i.iso THEN 100 ELSE -100 END
              + CASE WHEN abs(temp - t) <= 1 THEN 30 WHEN abs(temp - t) <= 3 THEN 15 WHEN abs(temp - t) <= 7 THEN 5 ELSE -30 END
              + CASE WHEN abs(lib.exptime - e.exptime) < 0.5 THEN 10 WHEN abs(lib.exptime - e.exptime) < 0.5 * e.exptime THEN 5 ELSE 0 END AS score
              FROM lib JOIN p ON lib.camera = p.camera JOIN i ON i.camera = lib.camera AND i.r = 1 JOIN e ON e.camera = lib.camera AND e.r = 1 JOIN d ON d.camera = lib.camera AND d.r = 1 WHERE p_partkey % 5 <> 0)
        SELECT p_partkey, camera, iso, score FROM (SELECT *, rank() OVER (PARTITION BY camera ORDER BY score DESC) AS r FROM s) WHERE r = 1""",
    "flat_match": """WITH lib AS (SELECT p_partkey, p_type AS camera, p_brand AS filter, string_split(p_name, ' ')[-1] AS dims FROM part),
        l AS (SELECT * FROM lib WHERE p_partkey % 5 = 0),
        f AS (SELECT camera, upper(filter) AS filter, row_number() OVER (PARTITION BY camera ORDER BY count(*) DESC, upper(filter)) AS r FROM l GROUP BY camera, upper(filter)),
        d AS (SELECT camera, dims, row_number() OVER (PARTITION BY camera ORDER BY count(*) DESC, dims) AS r FROM l GROUP BY camera, dims),
        s AS (SELECT lib.*, CASE WHEN lib.dims <> d.dims THEN -1000 ELSE 0 END + CASE WHEN upper(lib.filter) = f.filter THEN 50 ELSE -50 END AS score
              FROM lib JOIN f ON f.camera = lib.camera AND f.r = 1 JOIN d ON d.camera = lib.camera AND d.r = 1 WHERE p_partkey % 5 <> 0)
        SELECT p_partkey, camera, filter, score FROM (SELECT *, rank() OVER (PARTITION BY camera ORDER BY score DESC) AS r FROM s) WHERE r = 1""",
    "star_match": f"{_MATCH_SQL} SELECT * FROM matched",
    "registration_residual": f"{_MATCH_SQL} SELECT session, frame_id, round(sqrt(avg(distance * distance)), 4) AS rms, count(*) AS matched FROM matched GROUP BY session, frame_id",
    "pair_band": f"""WITH {_STARS_SQL}, p AS (SELECT a.session, a.frame_id, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM stars a JOIN stars b USING (session, frame_id) WHERE a.star < b.star AND b.star <= 6),
        q AS (SELECT a.session, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM ref a JOIN ref b USING (session, frame_id) WHERE a.star < b.star AND b.star <= 6)
        SELECT p.session, p.frame_id, count(*) AS hypotheses FROM p JOIN q ON p.session = q.session AND abs(p.d - q.d) <= 0.25 GROUP BY p.session, p.frame_id""",
    "cone_search": f"{_CONE_SQL} SELECT * FROM found",
    "brightest_in_cone": f"{_CONE_SQL} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cone ORDER BY separation, vec_id) AS INTEGER) AS rank FROM found) WHERE rank <= 3",
    "merge_stacks": f"""{_MERGE_SQL} SELECT session, y, x, round((coalesce(a.n, 0) * coalesce(a.v, 0) + coalesce(b.n, 0) * coalesce(b.v, 0)) / (coalesce(a.n, 0) + coalesce(b.n, 0)), 3) AS value, coalesce(a.n, 0) + coalesce(b.n, 0) AS frames FROM a FULL JOIN b USING (session, y, x)""",
    "merge_guard": f"""{_MERGE_SQL}, s AS (SELECT session, count(*) / 64 AS overlap, corr(a.v, b.v) AS correlation FROM a JOIN b USING (session, y, x) GROUP BY session) SELECT session, round(overlap, 4) AS overlap, round(correlation, 4) AS correlation, overlap >= 0.25 AND correlation >= 0.15 AS allowed FROM s""",
    "resume_check": "WITH d AS (SELECT doc_id FROM documents), l AS (SELECT doc_id FROM labels), o AS ((SELECT doc_id FROM d EXCEPT SELECT doc_id FROM l) UNION ALL (SELECT doc_id FROM l EXCEPT SELECT doc_id FROM d)) SELECT count(*) AS differing, count(*) = 0 AS can_resume FROM o",
    "unseen_frames": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "restored_state": "SELECT lang, quality AS accepted, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, quality",
    "mosaic_panels": f"""WITH {PIXELS_SQL}, m AS (SELECT session, y, x, avg(v) AS v FROM px GROUP BY ALL), s AS (SELECT *, v - median(v) OVER (PARTITION BY session) AS u, least(y + 1, 8 - y, x + 1, 8 - x)::DOUBLE AS w FROM m)
        SELECT y + (session // 4) * 4 AS gy, x + (session % 4) * 4 AS gx, round(sum(w * u) / sum(w), 3) AS value, count(*) AS panels FROM s GROUP BY 1, 2""",
    "session_union": "WITH u AS (SELECT lang AS kind, source AS session FROM documents UNION ALL SELECT role, 'talk' FROM conversations) SELECT session, count(*) AS frames, count(DISTINCT kind) AS kinds, string_agg(DISTINCT kind, ',' ORDER BY kind) AS listed FROM u GROUP BY session",
    "header_summary": "SELECT c_mktsegment, count(*) AS nframes, round(sum(o_totalprice), 2) AS totexp, CAST(min(o_orderdate) AS VARCHAR) AS date_first, CAST(max(o_orderdate) AS VARCHAR) AS date_last, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, round(stddev_pop(o_totalprice), 2) AS price_std FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "object_mode": "WITH n AS (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY ALL) SELECT p_type, p_name AS object, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_name) AS r FROM n) WHERE r = 1",
}
