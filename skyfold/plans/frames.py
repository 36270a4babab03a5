"""Registered queries over frames: metrics, the gate, reference choice, crops and dither."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.operators import metrics as M
from skyfold.operators import selection as S
from skyfold.plans.stacking import PIXELS_SQL, _rounded
from skyfold.plans.tables import pixels, table

KEYS = ["session", "frame_id"]
PLAIN_SQL = PIXELS_SQL.replace(" + CASE WHEN (vec_id * 7 + p) % 53 = 0 THEN 5000 ELSE 0 END", "")


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, frame_id, dy, dx, score): positions and signal derived from each frame's first components."""
    frames = table(spark, sf_dir, "embeddings")
    e = lambda i: F.col("embedding")[i].cast("double")
    return frames.select(F.col("label").cast("int").alias("session"), F.col("vec_id").alias("frame_id"), (20 * e(0)).alias("dy"), (20 * e(1)).alias("dx"), (50 + 100 * e(2)).alias("score"))


SHIFTS_SQL = "sh AS (SELECT CAST(label AS INTEGER) AS session, vec_id AS frame_id, 20 * CAST(embedding[1] AS DOUBLE) AS dy, 20 * CAST(embedding[2] AS DOUBLE) AS dx, 50 + 100 * CAST(embedding[3] AS DOUBLE) AS score FROM embeddings)"


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    m = M.pixel_metrics(px, KEYS)
    stars = M.local_maxima(px, KEYS, 3.0).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("star_count"))
    m = m.join(stars, KEYS, "left").withColumn("star_count", F.coalesce("star_count", F.lit(0)))
    return m.withColumn("score", M.quality_score(F.col("snr"), F.col("star_count").cast("double"), F.lit(3.0)))


_METRICS_SQL = f"""{PIXELS_SQL},
    m0 AS (SELECT *, median(v) OVER (PARTITION BY session, frame_id) AS md FROM px),
    mm AS (SELECT session, frame_id, avg(v) AS mean, stddev_pop(v) AS contrast, any_value(md) AS background, greatest(1.4826 * median(abs(v - md)), 1e-6) AS noise,
           quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS dynamic_range FROM m0 GROUP BY session, frame_id),
    nb AS (SELECT a.session, a.frame_id, a.y, a.x, any_value(a.v) AS v, max(b.v) AS around FROM px a JOIN px b
           ON a.session = b.session AND a.frame_id = b.frame_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) GROUP BY a.session, a.frame_id, a.y, a.x),
    st AS (SELECT nb.session, nb.frame_id, count(*) AS star_count FROM nb JOIN mm ON nb.frame_id = mm.frame_id AND nb.session = mm.session WHERE nb.v > nb.around AND nb.v > background + 3 * noise GROUP BY ALL),
    fm AS (SELECT mm.*, (p95 - background) / noise AS snr, coalesce(star_count, 0) AS star_count FROM mm LEFT JOIN st USING (session, frame_id)),
    fs AS (SELECT *, greatest(least(snr / 2, 1), 0) * greatest(greatest(least(star_count / 50, 1), 0), 0.01) * greatest(0.1, 1 / (1 + 0.02 * 1.0 * 1.0)) * 100 AS score FROM fm)"""


def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir).select(*KEYS, "mean", "contrast", "background", "noise", "p95", "dynamic_range", "snr", "star_count", "score")
    return _rounded(m, "mean", "contrast", "background", "noise", "p95", "dynamic_range", "snr", "score")


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = S.quality_gate(_measured(spark, sf_dir), ["session"], threshold=30.0, sigma=2.0)
    return gated.select(*KEYS, "accepted", "reject_reason", S.reason_category(F.col("reject_reason")).alias("category"))


def brenner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.brenner(pixels(spark, sf_dir), KEYS), "brenner")


def laplacian_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.laplacian_variance(pixels(spark, sf_dir), KEYS), "laplacian_var", places=1)


def patch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.patch_scores(pixels(spark, sf_dir), KEYS, 4), "brenner")


def patch_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.patch_entropy(pixels(spark, sf_dir, False), KEYS), "entropy", places=6)


def sky_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.sky_sigma(pixels(spark, sf_dir), KEYS), "sky_sigma")


def star_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five brightest star candidates of every frame."""
    return _rounded(M.local_maxima(pixels(spark, sf_dir), KEYS, 1.0).filter("star <= 5"), "flux").select(*KEYS, "star", "y", "x", "flux")


def psf_anisotropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = pixels(spark, sf_dir, False).select("session", "frame_id", (1 + F.abs(F.col("v") - 1000) / 500).alias("a"), F.lit(1.0).alias("b"), ((F.col("v") - 1000) / 100).alias("theta"))
    return _rounded(M.psf_anisotropy(stars, KEYS), "ellipticity", "scatter")


def gray_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour scales per session; three pixels of each frame stand for a star's channels."""
    e = lambda i: 1 + F.col("embedding")[i].cast("double")
    stars = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("session"), e(10).alias("r"), e(11).alias("g"), e(12).alias("b"))
    return _rounded(M.gray_locus(stars, ["session"]), "scale_r", "scale_b", places=6)


def validate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.validate(pixels(spark, sf_dir, False).withColumn("v", F.when(F.col("frame_id") % 11 == 0, F.lit(7.0)).when((F.col("frame_id") % 13 == 0) & (F.col("y") < 5), F.lit(0.0)).otherwise(F.col("v"))), KEYS)


def shift_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shift_outliers(shifts(spark, sf_dir), ["session"], sigma=1.5).select(*KEYS, "shift_ok")


def common_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.common_crop(shifts(spark, sf_dir), ["session"], 480, 640)


def dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.dither(shifts(spark, sf_dir), ["session"], "frame_id"), "mean_magnitude", "direction_spread", "autocorrelation", places=4)


def reference_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.reference_frame(shifts(spark, sf_dir), ["session"], "frame_id"), "quality", places=4)


def consensus_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.consensus_reference(shifts(spark, sf_dir), ["session"], "frame_id")


def stack_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted frame with the top score of each session."""
    gated = S.quality_gate(_measured(spark, sf_dir), ["session"], threshold=30.0, sigma=2.0).filter("accepted").withColumn("score", F.round("score", 6))
    return _rounded(gated.groupBy("session").agg(F.max_by("frame_id", F.struct("score", -F.col("frame_id"))).alias("frame_id"), F.max("score").alias("score")), "score")


def session_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each session and their class."""
    px = pixels(spark, sf_dir)
    s = px.groupBy("session").agg(
        F.avg((F.col("v") > 1000).cast("double")).alias("fill"), F.avg((F.col("v") > 1100).cast("double")).alias("diffuse"), (F.percentile("v", F.lit(0.99)) / F.max("v")).alias("peak"), F.countDistinct("frame_id").alias("frames")
    )
    return _rounded(s.withColumn("target", S.classify_target(F.col("fill"), F.col("diffuse"), F.col("peak"), F.col("frames"))), "fill", "diffuse", "peak", places=6)


def advisor_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preset weights of each session's signals."""
    anchors = [("galaxy", 0.4, 0.3, 0.5), ("emission", 0.7, 0.6, 0.3), ("star_field", 0.5, 0.1, 0.9)]
    return _rounded(S.blend_weights(session_signals(spark, sf_dir), anchors, ["session"], ["fill", "diffuse", "peak"]), "weight", places=5)


QUERIES = {
    q.__name__: q
    for q in (
        frame_metrics, quality_gate, brenner, laplacian_var, patch_scores, patch_entropy, sky_sigma, star_topk, psf_anisotropy, gray_locus, validate_frames,
        shift_outliers, common_crop, dither, reference_frame, consensus_reference, stack_reference, session_signals, advisor_blend,
    )
}

_GATE_SQL = f"""WITH {_METRICS_SQL},
    g1 AS (SELECT *, CASE WHEN star_count = 0 THEN 'no stars detected' WHEN snr < 0.5 THEN 'extremely low SNR' WHEN contrast < 2 THEN 'extremely low contrast' WHEN dynamic_range < 20 THEN 'extremely low dynamic range' END AS r1 FROM fs),
    g2 AS (SELECT *, count(*) FILTER (r1 IS NULL) OVER w AS n,
           {", ".join(f"avg({c}) FILTER (r1 IS NULL) OVER w AS m_{c}, stddev_pop({c}) FILTER (r1 IS NULL) OVER w AS s_{c}" for c in ("snr", "star_count", "contrast"))} FROM g1 WINDOW w AS (PARTITION BY session)),
    g3 AS (SELECT *, CASE WHEN r1 IS NOT NULL THEN r1 WHEN n > 3 AND
           {" + ".join(f"(CASE WHEN s_{c} < 1e-6 OR abs(({c} - m_{c}) / s_{c}) < 2.0 THEN 0 ELSE 1 END)" for c in ("snr", "star_count", "contrast"))} >= 2 THEN 'statistical outlier' END AS r2 FROM g2),
    g4 AS (SELECT *, count(*) FILTER (r2 IS NULL) OVER w AS n2, quantile_cont(score, 0.9) FILTER (r2 IS NULL) OVER w AS p90, max(score) FILTER (r2 IS NULL) OVER w AS top FROM g3 WINDOW w AS (PARTITION BY session)),
    g5 AS (SELECT *, CASE WHEN n2 >= 10 THEN p90 ELSE top END AS ref FROM g4),
    gate AS (SELECT session, frame_id, score, CASE WHEN r2 IS NOT NULL THEN r2 WHEN ref > 1e-6 AND score < ref * 0.7 THEN 'score below reference' END AS reject_reason FROM g5)"""

ORACLE_SQL = {
    "frame_metrics": f"WITH {_METRICS_SQL} SELECT session, frame_id, round(mean, 3) AS mean, round(contrast, 3) AS contrast, round(background, 3) AS background, round(noise, 3) AS noise, round(p95, 3) AS p95, round(dynamic_range, 3) AS dynamic_range, round(snr, 3) AS snr, star_count, round(score, 3) AS score FROM fs",
    "quality_gate": f"""{_GATE_SQL} SELECT session, frame_id, reject_reason IS NULL AS accepted, reject_reason, CASE WHEN contains(reject_reason, 'score') THEN 'Below quality threshold' WHEN contains(reject_reason, 'outlier') THEN 'Statistical outlier'
        WHEN contains(reject_reason, 'contrast') OR contains(reject_reason, 'dynamic') OR contains(reject_reason, 'noise') THEN 'Poor quality' WHEN contains(reject_reason, 'star') THEN 'No stars detected' WHEN reject_reason IS NOT NULL THEN 'Other' END AS category FROM gate""",
    "brenner": f"""WITH {PIXELS_SQL}, d AS (SELECT session, frame_id, lead(v, 2) OVER (PARTITION BY session, frame_id, y ORDER BY x) - v AS d FROM px)
        SELECT session, frame_id, round(avg(d * d), 3) AS brenner FROM d GROUP BY session, frame_id""",
    "laplacian_var": f"""WITH {PIXELS_SQL}, l AS (SELECT session, frame_id, coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) + coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) - 4 * v AS l FROM px
        WINDOW r AS (PARTITION BY session, frame_id, y ORDER BY x), c AS (PARTITION BY session, frame_id, x ORDER BY y)) SELECT session, frame_id, round(var_pop(l), 1) AS laplacian_var FROM l GROUP BY session, frame_id""",
    "patch_scores": f"""WITH {PIXELS_SQL}, d AS (SELECT session, frame_id, CAST(y // 4 AS INTEGER) AS py, CAST(x // 4 AS INTEGER) AS px, lead(v, 2) OVER (PARTITION BY session, frame_id, y, x // 4 ORDER BY x) - v AS d FROM px)
        SELECT session, frame_id, py, px, round(avg(d * d), 3) AS brenner FROM d GROUP BY session, frame_id, py, px""",
    "patch_entropy": f"""WITH {PLAIN_SQL}, r AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY session, frame_id)),
        h AS (SELECT session, frame_id, least(floor((v - lo) / (hi - lo) * 16), 15) AS b, count(*) AS n FROM r GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY session, frame_id) AS p FROM h)
        SELECT session, frame_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY session, frame_id""",
    "sky_sigma": f"""WITH {PIXELS_SQL}, q AS (SELECT *, quantile_cont(v, 0.8) OVER (PARTITION BY session, frame_id) AS p80 FROM px), k AS (SELECT *, CASE WHEN v > 0 AND v < p80 THEN v END AS u FROM q),
        d AS (SELECT session, frame_id, lead(u) OVER (PARTITION BY session, frame_id, y ORDER BY x) - u AS d FROM k UNION ALL SELECT session, frame_id, lead(u) OVER (PARTITION BY session, frame_id, x ORDER BY y) - u FROM k),
        e AS (SELECT *, median(d) OVER (PARTITION BY session, frame_id) AS m FROM d WHERE d IS NOT NULL) SELECT session, frame_id, round(median(abs(d - m)) / (0.6745 * sqrt(2)), 3) AS sky_sigma FROM e GROUP BY session, frame_id""",
    "star_topk": f"""WITH {_METRICS_SQL}, c AS (SELECT nb.*, nb.v - background AS flux FROM nb JOIN mm ON nb.session = mm.session AND nb.frame_id = mm.frame_id WHERE nb.v > around AND nb.v > background + 1.0 * noise),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY session, frame_id ORDER BY flux DESC, y, x) AS INTEGER) AS star FROM c) SELECT session, frame_id, star, y, x, round(flux, 3) AS flux FROM r WHERE star <= 5""",
    "psf_anisotropy": f"""WITH {PLAIN_SQL}, s AS (SELECT session, frame_id, 1 + abs(v - 1000) / 500 AS a, (v - 1000) / 100 AS t FROM px),
        g AS (SELECT session, frame_id, median((a * a - 1) / (a * a + 1)) AS ellipticity, avg(sin(2 * t)) AS s, avg(cos(2 * t)) AS c FROM s GROUP BY ALL),
        h AS (SELECT *, degrees(sqrt(-2 * ln(greatest(sqrt(s * s + c * c), 1e-12)))) / 2 AS scatter FROM g)
        SELECT session, frame_id, round(ellipticity, 3) AS ellipticity, round(scatter, 3) AS scatter, CASE WHEN ellipticity < 0.15 THEN 'round' WHEN scatter < 20 THEN 'tracking' ELSE 'optical' END AS kind FROM h""",
    "gray_locus": """WITH s AS (SELECT CAST(label AS INTEGER) AS session, 1 + CAST(embedding[11] AS DOUBLE) AS r, 1 + CAST(embedding[12] AS DOUBLE) AS g, 1 + CAST(embedding[13] AS DOUBLE) AS b FROM embeddings),
        k0 AS (SELECT session, r / (r + g + b) AS fr, g / (r + g + b) AS fg, b / (r + g + b) AS fb, TRUE AS k FROM s WHERE r > 0 AND g > 0 AND b > 0),
        """
    + ",".join(
        f"""a{i} AS (SELECT *, median(fr / fg) FILTER (k) OVER w AS mr, median(fb / fg) FILTER (k) OVER w AS mb FROM k{i} WINDOW w AS (PARTITION BY session)),
        b{i} AS (SELECT *, 1.4826 * median(abs(fr / fg - mr)) FILTER (k) OVER w AS sr, 1.4826 * median(abs(fb / fg - mb)) FILTER (k) OVER w AS sb FROM a{i} WINDOW w AS (PARTITION BY session)),
        c{i} AS (SELECT *, k AND (sr < 1e-12 OR abs(fr / fg - mr) < 3 * sr) AND (sb < 1e-12 OR abs(fb / fg - mb) < 3 * sb) AS i FROM b{i}),
        k{i + 1} AS (SELECT session, fr, fg, fb, CASE WHEN count(*) FILTER (i) OVER (PARTITION BY session) >= 5 THEN i ELSE k END AS k FROM c{i})"""
        for i in range(3)
    )
    + """ SELECT session, round(median(fg) FILTER (k) / median(fr) FILTER (k), 6) AS scale_r, CAST(1.0 AS DOUBLE) AS scale_g, round(median(fg) FILTER (k) / median(fb) FILTER (k), 6) AS scale_b, count(*) FILTER (k) AS n_stars FROM k3 GROUP BY session""",
    "validate_frames": f"""WITH {PLAIN_SQL}, u AS (SELECT session, frame_id, CASE WHEN frame_id % 11 = 0 THEN 7.0 WHEN frame_id % 13 = 0 AND y < 5 THEN 0.0 ELSE v END AS v FROM px), t AS (SELECT *, max(v) OVER (PARTITION BY session, frame_id) AS top FROM u)
        SELECT session, frame_id, CASE WHEN stddev_pop(v) < 0.1 THEN 'constant' WHEN avg((v = top)::INTEGER) > 0.95 THEN 'saturated' WHEN avg((v = 0)::INTEGER) > 0.5 THEN 'mostly zero' WHEN quantile_cont(v, 0.99) - quantile_cont(v, 0.01) < 10 THEN 'low dynamic range' END AS reason FROM t GROUP BY session, frame_id""",
    "shift_outliers": f"""WITH {SHIFTS_SQL}, g AS (SELECT *, sqrt(dy * dy + dx * dx) AS g FROM sh), m AS (SELECT *, median(g) OVER (PARTITION BY session) AS m FROM g), s AS (SELECT *, greatest(1.4826 * median(abs(g - m)) OVER (PARTITION BY session), 1) AS s FROM m)
        SELECT session, frame_id, g <= m + 1.5 * s AS shift_ok FROM s""",
    "common_crop": f"""WITH {SHIFTS_SQL}, a AS (SELECT session, least(greatest(ceil(greatest(max(dy), 0)) + 2, 0), 480)::INTEGER AS t, least(greatest(480 + floor(least(min(dy), 0)) - 2, 0), 480)::INTEGER AS b,
        least(greatest(ceil(greatest(max(dx), 0)) + 2, 0), 640)::INTEGER AS l, least(greatest(640 + floor(least(min(dx), 0)) - 2, 0), 640)::INTEGER AS r FROM sh GROUP BY session)
        SELECT session, CASE WHEN t >= b OR l >= r THEN 0 ELSE t END AS top, CASE WHEN t >= b OR l >= r THEN 480 ELSE b END AS bottom, CASE WHEN t >= b OR l >= r THEN 0 ELSE l END AS "left", CASE WHEN t >= b OR l >= r THEN 640 ELSE r END AS "right" FROM a""",
    "dither": f"""WITH {SHIFTS_SQL}, d AS (SELECT *, sqrt(dy * dy + dx * dx) AS g, dy - lag(dy) OVER w AS ey, dx - lag(dx) OVER w AS ex FROM sh WINDOW w AS (PARTITION BY session ORDER BY frame_id)),
        e AS (SELECT *, lag(ey) OVER w AS py, lag(ex) OVER w AS px FROM d WINDOW w AS (PARTITION BY session ORDER BY frame_id)),
        a AS (SELECT session, count(*) AS n, avg(g) AS mean_magnitude, count(DISTINCT (round_even(dy, 0), round_even(dx, 0))) AS unique_positions, count(*) FILTER (g > 0.5) AS nf,
              avg(sin(atan2(dy, dx))) FILTER (g > 0.5) AS s, avg(cos(atan2(dy, dx))) FILTER (g > 0.5) AS c, corr(py, ey) AS cy, corr(px, ex) AS cx FROM e GROUP BY session),
        b AS (SELECT *, CASE WHEN nf >= 3 THEN degrees(sqrt(-2 * ln(greatest(sqrt(s * s + c * c), 1e-12)))) ELSE 0 END AS direction_spread, CASE WHEN n >= 4 THEN (coalesce(cx, 0) + coalesce(cy, 0)) / 2 ELSE 0 END AS autocorrelation FROM a),
        p AS (SELECT *, CASE WHEN n < 3 OR mean_magnitude < 1 THEN 'aligned' WHEN direction_spread > 40 AND abs(autocorrelation) < 0.5 AND unique_positions >= n * 0.5 THEN 'dithered' WHEN NOT direction_spread > 40 OR NOT abs(autocorrelation) < 0.5 THEN 'tracking_drift' ELSE 'dithered' END AS pattern FROM b)
        SELECT session, n, round(mean_magnitude, 4) AS mean_magnitude, unique_positions, round(direction_spread, 4) AS direction_spread, round(autocorrelation, 4) AS autocorrelation, pattern, pattern = 'dithered' AS is_dithered FROM p""",
    "reference_frame": f"""WITH {SHIFTS_SQL}, g0 AS (SELECT *, avg(dy) OVER (PARTITION BY session) AS gy, avg(dx) OVER (PARTITION BY session) AS gx FROM sh),
        """
    + ",".join(
        f"""w{i} AS (SELECT session, frame_id, dy, dx, score, 1 / greatest(sqrt((dy - gy) ** 2 + (dx - gx) ** 2), 1e-9) AS w FROM g{i}),
        g{i + 1} AS (SELECT *, sum(dy * w) OVER (PARTITION BY session) / sum(w) OVER (PARTITION BY session) AS gy, sum(dx * w) OVER (PARTITION BY session) / sum(w) OVER (PARTITION BY session) AS gx FROM w{i})"""
        for i in range(10)
    )
    + """, d AS (SELECT *, sqrt((dy - gy) ** 2 + (dx - gx) ** 2) AS d FROM g10),
        q AS (SELECT session, frame_id, round(0.7 * score / greatest(max(score) OVER (PARTITION BY session), 1e-9) + 0.3 * (1 - d / greatest(max(d) OVER (PARTITION BY session), 1e-9)), 9) AS q FROM d),
        r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY q DESC, frame_id) AS r FROM q) SELECT session, frame_id, round(q, 4) AS quality FROM r WHERE r = 1""",
    "consensus_reference": f"""WITH {SHIFTS_SQL}, m AS (SELECT *, median(dy) OVER (PARTITION BY session) AS my, median(dx) OVER (PARTITION BY session) AS mx FROM sh),
        r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY (dy - my) ** 2 + (dx - mx) ** 2, frame_id) AS r FROM m) SELECT session, frame_id FROM r WHERE r = 1""",
    "stack_reference": f"""{_GATE_SQL}, r AS (SELECT session, frame_id, score, row_number() OVER (PARTITION BY session ORDER BY round(score, 6) DESC, frame_id) AS r FROM gate WHERE reject_reason IS NULL)
        SELECT session, frame_id, round(score, 3) AS score FROM r WHERE r = 1""",
    "session_signals": f"""WITH {PIXELS_SQL}, s AS (SELECT session, avg((v > 1000)::INTEGER) AS fill, avg((v > 1100)::INTEGER) AS diffuse, quantile_cont(v, 0.99) / max(v) AS peak, count(DISTINCT frame_id) AS frames FROM px GROUP BY session)
        SELECT session, round(fill, 6) AS fill, round(diffuse, 6) AS diffuse, round(peak, 6) AS peak, frames, CASE WHEN peak > 0.8 AND frames > 500 THEN 'globular' WHEN fill > 0.6 AND diffuse < 0.2 THEN 'wide_field' WHEN peak > 0.6 AND diffuse > 0.3 THEN 'planetary'
        WHEN frames > 200 AND diffuse < 0.15 THEN 'star_field' WHEN diffuse > 0.5 THEN 'emission' WHEN diffuse > 0.25 AND peak > 0.3 THEN 'galaxy' WHEN diffuse > 0.15 THEN 'reflection' ELSE 'unknown' END AS target FROM s""",
    "advisor_blend": f"""WITH {PIXELS_SQL}, s AS (SELECT session, round(avg((v > 1000)::INTEGER), 6) AS fill, round(avg((v > 1100)::INTEGER), 6) AS diffuse, round(quantile_cont(v, 0.99) / max(v), 6) AS peak FROM px GROUP BY session),
        a(preset, f, d, p) AS (VALUES ('galaxy', 0.4::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE), ('emission', 0.7, 0.6, 0.3), ('star_field', 0.5, 0.1, 0.9)),
        w AS (SELECT session, preset, 1 / (sqrt((fill - f) ** 2 + (diffuse - d) ** 2 + (peak - p) ** 2) + 0.05) ** 2 AS w FROM s CROSS JOIN a) SELECT session, preset, round(w / sum(w) OVER (PARTITION BY session), 5) AS weight FROM w""",
}
