"""Registered queries: one stacked image per session, by every combiner; and combiners over other grouped samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.operators import combine as C
from skyfold.plans.tables import arrivals, pixels, table

KEYS = ["session", "y", "x"]

PIXELS_SQL = """px AS (
    SELECT CAST(label AS INTEGER) AS session, vec_id AS frame_id, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
           1000 + 1000 * e + CASE WHEN (vec_id * 7 + p) % 53 = 0 THEN 5000 ELSE 0 END AS v
    FROM (SELECT vec_id, label, unnest(generate_series(0, len(embedding) - 1)) AS p, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings)
)"""


def _rounded(df: DataFrame, *names: str, places: int = 3) -> DataFrame:
    return df.withColumns({n: F.round(n, places) + 0.0 for n in names})


def _stack(method: str, **params: object):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(C.combine(pixels(spark, sf_dir), KEYS, "v", method, **params), "value").select(*KEYS, "value", "n_used", "n_rejected")

    return query


def _clip_sql(robust: bool, sigma: float, iterations: int) -> str:
    """Chained CTEs k0..kn: survivors as rows with a flag."""
    parts = [PIXELS_SQL, "k0 AS (SELECT *, TRUE AS k FROM px)"]
    for i in range(iterations):
        centre = "median(v) FILTER (k)" if robust else "avg(v) FILTER (k)"
        parts.append(f"c{i} AS (SELECT *, {centre} OVER w AS c, median(v) FILTER (k) OVER w AS md, stddev_pop(v) FILTER (k) OVER w AS sd FROM k{i} WINDOW w AS (PARTITION BY session, y, x))")
        parts.append(f"m{i} AS (SELECT *, 1.4826 * median(abs(v - md)) FILTER (k) OVER w AS mad FROM c{i} WINDOW w AS (PARTITION BY session, y, x))")
        first, second = ("mad", "sd") if robust else ("sd", "mad")
        parts.append(f"s{i} AS (SELECT *, k AND abs(v - c) <= {sigma} * CASE WHEN {first} < 1e-12 THEN {second} ELSE {first} END AS inside FROM m{i})")
        parts.append(f"k{i + 1} AS (SELECT session, frame_id, y, x, v, CASE WHEN count(*) FILTER (inside) OVER (PARTITION BY session, y, x) > 0 THEN inside ELSE k END AS k FROM s{i})")
    return "WITH " + ", ".join(parts)


def _clip_oracle(robust: bool, sigma: float = 3.0, iterations: int = 3) -> str:
    return _clip_sql(robust, sigma, iterations) + f""" SELECT session, y, x, round(avg(v) FILTER (k), 3) AS value, count(*) FILTER (k) AS n_used, count(*) FILTER (NOT k) AS n_rejected
        FROM k{iterations} GROUP BY session, y, x"""


def _winsor_oracle(sigma: float = 3.0, iterations: int = 3) -> str:
    return _clip_sql(True, sigma, iterations) + f""", e AS (SELECT *, median(v) FILTER (k) OVER (PARTITION BY session, y, x) AS c FROM k{iterations}),
        f AS (SELECT *, greatest(1.4826 * median(abs(v - c)) FILTER (k) OVER (PARTITION BY session, y, x), 1e-12) AS s FROM e)
        SELECT session, y, x, round(avg(greatest(least(v, c + {sigma} * s), c - {sigma} * s)), 3) AS value, count(*) AS n_used, CAST(0 AS BIGINT) AS n_rejected FROM f GROUP BY session, y, x"""


def _esd_oracle(most: int = 130, significance: float = 0.05) -> str:
    """The farthest sample of a sorted list is its first or its last; critical values are listed for up to `most` samples."""
    limits = ", ".join(f"({n}, {C.esd_limit(n, significance)!r}::DOUBLE)" for n in range(3, most + 1))
    return f"""WITH RECURSIVE {PIXELS_SQL}, critical(n, c) AS (VALUES {limits}),
        st AS (SELECT session, y, x, list(v ORDER BY v) AS l, count(*) AS n0, CAST(0 AS BIGINT) AS i, TRUE AS more FROM px GROUP BY session, y, x
            UNION ALL
            SELECT session, y, x, CASE WHEN NOT hit THEN l WHEN low THEN l[2:] ELSE l[:-2] END, n0, i + 1, hit
            FROM (SELECT *, greatest(m - l[1], l[-1] - m) / greatest(s, 1e-12) > c AS hit, m - l[1] >= l[-1] - m AS low
                  FROM (SELECT st.*, list_avg(l) AS m, list_stddev_samp(l) AS s, c FROM st JOIN critical ON critical.n = n0 - 2 * i WHERE more AND i < greatest(1, n0 // 4)))),
        last AS (SELECT session, y, x, arg_max(l, i) AS l, any_value(n0) AS n0 FROM st GROUP BY session, y, x)
        SELECT session, y, x, round(list_avg(l), 3) AS value, CAST(len(l) AS BIGINT) AS n_used, CAST(n0 - len(l) AS BIGINT) AS n_rejected FROM last"""


def _fit_oracle(iterations: int = 5) -> str:
    w = "WINDOW w AS (PARTITION BY session, y, x)"
    parts = [PIXELS_SQL, "k0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY session, y, x ORDER BY v, frame_id) - 1 AS DOUBLE) AS r, TRUE AS k FROM px)"]
    for i in range(iterations):
        parts += [
            f"a{i} AS (SELECT *, count(*) FILTER (k) OVER w AS n, avg(r) FILTER (k) OVER w AS mr, avg(v) FILTER (k) OVER w AS mv FROM k{i} {w})",
            f"b{i} AS (SELECT *, sum((r - mr) * (r - mr)) FILTER (k) OVER w AS rr, sum((r - mr) * (v - mv)) FILTER (k) OVER w AS rv FROM a{i} {w})",
            f"c{i} AS (SELECT *, v - (mv + CASE WHEN n >= 2 THEN rv / CASE WHEN rr <= 1e-12 THEN 1 ELSE rr END ELSE 0 END * (r - mr)) AS e FROM b{i})",
            f"d{i} AS (SELECT *, greatest(sqrt(sum(e * e) FILTER (k) OVER w / greatest(n - 1, 1)), 1e-6) AS s FROM c{i} {w})",
            f"f{i} AS (SELECT *, k AND (e < -4 * s OR e > 2 * s) AS bad FROM d{i})",
            f"g{i} AS (SELECT *, count(*) FILTER (bad) OVER w AS nb FROM f{i} {w})",
            f"k{i + 1} AS (SELECT session, frame_id, y, x, v, r, k AND NOT (bad AND n >= 2 AND n - nb >= 2) AS k FROM g{i})",
        ]
    return "WITH " + ", ".join(parts) + f" SELECT session, y, x, round(avg(v) FILTER (k), 3) AS value, count(*) FILTER (k) AS n_used, count(*) FILTER (NOT k) AS n_rejected FROM k{iterations} GROUP BY session, y, x"


def stack_ivw(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = pixels(spark, sf_dir).withColumns({"noise": (F.col("frame_id") % 7 + 3).cast("double"), "sky": F.lit(900.0)})
    return _rounded(C.inverse_variance(noisy, KEYS, gain=1.5), "value").select(*KEYS, "value", "n_used")


def stack_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = pixels(spark, sf_dir).withColumn("w", 0.5 + (F.col("frame_id") % 10) / 10.0)
    return _rounded(C.mean(weighted, KEYS, "v", "w"), "value").select(*KEYS, "value", "n_used")


def stack_online_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.online_clip(pixels(spark, sf_dir), KEYS, "v", "frame_id", sigma=3.0, burn_in=10)
    return _rounded(found, "value").select(*KEYS, "value", "n_used", "n_rejected")


def master_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median master frame of all sessions' frames, with its flat-field normalisation."""
    master = C.median(pixels(spark, sf_dir), ["y", "x"]).select("y", "x", F.col("value").alias("master"))
    middle = master.agg(F.median("master")).first()[0]  # one number
    flat = F.greatest(F.least(F.col("master") / F.lit(middle), F.lit(2.5)), F.lit(0.4))
    return _rounded(master.select("y", "x", "master", flat.alias("flat_norm")), "master", "flat_norm", places=6)


def part_price_sigma_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combiner over any grouped samples: prices per part, weighted by quantity."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity"))
    return _rounded(C.sigma_clip(items, ["l_partkey"], "price", "quantity", sigma=2.0, iterations=2), "value", places=2)


def event_online_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.online_clip(arrivals(spark, sf_dir), ["session"], "v", "seq", sigma=2.0, burn_in=10)
    return _rounded(found, "value").select("session", "value", "n_used", "n_rejected")


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square-root weights of frames from their session's best mean signal."""
    scores = pixels(spark, sf_dir, False).groupBy("session", "frame_id").agg(F.avg("v").alias("score"))
    w = Window.partitionBy("session")
    return _rounded(scores.select("session", "frame_id", F.sqrt(F.col("score") / F.greatest(F.max("score").over(w), F.lit(1e-9))).alias("weight")), "weight", places=6)


def local_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame and 4x4 cell the 30th percentile against the session's median of that cell."""
    cells = pixels(spark, sf_dir, False).groupBy("session", "frame_id", F.floor(F.col("y") / 4).cast("int").alias("cy"), F.floor(F.col("x") / 4).cast("int").alias("cx")).agg(F.percentile("v", F.lit(0.3)).alias("level"))
    w = Window.partitionBy("session", "cy", "cx")
    return _rounded(cells.select("session", "frame_id", "cy", "cx", "level", (F.col("level") - F.median("level").over(w)).alias("deviation")), "level", "deviation")


QUERIES = {
    "stack_mean": _stack("mean"),
    "stack_median": _stack("median"),
    "stack_sigma_clip": _stack("sigma_clip"),
    "stack_sigma_clip_std": _stack("sigma_clip", robust=False),
    "stack_winsorized": _stack("winsorized"),
    "stack_percentile": _stack("percentile"),
    "stack_linear_fit": _stack("linear_fit", order=None),
    "stack_trimmed_mean": _stack("trimmed_mean"),
    "stack_esd": _stack("esd"),
    "stack_ivw": stack_ivw,
    "stack_weighted_mean": stack_weighted_mean,
    "stack_online_clip": stack_online_clip,
    "master_median": master_median,
    "part_price_sigma_clip": part_price_sigma_clip,
    "event_online_clip": event_online_clip,
    "quality_weights": quality_weights,
    "local_normalize": local_normalize,
}

_GROUP = "FROM px GROUP BY session, y, x"


def _online_sql(source: str, keys: str, sigma: float) -> str:
    """Seed from ten samples, then a recursive fold, one sample a step."""
    return f"""WITH RECURSIVE {source},
        numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seq) AS i FROM samples),
        c AS (SELECT *, median(v) OVER (PARTITION BY {keys}) AS c FROM numbered WHERE i <= 10),
        d AS (SELECT *, greatest(1.4826 * median(abs(v - c)) OVER (PARTITION BY {keys}), 1e-6) AS s FROM c),
        g AS (SELECT * FROM d WHERE abs(v - c) <= {sigma} * s),
        gm AS (SELECT *, avg(v) OVER (PARTITION BY {keys}) AS m FROM g),
        seed AS (SELECT {keys}, CAST(10 AS BIGINT) AS i, count(*) AS n, max(m) AS mean, sum((v - m) * (v - m)) AS m2 FROM gm GROUP BY {keys}),
        fold AS (
            SELECT {keys}, i, n, mean, m2 FROM seed
            UNION ALL
            SELECT {", ".join("f." + k.strip() for k in keys.split(","))}, x.i,
                CASE WHEN abs(x.v - f.mean) <= {sigma} * sqrt(greatest(f.m2 / f.n, 1e-12)) THEN f.n + 1 ELSE f.n END,
                CASE WHEN abs(x.v - f.mean) <= {sigma} * sqrt(greatest(f.m2 / f.n, 1e-12)) THEN f.mean + (x.v - f.mean) / (f.n + 1) ELSE f.mean END,
                CASE WHEN abs(x.v - f.mean) <= {sigma} * sqrt(greatest(f.m2 / f.n, 1e-12)) THEN f.m2 + (x.v - f.mean) * (x.v - (f.mean + (x.v - f.mean) / (f.n + 1))) ELSE f.m2 END
            FROM fold f JOIN numbered x ON {" AND ".join(f"f.{k.strip()} = x.{k.strip()}" for k in keys.split(","))} AND x.i = f.i + 1
        ),
        total AS (SELECT {keys}, count(*) AS t FROM numbered GROUP BY {keys}),
        last AS (SELECT {keys}, round(arg_max(mean, i), 3) AS value, arg_max(n, i) AS n_used FROM fold GROUP BY {keys})
        SELECT {keys}, value, n_used, t - n_used AS n_rejected FROM last JOIN total USING ({keys})"""


ORACLE_SQL = {
    "stack_esd": _esd_oracle(),
    "stack_mean": f"WITH {PIXELS_SQL} SELECT session, y, x, round(avg(v), 3) AS value, count(*) AS n_used, CAST(0 AS BIGINT) AS n_rejected {_GROUP}",
    "stack_median": f"WITH {PIXELS_SQL} SELECT session, y, x, round(median(v), 3) AS value, count(*) AS n_used, CAST(0 AS BIGINT) AS n_rejected {_GROUP}",
    "stack_sigma_clip": _clip_oracle(True),
    "stack_sigma_clip_std": _clip_oracle(False),
    "stack_winsorized": _winsor_oracle(),
    "stack_percentile": f"""WITH {PIXELS_SQL}, p AS (SELECT *, quantile_cont(v, 0.2) OVER (PARTITION BY session, y, x) AS lo, quantile_cont(v, 0.8) OVER (PARTITION BY session, y, x) AS hi FROM px)
        SELECT session, y, x, round(avg(v) FILTER (v BETWEEN lo AND hi), 3) AS value, count(*) FILTER (v BETWEEN lo AND hi) AS n_used, count(*) FILTER (NOT v BETWEEN lo AND hi) AS n_rejected FROM p GROUP BY session, y, x""",
    "stack_linear_fit": _fit_oracle(),
    "stack_trimmed_mean": f"""WITH {PIXELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session, y, x ORDER BY v) AS r, count(*) OVER (PARTITION BY session, y, x) AS n FROM px),
        k AS (SELECT *, r > floor(n * 0.1) AND r <= n - floor(n * 0.1) AS k FROM r)
        SELECT session, y, x, round(avg(v) FILTER (k), 3) AS value, count(*) FILTER (k) AS n_used, count(*) FILTER (NOT k) AS n_rejected FROM k GROUP BY session, y, x""",
    "stack_ivw": f"""WITH {PIXELS_SQL}, w AS (SELECT *, 1 / greatest((frame_id % 7 + 3) * (frame_id % 7 + 3) + greatest(v - 900, 0) / 1.5, 1e-12) AS w FROM px)
        SELECT session, y, x, round(sum(w * v) / sum(w), 3) AS value, count(*) AS n_used FROM w GROUP BY session, y, x""",
    "stack_weighted_mean": f"""WITH {PIXELS_SQL} SELECT session, y, x, round(sum((0.5 + (frame_id % 10) / 10.0::DOUBLE) * v) / sum(0.5 + (frame_id % 10) / 10.0::DOUBLE), 3) AS value, count(*) AS n_used {_GROUP}""",
    "stack_online_clip": _online_sql(f"{PIXELS_SQL}, samples AS (SELECT session, y, x, frame_id AS seq, v FROM px)", "session, y, x", 3.0),
    "master_median": f"""WITH {PIXELS_SQL}, m AS (SELECT y, x, median(v) AS master FROM px GROUP BY y, x)
        SELECT y, x, round(master, 6) AS master, round(greatest(least(master / (SELECT median(master) FROM m), 2.5), 0.4), 6) AS flat_norm FROM m""",
    "part_price_sigma_clip": """WITH k0 AS (SELECT l_partkey, CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_quantity AS DOUBLE) AS w, TRUE AS k FROM lineitem),
        """
    + ",".join(
        f"""c{i} AS (SELECT *, median(v) FILTER (k) OVER (PARTITION BY l_partkey) AS c, stddev_pop(v) FILTER (k) OVER (PARTITION BY l_partkey) AS sd FROM k{i}),
        m{i} AS (SELECT *, 1.4826 * median(abs(v - c)) FILTER (k) OVER (PARTITION BY l_partkey) AS mad FROM c{i}),
        s{i} AS (SELECT *, k AND abs(v - c) <= 2.0 * CASE WHEN mad < 1e-12 THEN sd ELSE mad END AS inside FROM m{i}),
        k{i + 1} AS (SELECT l_partkey, v, w, CASE WHEN count(*) FILTER (inside) OVER (PARTITION BY l_partkey) > 0 THEN inside ELSE k END AS k FROM s{i})"""
        for i in range(2)
    )
    + """ SELECT l_partkey, round(sum(w * v) FILTER (k) / sum(w) FILTER (k), 2) AS value, count(*) FILTER (k) AS n_used, count(*) FILTER (NOT k) AS n_rejected FROM k2 GROUP BY l_partkey""",
    "event_online_clip": _online_sql("samples AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(value AS DOUBLE) AS v FROM events)", "session", 2.0),
    "quality_weights": f"""WITH {PIXELS_SQL.replace(" + CASE WHEN (vec_id * 7 + p) % 53 = 0 THEN 5000 ELSE 0 END", "")}, s AS (SELECT session, frame_id, avg(v) AS score FROM px GROUP BY session, frame_id)
        SELECT session, frame_id, round(sqrt(score / greatest(max(score) OVER (PARTITION BY session), 1e-9)), 6) AS weight FROM s""",
    "local_normalize": f"""WITH {PIXELS_SQL.replace(" + CASE WHEN (vec_id * 7 + p) % 53 = 0 THEN 5000 ELSE 0 END", "")},
        c AS (SELECT session, frame_id, CAST(y // 4 AS INTEGER) AS cy, CAST(x // 4 AS INTEGER) AS cx, quantile_cont(v, 0.3) AS level FROM px GROUP BY ALL)
        SELECT session, frame_id, cy, cx, round(level, 3) AS level, round(level - median(level) OVER (PARTITION BY session, cy, cx), 3) AS deviation FROM c""",
}
