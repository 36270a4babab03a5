"""Mosaics and merged stacks: files in, files out; and the registered queries over the frame table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import scalars as S
from skyfold.operators import combine as C
from skyfold.operators import corrections, merging, panels
from skyfold.operators import tiles as T
from skyfold.plans import run
from skyfold.plans.stacking import PIXELS_SQL, _rounded
from skyfold.plans.tables import SIDE, pixels
from skyfold.sources import frames as files

#: Keywords that a mosaic takes over from its first panel (fixed values).
CARRIED = ("TELESCOP", "INSTRUME", "FOCALLEN", "XPIXSZ", "YPIXSZ", "OBSERVER", "OBJECT")


def stitch(solved: DataFrame, keys: list[str], size: int | None = None, level: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grid, sky offsets and tiles of mosaics of panels with a `wcs`.

    The panels' blocks are made twice, for the overlaps and for the sums; write `panels.blocks` to a table to make them once.
    """
    grid = panels.common_grid(solved, keys)
    cut = panels.blocks(solved, grid, keys, size or panels.side(solved, keys), level)
    shifts = panels.offsets(panels.overlaps(cut, keys), keys)
    return grid, shifts, panels.coadd(cut, shifts, keys)


def load_panels(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Panels (panel, channel, header, height, width, data, wcs) of the stacks under a path; one that is not solved is an error."""
    found = files.scan(spark, path, recursive=recursive).filter("data IS NOT NULL").withColumn("panel", F.concat_ws("#", "path", F.when(F.col("frame_index") > 0, F.col("frame_index"))))
    solved = panels.solution(found)
    missing = solved.filter("wcs IS NULL").select("panel").orderBy("panel").limit(5).collect()  # for the message
    if missing:
        raise ValueError(f"panels without a usable solution: {', '.join(r['panel'] for r in missing)}")
    return run.planes(solved, ["panel", "header", "wcs"])


def stitch_directory(spark: SparkSession, path: str, output: str, name: str = "mosaic", formats: tuple[str, ...] = ("fits", "jpg"), recursive: bool = False) -> DataFrame:
    """The mosaic of the solved stacks under a path, written with its own solution; returns the sky offsets of its panels."""
    solved = load_panels(spark, path, recursive).withColumn("mosaic", F.lit(name))
    stored = run.Phases(spark, output, name, run.manifest(spark, path))
    grid = stored.get("grid", lambda: panels.common_grid(solved, ["mosaic"]))
    cut = stored.get("blocks", lambda: panels.blocks(solved, grid, ["mosaic"], panels.side(solved, ["mosaic"])))
    shifts = stored.get("offsets", lambda: panels.offsets(panels.overlaps(cut, ["mosaic"]), ["mosaic"]))
    tiles = stored.get("tiles", lambda: panels.coadd(cut, shifts, ["mosaic"]))
    g = grid.first()
    names = [r["panel"] for r in solved.select("panel").distinct().orderBy("panel").limit(1000).collect()]  # a header has room for a thousand
    if g is None:
        raise ValueError("no panels")
    first = solved.filter(F.col("panel") == names[0]).select("header").first()["header"]
    header = {k: first[k] for k in CARRIED if k in first} | {
        "CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CUNIT1": "deg", "CUNIT2": "deg", "CRVAL1": repr(g["grid_ra"]), "CRVAL2": repr(g["grid_dec"]),
        "CRPIX1": repr(1.0 - g["grid_left"]), "CRPIX2": repr(1.0 - g["grid_bottom"]), "CD1_1": repr(-g["grid_scale"]), "CD1_2": "0.0", "CD2_1": "0.0", "CD2_2": repr(g["grid_scale"]),
        "NPANELS": str(solved.select("panel").distinct().count()), "COMBINED": "T",
    } | {f"PANEL{i:03d}": n.rsplit("/", 1)[-1][:68] for i, n in enumerate(names)}
    image = run._one_image(T.to_planes(tiles, ["channel"]), ())
    _write(image, name, header, formats, output)
    return shifts


def _write(image: DataFrame, name: str, header: dict[str, str], formats: tuple[str, ...], output: str) -> None:
    titled = image.select(F.lit(name).alias("name"), F.create_map(*[F.lit(x) for kv in header.items() for x in kv]).alias("header"), "channels", "height", "width", "data")
    for kind in formats:
        files.write_files(files.encode(titled, kind), output).collect()


def mosaic_run(spark: SparkSession, root: str, output: str, plan: run.StackPlan | None = None) -> DataFrame:
    """Stacks every folder below a root by itself and stitches the stacks; returns the panels' sky offsets.

    Runs of folders follow each other, as each fills the cluster.
    """
    folder = F.regexp_extract("path", "^(.*)/[^/]+$", 1)
    found = files.discover(spark, root, recursive=True).filter("frame_type = 'light'").select(folder.alias("folder")).distinct().orderBy("folder")
    for i, row in enumerate(found.collect()):  # one row a folder
        run.stack_directory(spark, row["folder"], f"{output.rstrip('/')}/panels/{i:03d}", plan, keep_phases=False)
    return stitch_directory(spark, f"{output.rstrip('/')}/panels/*/stack.fits", output)


def load_stacks(spark: SparkSession, path: str) -> DataFrame:
    """Linear stacks under a path: (stack, header, frames, channels, height, width, data); one that is not linear is an error."""
    found = files.scan(spark, path).filter("data IS NOT NULL").withColumn("stack", F.col("path"))
    wrong = found.filter(F.coalesce(F.try_element_at("header", F.lit("RAWSTACK")), F.lit("F")) != "T").select("stack").orderBy("stack").limit(5).collect()
    if wrong:
        raise ValueError(f"not linear stacks (RAWSTACK): {', '.join(r['stack'] for r in wrong)}")
    return found.withColumn("frames", S.header_number(F.col("header"), "NFRAMES").cast("int")).select("stack", "header", "frames", "channels", "height", "width", "data")


def merge_directory(spark: SparkSession, current: str, earlier: str, output: str, formats: tuple[str, ...] = ("fits",), strict: bool = True) -> DataFrame:
    """Merges the linear stacks under `earlier` into the one at `current` and writes `merged`; returns the placements.

    A stack that covers or resembles the current one too little is an error, or with `strict` off is left out.
    """
    new, old = (load_stacks(spark, p).withColumn("target", F.lit(0)) for p in (current, earlier))
    if new.count() != 1:
        raise ValueError("one current stack is needed")
    n = new.first()["channels"]
    if n != 1:
        new, old = files.rgb(new), files.rgb(old)
    else:
        old = files.luminance(old)
    stored = run.Phases(spark, output, "merge", f"{run.manifest(spark, current)}+{run.manifest(spark, earlier)}")
    placed = stored.get("placements", lambda: merging.place(files.luminance(old), files.luminance(new), ["target"]))
    refused = placed.filter("NOT allowed").orderBy("stack").limit(5).collect()
    if refused and strict:
        raise ValueError("not merged: " + ", ".join(f"{r['stack']} (overlap {r['overlap']:.2f}, correlation {r['correlation'] or 0:.2f})" for r in refused))
    taken = placed.filter("allowed")
    tiles = stored.get("merged", lambda: merging.merge(run.planes(new, ["target", "stack", "frames"]), run.planes(old, ["target", "stack", "frames"]), taken, ["target"]))
    number = lambda *names: F.coalesce(S.header_number(F.col("header"), *names), F.lit(0.0))
    text = lambda name: F.try_element_at("header", F.lit(name))
    sources = new.unionByName(old.join(taken.select("stack"), "stack", "left_semi")).select(
        "target", F.regexp_extract("stack", "([^/]+)$", 1).alias("source"), F.coalesce("frames", F.lit(0)).alias("frames"), number("TOTEXP").alias("seconds"), text("DATEFRST").alias("first"), text("DATELAST").alias("last")
    )
    h = corrections.merged_headers(sources, ["target"]).first()
    names = [r[0] for r in taken.select(F.regexp_extract("stack", "([^/]+)$", 1)).orderBy("stack").limit(20).collect()]  # what a header has room for
    header = new.first()["header"]
    header = {k: v for k, v in header.items() if k not in ("SIMPLE", "BITPIX", "EXTEND") and not k.startswith("NAXIS")}
    header |= {"RAWSTACK": "T", "NFRAMES": str(h["frames"]), "TOTEXP": repr(h["seconds"]), "MERGED": str(h["merged"] - 1)} | {k: v for k, v in (("DATEFRST", h["first"]), ("DATELAST", h["last"])) if v}
    header |= {f"MRGSRC{i + 1}": name[:68] for i, name in enumerate(names)}
    _write(run._one_image(T.to_planes(tiles, ["channel"]), ()), "merged", header, formats, output)
    return placed


# ---- queries


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session means as turned panels: two neighbouring sessions make a mosaic, of which the second lies 3 pixels west and 2 north."""
    means = C.mean(pixels(spark, sf_dir), ["session", "y", "x"])
    p = means.groupBy(F.col("session").alias("panel")).agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "value"))), lambda s: s["value"]).alias("data"))
    second = F.col("panel") % 2
    mosaic = F.floor(F.col("panel") / 2).cast("int")
    turn = F.lit(0.1) - 0.25 * second
    values = {
        "CRVAL1": 40.0 + 10 * mosaic - 0.03 * second, "CRVAL2": 20.0 + mosaic + 0.02 * second, "CRPIX1": F.lit(4.3), "CRPIX2": F.lit(4.6),
        "CD1_1": -0.01 * F.cos(turn), "CD1_2": 0.01 * F.sin(turn), "CD2_1": 0.01 * F.sin(turn), "CD2_2": 0.01 * F.cos(turn),
    }
    header = F.create_map(F.lit("CTYPE1"), F.lit("RA---TAN"), F.lit("CTYPE2"), F.lit("DEC--TAN"), *(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))
    rows = p.select(mosaic.alias("mosaic"), "panel", F.lit(0).alias("channel"), header.alias("header"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), "data")
    return panels.solution(rows)


def panel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common plane of each mosaic."""
    found = panels.common_grid(_panels(spark, sf_dir), ["mosaic"])
    return _rounded(found, "grid_ra", "grid_dec", "grid_scale", places=6)


def panel_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two panels differ where both cover their mosaic's plane."""
    p = _panels(spark, sf_dir)
    cut = panels.blocks(p, panels.common_grid(p, ["mosaic"]), ["mosaic"], 4, level=False)
    return _rounded(panels.overlaps(cut, ["mosaic"]).drop("channel"), "difference")


def panel_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole mosaics: reprojected panels with matched skies, added up by feathered weights."""
    _, _, tiles = stitch(_panels(spark, sf_dir), ["mosaic"], 4, level=False)
    return _rounded(T.to_pixels(tiles, ["mosaic"]).filter("n_used > 0").select("mosaic", "y", "x", "value", F.col("n_used").alias("panels")), "value")


def merged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd frames of a session, cut to six columns, laid one line down and two columns left on the even ones, by frame counts."""
    px = pixels(spark, sf_dir).withColumn("half", F.col("frame_id") % 2).filter("half = 0 OR x < 6")
    means = px.groupBy("session", "half", "y", "x").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("frames"))
    plane = means.groupBy("session", "half").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("data"), F.max("frames").alias("frames"))
    stacks = plane.select("session", F.col("half").alias("stack"), F.lit(0).alias("channel"), "frames", F.lit(SIDE).alias("height"), F.when(F.col("half") == 0, SIDE).otherwise(6).alias("width"), "data")
    placed = stacks.filter("stack = 1").select("session", "stack", F.lit(1.0).alias("dy"), F.lit(-2.0).alias("dx"), F.lit(0.0).alias("angle"))
    tiles = merging.merge(stacks.filter("stack = 0"), stacks.filter("stack = 1"), placed, ["session"], 8)
    return _rounded(T.to_pixels(tiles, ["session"]), "value").select("session", "y", "x", "value", F.col("n_used").alias("stacks"))


QUERIES = {q.__name__: q for q in (panel_grid, panel_overlaps, panel_mosaic, merged_sessions)}

_GRID_SQL = f"""WITH {PIXELS_SQL}, m AS (SELECT session AS panel, y, x, avg(v) AS v FROM px GROUP BY ALL),
    p AS (SELECT DISTINCT panel, panel // 2 AS mosaic, radians(40 + 10 * (panel // 2) - 0.03 * (panel % 2)) AS a, radians(20 + panel // 2 + 0.02 * (panel % 2)) AS d, 0.1 - 0.25 * (panel % 2) AS t FROM m),
    k AS (SELECT p.*, cx, cy FROM p, (VALUES (-0.5), (7.5)) u(cx), (VALUES (-0.5), (7.5)) w(cy)),
    q AS (SELECT *, radians(0.01) * (-cos(t) * (cx - 3.3) + sin(t) * (cy - 3.6)) AS e, radians(0.01) * (sin(t) * (cx - 3.3) + cos(t) * (cy - 3.6)) AS n FROM k),
    dir AS (SELECT mosaic, (cos(d) * cos(a) - e * sin(a) - n * sin(d) * cos(a)) / sqrt(1 + e * e + n * n) AS vx, (cos(d) * sin(a) + e * cos(a) - n * sin(d) * sin(a)) / sqrt(1 + e * e + n * n) AS vy, (sin(d) + n * cos(d)) / sqrt(1 + e * e + n * n) AS vz FROM q),
    c AS (SELECT mosaic, atan2(sum(vy), sum(vx)) AS a0, atan2(sum(vz), sqrt(sum(vx) ** 2 + sum(vy) ** 2)) AS d0 FROM dir GROUP BY mosaic),
    pl AS (SELECT mosaic, a0, d0, -degrees((vy * cos(a0) - vx * sin(a0)) / r) / 0.01 AS gx, degrees((vz * cos(d0) - sin(d0) * (vx * cos(a0) + vy * sin(a0))) / r) / 0.01 AS gy FROM (SELECT *, vx * cos(d0) * cos(a0) + vy * cos(d0) * sin(a0) + vz * sin(d0) AS r FROM dir JOIN c USING (mosaic))),
    grid AS (SELECT mosaic, a0, d0, ceil(min(gx))::INT AS l, ceil(min(gy))::INT AS b, floor(max(gy))::INT - ceil(min(gy))::INT + 1 AS h, floor(max(gx))::INT - ceil(min(gx))::INT + 1 AS w FROM pl GROUP BY ALL)"""
# each grid sample goes by its sky direction to each panel's pixels; a feathered weight is the distance to the edge, over 4
_REPROJECTED_SQL = f"""{_GRID_SQL}, cell AS (SELECT mosaic, a0, d0, y, x, radians(-0.01 * (x + l)) AS e, radians(0.01 * (y + b)) AS n FROM grid, range(64) ry(y), range(64) rx(x) WHERE y < h AND x < w),
    s AS (SELECT mosaic, y, x, cos(d0) * cos(a0) - e * sin(a0) - n * sin(d0) * cos(a0) AS vx, cos(d0) * sin(a0) + e * cos(a0) - n * sin(d0) * sin(a0) AS vy, sin(d0) + n * cos(d0) AS vz FROM cell),
    on_panel AS (SELECT s.mosaic, panel, y, x, t, degrees((vy * cos(a) - vx * sin(a)) / r) / 0.01 AS e, degrees((vz * cos(d) - sin(d) * (vx * cos(a) + vy * sin(a))) / r) / 0.01 AS n FROM (SELECT s.*, p.panel, p.a, p.d, p.t, vx * cos(d) * cos(a) + vy * cos(d) * sin(a) + vz * sin(d) AS r FROM s JOIN p ON s.mosaic = p.mosaic) s),
    placed AS (SELECT mosaic, panel, y, x, 3.3 - e * cos(t) + n * sin(t) AS sx, 3.6 + e * sin(t) + n * cos(t) AS sy FROM on_panel),
    inner_at AS (SELECT *, floor(sx)::INT AS ix, floor(sy)::INT AS iy FROM placed WHERE sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7),
    r AS (SELECT mosaic, i.panel, i.y, i.x, sum((1 - abs(sx - m.x)) * (1 - abs(sy - m.y)) * v) AS v, sum((1 - abs(sx - m.x)) * (1 - abs(sy - m.y)) * least(m.y + 1, 8 - m.y, m.x + 1, 8 - m.x) / 4.0) AS w
        FROM inner_at i JOIN m ON m.panel = i.panel AND m.x IN (ix, ix + 1) AND m.y IN (iy, iy + 1) GROUP BY ALL),
    o AS (SELECT a.mosaic, a.panel AS a, b.panel AS b, count(*) AS n, avg(a.v - b.v) AS difference FROM r a JOIN r b ON a.mosaic = b.mosaic AND a.y = b.y AND a.x = b.x AND a.panel < b.panel GROUP BY ALL)"""

ORACLE_SQL = {
    "panel_grid": f"""{_GRID_SQL} SELECT mosaic, round(degrees(a0), 6) AS grid_ra, round(degrees(d0), 6) AS grid_dec, 0.01 AS grid_scale, l AS grid_left, b AS grid_bottom, h AS grid_height, w AS grid_width FROM grid""",
    "panel_overlaps": f"""{_REPROJECTED_SQL} SELECT mosaic, a, b, n, round(difference, 3) AS difference FROM o""",
    "panel_mosaic": f"""{_REPROJECTED_SQL} SELECT r.mosaic, y, x, round(sum(w * (v + CASE WHEN o.n IS NULL THEN 0 WHEN panel = o.a THEN -difference / 2 ELSE difference / 2 END)) / sum(w), 3) AS value, count(*) AS panels FROM r LEFT JOIN o ON r.mosaic = o.mosaic GROUP BY ALL""",
    "merged_sessions": f"""WITH {PIXELS_SQL}, s AS (SELECT session, frame_id % 2 AS half, y, x, avg(v) AS v, count(*) AS n FROM px GROUP BY ALL)
        SELECT a.session, a.y, a.x, round((a.n * a.v + coalesce(b.n * b.v, 0)) / (a.n + coalesce(b.n, 0)), 3) AS value, 1 + count(b.n) AS stacks FROM s a LEFT JOIN s b ON a.session = b.session AND b.half = 1 AND b.x < 6 AND b.y = a.y - 1 AND b.x = a.x + 2
        WHERE a.half = 0 GROUP BY ALL""",
}
