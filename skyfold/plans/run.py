"""The batch run over a directory of frames: discover, calibrate, score, gate, register, combine, post-process, write.

Each phase is stored under the output folder with a manifest of what went into it; a run with the same inputs and parameters
resumes after the last phase that is complete.

A row is one plane of a frame (frame_id, channel, height, width, data). Colour frames have three; a mosaic becomes three by
debayering. The lead plane (green of three, else the only one) is scored and registered, and its placement moves all planes.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tomllib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.functions import detect, restore
from skyfold.functions import kernels as K
from skyfold.functions import scalars as S
from skyfold.operators import combine as C
from skyfold.operators import image_ops as I
from skyfold.operators import metrics as M
from skyfold.operators import selection as G
from skyfold.operators import tiles as T
from skyfold.plans import calibration
from skyfold.sources import frames as files

#: Named starting points (fixed values); explicit parameters win.
PRESETS: dict[str, dict] = {
    "quick": {"combine": "mean", "clean": (), "post": ()},
    "galaxy": {"combine": "sigma_clip", "post": ("background_mesh", "median_cascade", "local_contrast")},
    "emission": {"combine": "winsorized", "post": ("background_surface", "starlet", "reduce_stars")},
    "star_field": {"combine": "percentile", "post": ("background_mesh", "bilateral")},
    "quality": {"combine": "sigma_clip", "sigma": 2.5, "iterations": 5, "elastic": True, "post": ("background_mesh", "median_cascade", "local_contrast")},
    "narrowband": {"combine": "sigma_clip", "sigma": 2.5, "post": ("background_mesh", "starlet", "reduce_stars")},
    "planetary": {"combine": "percentile", "clean": (), "post": ("richardson_lucy",)},
    "lunar": {"combine": "percentile", "clean": (), "weighted": False, "post": ("local_contrast",)},
}


#: Names of configuration sections that differ from the plan's parameters (fixed values).
CONFIG_NAMES = {"stacking_method": "combine", "stacking_sigma": "sigma", "stacking_iters": "iterations", "quality_sigma": "outlier_sigma", "post_steps": "post", "clean_steps": "clean"}


@dataclass(frozen=True)
class StackPlan:
    """Parameters of a run."""

    combine: str = "sigma_clip"
    sigma: float = 3.0
    iterations: int = 3
    clean: tuple[str, ...] = ("cosmics",)
    post: tuple[str, ...] = ()
    debayer: str = "none"
    quality_threshold: float = 50.0
    outlier_sigma: float = 2.5
    shift_sigma: float = 3.5
    star_sigma: float = 5.0
    drizzle: float = 1.0
    weighted: bool = True
    formats: tuple[str, ...] = ("fits",)
    elastic: bool = False
    #: A folder of calibration frames besides those that lie with the lights.
    calibration: str = ""
    #: Steps of plans/post.py, run on the whole image after `post`, and a folder for previews of each.
    chain: tuple[str, ...] = ()
    sidecars: str = ""

    @staticmethod
    def from_toml(text: str, **explicit: object) -> StackPlan:
        """A plan from configuration text: plain names, or sections whose names are prefixes (`[shift] sigma` is shift_sigma).

        `preset` sets the starting point and explicit parameters win; names that a plan does not have are left out.
        """
        given: dict[str, object] = {}
        for name, value in tomllib.loads(text).items():
            for key, v in value.items() if isinstance(value, dict) else [("", value)]:
                whole = "_".join(p for p in (name, key) if p).replace("-", "_")
                given[CONFIG_NAMES.get(whole, whole)] = tuple(v) if isinstance(v, list) else v
        start = PRESETS.get(str(given.get("preset")), {})
        known = {f.name for f in dataclasses.fields(StackPlan)}
        return dataclasses.replace(StackPlan(**start), **({k: v for k, v in given.items() if k in known} | explicit))

    @staticmethod
    def preset(name: str, **explicit: object) -> StackPlan:
        return dataclasses.replace(StackPlan(**PRESETS[name]), **explicit)

    def key(self) -> str:
        return hashlib.sha256(json.dumps(dataclasses.asdict(self) | {"rows": "planes"}, sort_keys=True).encode()).hexdigest()[:16]


#: Bytes of a frame up to which it is broadcast as reference or master; Spark's limit is 8 GB.
REFERENCE_BYTES = 1 << 30


class Phases:
    """Stored phases of a run; a phase counts once it is whole, and only for the inputs it was made from."""

    def __init__(self, spark: SparkSession, folder: str, key: str, inputs: str = ""):
        self.spark, self.folder, self.key = spark, f"{folder.rstrip('/')}/phases-{key}", key
        marker = f"{self.folder}/inputs"
        if not self._done(marker) or spark.read.parquet(marker).first()["inputs"] != inputs:
            place, fs = self._place(self.folder)
            fs.delete(place, True)
            spark.createDataFrame([(inputs,)], "inputs string").write.mode("overwrite").parquet(marker)

    def get(self, name: str, make: object) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._done(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        """Removes all phases of this plan, as after a run whose results are written."""
        place, fs = self._place(self.folder)
        fs.delete(place, True)

    def _done(self, path: str) -> bool:
        """Spark's committer marks a whole table."""
        marker, fs = self._place(f"{path}/_SUCCESS")
        return fs.exists(marker)

    def _place(self, path: str) -> tuple:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, directory: str) -> str:
    """One value for the paths, sizes and times of a directory's frame files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", files.PATTERN).load(directory).select("path", "length", "modificationTime")
    n, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n}-{total}"


def planes(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames (keys..., channels, height, width, data by planes) as one row a plane (keys..., channel, height, width, data)."""
    size = F.col("height") * F.col("width")
    cut = F.transform(F.sequence(F.lit(0), F.col("channels") - 1), lambda c: F.slice("data", c * size + 1, size))
    return frames.select(*keys, "height", "width", F.posexplode(cut).alias("channel", "data")).select(*keys, "channel", "height", "width", "data")


def _lead(frames: DataFrame) -> DataFrame:
    """The plane of each frame that is measured: the second of three or more, else the first."""
    last = F.max("channel").over(Window.partitionBy("frame_id"))
    leads = frames.select("frame_id", "channel").withColumn("_n", last).filter(F.col("channel") == F.when(F.col("_n") >= 2, 1).otherwise(0))
    return frames.join(leads.drop("_n"), ["frame_id", "channel"])


def _masters(frames: DataFrame, kind: str) -> DataFrame:
    """Median master (channel, y, x, value) of one kind of calibration frames, by tiles."""
    found = T.stack_frames(frames.filter(F.col("frame_type") == kind), ["channel"], "frame_id", "median")
    return T.to_pixels(found, ["channel"]).select("channel", "y", "x", "value")


def _calibrated(lights: DataFrame, dark: DataFrame | None, flat: DataFrame | None) -> DataFrame:
    """Planes less the dark over the flat; masters are joined by channel and size, and a plane without one stays as it is."""
    if dark is None and flat is None:
        return lights
    out = lights
    for master, name in ((dark, "_d"), (flat, "_f")):
        out = out.withColumn(name, F.lit(None).cast("array<double>")) if master is None else out.join(_whole_planes(master, name), ["channel", "height", "width"], "left")
    less = F.when(F.col("_d").isNull(), F.col("data")).otherwise(F.zip_with("data", "_d", lambda v, d: v - d))
    over = F.when(F.col("_f").isNull(), less).otherwise(F.zip_with(less, "_f", lambda v, f: v / f))
    return out.withColumn("data", F.transform(over, lambda v: F.greatest(v, F.lit(0.0)))).select(*lights.columns)


def _whole_planes(pixels: DataFrame, name: str) -> DataFrame:
    """Planes (channel, y, x, value) as one row each with its size, lines first; broadcast where their size allows."""
    lines = pixels.groupBy("channel", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "value"))), lambda p: p["value"]).alias("line"))
    rows = lines.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "line"))), lambda r: r["line"]).alias("rows"))
    whole = rows.select("channel", F.size("rows").alias("height"), F.size(F.col("rows")[0]).alias("width"), F.flatten("rows").alias(name))
    return F.broadcast(whole) if pixels.count() * 8 <= REFERENCE_BYTES else whole


def less_vignette(frames: DataFrame, vignette: DataFrame) -> DataFrame:
    """Planes less the map of their channel and size, not below zero; others stay as they are."""
    j = frames.join(F.broadcast(vignette.select("channel", "height", "width", F.col("data").alias("_m"))), ["channel", "height", "width"], "left")
    less = F.zip_with("data", "_m", lambda v, m: F.greatest(v - m, F.lit(0.0)))
    return j.withColumn("data", F.when(F.col("_m").isNull(), F.col("data")).otherwise(less)).select(*frames.columns)


def load_vignette(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """A stored map at a frame's size: (channel, height, width, data), at most three planes."""
    found = planes(files.scan(spark, path).filter("data IS NOT NULL"), ["path"]).filter("channel < 3")
    return I.map_frames(found, ["channel"], lambda a: restore.resize(a, height, width))


def _measure(a: np.ndarray, sigma: float) -> list[tuple]:
    """snr, star_count, contrast, dynamic_range, fwhm and score of one frame."""
    sky, noise = float(np.median(a)), max(K.mad_sigma(a), 1e-6)
    stars = detect.detect(a, k=sigma)
    p1, p95, p99 = np.percentile(a, [1, 95, 99])
    fwhm = K.measure_fwhm(a, stars)
    top = float(stars[:, 3].max()) if len(stars) else p95
    snr = (max(float(p95), top) - sky) / noise
    score = min(max(snr / 2, 0), 1) * min(max(len(stars) / 50, 0.01), 1) * max(0.1, 1 / (1 + 0.02 * max(0.0, fwhm - 2) ** 2)) * 100
    return [(snr, len(stars), float(a.std()), float(max(p99, top) - p1), fwhm, score)]


METRICS = {"snr": "double", "star_count": "int", "contrast": "double", "dynamic_range": "double", "fwhm": "double", "score": "double"}


def stack_frames(spark: SparkSession, frames: DataFrame, plan: StackPlan, folder: str, inputs: str = "", vignette: DataFrame | None = None, meta: DataFrame | None = None) -> dict[str, DataFrame]:
    """Runs the phases over planes (frame_id, channel, frame_type, height, width, data) and returns metrics, shifts and the stack.

    Frames are placed by their stars, or by their shift where too few stars agree. A star fit whose pairs scatter by more than
    1.5 widths over the frame's signal-to-noise ratio (held to 1.5 to 6 pixels) is left out, as is a shift outlier.

    `meta` (frame_id, frame_type, header) gives the settings by which lights and calibration frames are matched; without it
    all settings agree.

    A vignette map (channel, height, width, data) is taken off the planes of its size and channel.

    Phases that the folder holds from the same plan and `inputs` (a value that changes with the frames) are not run again.
    """
    if vignette is not None:
        inputs += f"-{vignette.agg(F.sum(F.xxhash64(*vignette.columns).cast('decimal(38,0)'))).first()[0]}"
    stored = Phases(spark, folder, plan.key(), inputs)
    if meta is None:
        meta = frames.select("frame_id", "frame_type", F.create_map().cast("map<string,string>").alias("header")).distinct()
    sizes = frames.groupBy("frame_id").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    about = stored.get("settings", lambda: calibration.settings(meta, sizes))
    grouped, chosen = calibration.matched(about)
    grouped, chosen = stored.get("light_groups", lambda: grouped), stored.get("matched", lambda: chosen)
    made = stored.get("masters", lambda: calibration.masters(frames, chosen))
    lights = frames.filter("frame_type = 'light'").select("frame_id", "channel", "height", "width", "data")

    def clean() -> DataFrame:
        out = I.chain(calibration.calibrate(lights, grouped, made, plan.debayer != "none"), ["frame_id", "channel"], plan.clean)
        out = out if plan.debayer == "none" else I.debayer(out, ["frame_id"], plan.debayer)
        return out if vignette is None else less_vignette(out, vignette)

    cleaned = stored.get("cleaned", clean)
    lead = _lead(cleaned)
    measured = stored.get("metrics", lambda: I.flat_map_frames(lead, ["frame_id"], METRICS, lambda a: _measure(a, plan.star_sigma)))
    session = measured.withColumn("session", F.lit(0))
    gated = stored.get("gate", lambda: G.quality_gate(session, ["session"], threshold=plan.quality_threshold, sigma=plan.outlier_sigma))
    kept = gated.filter("accepted")
    best = kept.join(lead.select("frame_id", "height", "width"), "frame_id").orderBy(F.desc("score"), "frame_id").select("frame_id", "height", "width").first()
    if best is None:
        raise ValueError("no frame passed the quality gate")

    def register() -> DataFrame:
        size = (F.col("height") == best["height"]) & (F.col("width") == best["width"])
        all_frames = lead.filter(size).join(kept.select("frame_id"), "frame_id").withColumn("session", F.lit(0))
        reference = lead.filter(F.col("frame_id") == best["frame_id"]).select(F.lit(0).alias("session"), F.col("data").alias("r_data"))
        if best["height"] * best["width"] * 8 <= REFERENCE_BYTES:
            reference = F.broadcast(reference)
        placed = I.register_to_reference(all_frames, reference, ["session"], "frame_id", plan.star_sigma, 16 if plan.elastic else 0)
        most = F.least(F.greatest(1.5 * F.col("fwhm") / F.greatest("snr", F.lit(1e-6)), F.lit(1.5)), F.lit(6.0))
        near = placed.join(kept.select("frame_id", most.alias("most")), "frame_id").filter("residual IS NULL OR residual <= most").drop("most")
        return G.shift_outliers(near, ["session"], plan.shift_sigma).filter("shift_ok").drop("shift_ok")

    shifts = stored.get("shifts", register)

    def combined() -> DataFrame:
        weight = F.sqrt(F.col("score") / F.lit(max(kept.agg(F.max("score")).first()[0], 1e-9))) if plan.weighted else F.lit(1.0)
        aligned = cleaned.join(shifts, "frame_id").join(kept.select("frame_id", weight.alias("weight")), "frame_id")
        if plan.drizzle != 1.0:
            return I.drizzle(aligned, ["channel"], "frame_id", plan.drizzle).select("channel", "y", "x", "value", F.col("frames").cast("long").alias("n_used"))
        extra = {"sigma": plan.sigma, "iterations": plan.iterations} if plan.combine in ("sigma_clip", "winsorized") else {}
        if plan.combine in T.VECTOR:
            blocks = I.warp_tiles(aligned, ["frame_id", "channel", "weight"], T.side(shifts.count()))
            return T.combine_tiles(blocks, ["channel"], plan.combine, "frame_id", None if plan.combine == "median" else "weight", **extra)
        px = I.warp_frames(aligned, ["frame_id", "channel", "weight"])
        extra |= {} if plan.combine in ("median", "online") else {"weight": "weight"}
        return C.combine(px, ["channel", "y", "x"], "v", plan.combine, **extra).select("channel", "y", "x", "value", "n_used")

    stack = stored.get("stack", combined)
    if "y0" not in stack.columns:
        return {"metrics": gated, "shifts": shifts, "stack": stack}
    px = T.to_pixels(stack, ["channel"]).filter("n_used + n_rejected > 0").select("channel", "y", "x", "value", "n_used")
    return {"metrics": gated, "shifts": shifts, "stack": px, "tiles": stack}


def whole_image(spark: SparkSession, stack: DataFrame, post: tuple[str, ...] = ()) -> DataFrame:
    """A stack (channel, y, x, value) as one image row (frame_id, channels, height, width, data), after the post steps."""
    height, width, channels = (n + 1 for n in stack.agg(F.max("y"), F.max("x"), F.max("channel")).first())
    size = height * width
    # each plane's samples in row order, zero where no frame reached
    cells = spark.range(channels * size).select(F.floor(F.col("id") / size).cast("int").alias("channel"), F.floor(F.col("id") % size / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    plane = _whole_planes(cells.join(stack, ["channel", "y", "x"], "left").select("channel", "y", "x", F.coalesce("value", F.lit(0.0)).alias("value")), "data")
    return _one_image(plane, post)


def _one_image(plane: DataFrame, post: tuple[str, ...]) -> DataFrame:
    """Planes (channel, height, width, data) as one image row, after the post steps."""
    channels = plane.agg(F.max("channel")).first()[0] + 1
    plane = I.chain(plane, ["channel"], post) if post else plane
    return plane.groupBy("height", "width").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("channel", "data"))), lambda p: p["data"])).alias("data")).select(F.lit(0).alias("frame_id"), F.lit(channels).alias("channels"), "height", "width", "data")


def export_frames(result: dict[str, DataFrame], cleaned: DataFrame, output: str, kind: str = "fits", crop: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Writes every accepted frame, aligned and cropped to (top, bottom, left, right), as a file of its own for comparison.

    Files are numbered by score and carry their place, score and shift; `png` gives previews. Returns (name, bytes).
    """
    order = Window.orderBy(F.desc("score"), "frame_id")
    kept = result["metrics"].join(result["shifts"], "frame_id").select("frame_id", "score", "dy", "dx", *[c for c in ("angle", "field") if c in result["shifts"].columns])
    kept = kept.withColumn("place", F.row_number().over(order) - 1)  # one row a frame
    moved = I.align_frames(cleaned.join(kept, "frame_id"), ["frame_id", "channel"], crop)
    whole = moved.groupBy("frame_id", "height", "width").agg((F.max("channel") + 1).alias("channels"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("channel", "data"))), lambda p: p["data"])).alias("data"))
    text = lambda c, n: F.format_string(f"%.{n}f", c)
    header = F.create_map(F.lit("FRAMEIDX"), F.col("place").cast("string"), F.lit("QSCORE"), text("score", 1), F.lit("SHIFT_Y"), text("dy", 2), F.lit("SHIFT_X"), text("dx", 2))
    titled = whole.join(kept, "frame_id").select(F.format_string("frame_%05d", "place").alias("name"), header.alias("header"), "channels", "height", "width", "data")
    return files.write_files(files.encode(titled, kind), output)


def stack_directory(spark: SparkSession, directory: str, output: str, plan: StackPlan | None = None, vignette: DataFrame | None = None, keep_phases: bool = True) -> dict[str, DataFrame]:
    """The run over a directory; writes the stack in the plan's formats, the quality report and the effective parameters.

    Without `keep_phases` the stored phases go once everything is written, and nothing is returned."""
    plan = plan or StackPlan()
    inputs = manifest(spark, directory)
    found = files.discover(spark, directory).select("path", "frame_index", "frame_type")
    data = files.scan(spark, directory).filter("data IS NOT NULL")
    if plan.calibration:
        inputs += f"+{manifest(spark, plan.calibration)}"
        found = found.unionByName(files.discover(spark, plan.calibration).filter("frame_type != 'light'").select("path", "frame_index", "frame_type"))
        data = data.unionByName(files.scan(spark, plan.calibration).filter("data IS NOT NULL"))
    named = data.join(found, ["path", "frame_index"]).withColumn("frame_id", F.xxhash64("path", "frame_index"))
    frames = planes(named, ["frame_id", "frame_type"])
    result = stack_frames(spark, frames, plan, output, inputs, vignette, named.select("frame_id", "frame_type", "header"))
    image = _one_image(T.to_planes(result["tiles"], ["channel"]), plan.post) if "tiles" in result else whole_image(spark, result["stack"], plan.post)
    if plan.chain:
        from skyfold.plans import post

        image, _ = post.run_chain(spark, image, ["frame_id"], plan.chain, output, f"{plan.key()}-{inputs}", plan.sidecars or None)
    counts = result["metrics"].agg(F.count(F.lit(1)), F.count(F.when(F.col("accepted"), 1)), F.avg(F.when(F.col("fwhm") > 0, F.col("fwhm")))).first()
    header = {"RAWSTACK": "F" if plan.post or plan.chain else "T", "NFRAMES": str(counts[1]), "NTOTAL": str(counts[0]), "COMBINE": plan.combine, "FWHM": f"{counts[2] or 0:.3f}"}
    header |= _facts(result["metrics"], named, plan.drizzle)
    titled = image.select(F.lit("stack").alias("name"), F.create_map(*[F.lit(x) for kv in header.items() for x in kv]).alias("header"), "channels", "height", "width", "data")
    for kind in plan.formats:
        files.write_files(files.encode(titled, kind), output).collect()
    report(result["metrics"].join(named.select("frame_id", "path"), "frame_id")).write.mode("overwrite").option("header", True).csv(f"{output.rstrip('/')}/report")
    config = files.effective_config({k: v for k, v in dataclasses.asdict(plan).items()})
    files.write_files(spark.createDataFrame([("plan.toml", config.encode())], "name string, content binary"), output).collect()
    if not keep_phases:
        Phases(spark, output, plan.key(), inputs).clear()
        return {}
    return result | {"image": image}


def _facts(metrics: DataFrame, named: DataFrame, scale: float) -> dict[str, str]:
    """Keywords of a stack from its frames' headers: total exposure and dates of the accepted ones, and the sky solution of the
    frame whose grid the stack lies on (finer by `scale`)."""
    head = lambda *names: F.coalesce(*(F.try_element_at("header", F.lit(n)) for n in names))
    used = metrics.filter("accepted").select("frame_id", "score").join(named.select("frame_id", "header"), "frame_id")
    reference = F.max_by("header", F.struct("score", -F.col("frame_id")))
    exposure = S.header_number(F.col("header"), "EXPTIME", "EXPOSURE")
    row = used.agg(F.sum(exposure).alias("seconds"), F.min(head("DATE-OBS")).alias("first"), F.max(head("DATE-OBS")).alias("last"), reference.alias("header")).first()
    out = {k: v for k, v in (("DATEFRST", row["first"]), ("DATELAST", row["last"])) if v}
    if row["seconds"] is not None:
        out["TOTEXP"] = f"{row['seconds']:.3f}"
    sky = {k: v for k, v in (row["header"] or {}).items() if k in (*files.SKY, "CTYPE1", "CTYPE2")}
    if scale != 1.0:
        # pixel i of the frame is pixel scale * i of the stack, both counted from 0
        move = {k: (lambda v: (v - 1) * scale + 1) if k.startswith("CRPIX") else (lambda v: v / scale) for k in sky if k.startswith(("CRPIX", "CD"))}
        sky |= {k: repr(f(float(sky[k]))) for k, f in move.items()}
    return out | sky


def report(metrics: DataFrame) -> DataFrame:
    """The quality report's rows."""
    name = F.element_at(F.split("path", "/"), -1)
    return metrics.select(name.alias("filename"), F.round("snr", 3).alias("snr"), F.round("fwhm", 3).alias("fwhm"), "star_count", F.round("score", 2).alias("quality_score"), "accepted", F.coalesce("reject_reason", F.lit("")).alias("rejection_reason")).orderBy("filename")


def quality_sweep(spark: SparkSession, root: str, sigma: float = 2.0) -> DataFrame:
    """Scores every folder's lights below a root against their own folder; nothing is renamed."""
    found = files.discover(spark, root, recursive=True).filter("frame_type = 'light'").select("path", "frame_index")
    data = files.scan(spark, root, recursive=True).filter("data IS NOT NULL").join(found, ["path", "frame_index"])
    data = planes(data, ["path", "frame_index"])
    lead = _lead(data.withColumn("frame_id", F.xxhash64("path", "frame_index")))
    measured = I.flat_map_frames(lead, ["path", "frame_index"], METRICS, lambda a: _measure(a, 5.0))
    gated = G.quality_gate(measured.withColumn("folder", S.folder_label(F.col("path"))), ["folder"], sigma=sigma)
    return gated.select("folder", "path", "frame_index", *METRICS, "accepted", "reject_reason")
