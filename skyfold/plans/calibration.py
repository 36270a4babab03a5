"""Matched calibration: every light is corrected by masters of the calibration frames that suit its own settings.

Lights that share ISO, exposure, size and filter form a group. Darks and flats are matched to each group (a size that differs
rules a frame out), and a master is the median of the frames that match, built by tiles. Masters are smoothed: the fewer
frames, the wider. A dark is scaled to the light's exposure, by what it has over the bias where there is one; without darks
the bias alone is taken off. Flats are smoothed on each colour lattice of a mosaic, brought to a median of one, held to
[0.4, 2.5] and turned to the lights' rotation. Pixels that stand out in the dark take the median of their neighbours.

Masters up to `HELD_BYTES` go to the workers once, as a broadcast variable; larger ones are joined by group.

Edge cases: settings that no header gives agree with each other; a group that nothing matches, or whose size no master has,
stays as it is; a kind of calibration frame that is missing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions import kernels as K
from skyfold.functions import scalars as S
from skyfold.operators import matching as J
from skyfold.operators import tiles as T

#: Bytes of all masters up to which workers hold them.
HELD_BYTES = 256 << 20
#: Header keys (fixed values).
ISO, TEMPERATURE, FILTER = ("ISOSPEED", "ISO", "GAIN"), ("CCD-TEMP", "SET-TEMP"), ("FILTER",)
ROTATION = ("ROTATANG", "ROTANGLE", "POSANGLE", "PA", "ANGLE", "ROTATOR")
#: Gaussian width of a master of one frame; it falls with the root of their number.
WIDTHS = {"bias": 30, "dark": 20, "flat": 15}


def settings(meta: DataFrame, sizes: DataFrame) -> DataFrame:
    """(frame_id, frame_type, iso, exptime, temp, dims, filter, rotation) of frames (frame_id, frame_type, header) with sizes (frame_id, height, width)."""
    text = lambda names: F.coalesce(*[F.trim(F.try_element_at("header", F.lit(n))) for n in names], F.lit(""))
    number = lambda names: S.header_number(F.col("header"), *names)
    dims = F.format_string("%dx%d", "height", "width")
    return meta.join(sizes, "frame_id").select("frame_id", "frame_type", text(ISO).alias("iso"), number(("EXPTIME", "EXPOSURE")).alias("exptime"), number(TEMPERATURE).alias("temp"), dims.alias("dims"), text(FILTER).alias("filter"), number(ROTATION).alias("rotation"))


def matched(about: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lights (frame_id, light_group, exptime) and the calibration frames of each group: (light_group, kind, frame_id, exptime, turn)."""
    group = F.xxhash64("iso", F.bround("exptime", 1), "dims", F.lower("filter"))
    lights = about.filter("frame_type = 'light'").withColumn("light_group", group)
    profile = lights.groupBy("light_group", "dims").agg(F.median("rotation").alias("l_rotation"))
    # only frames of the same size can be used, so candidates are joined by it
    of = lambda kind: about.filter(F.col("frame_type") == kind).join(profile, "dims")
    darks = J.match_darks(lights, of("dark"), ["light_group"]).select("light_group", F.lit("dark").alias("kind"), "frame_id", "exptime", F.lit(None).cast("double").alias("turn"))
    flats = J.match_flats(lights, of("flat"), ["light_group"])
    turn = F.pmod(F.col("l_rotation") - F.median("rotation").over(J.Window.partitionBy("light_group")) + 180, F.lit(360.0)) - 180
    flats = flats.select("light_group", F.lit("flat").alias("kind"), "frame_id", F.lit(None).cast("double").alias("exptime"), turn.alias("turn"))
    bias = of("bias").select("light_group", F.lit("bias").alias("kind"), "frame_id", F.lit(None).cast("double").alias("exptime"), F.lit(None).cast("double").alias("turn"))
    return lights.select("frame_id", "light_group", "exptime"), darks.unionByName(flats).unionByName(bias)


def fill_known(a: np.ndarray, bad: np.ndarray, step: int) -> np.ndarray:
    """Known places take the median of the eight samples `step` away; on a mosaic two steps lead to the same filter."""
    y, x = np.nonzero(bad)
    p = np.pad(a, step, mode="reflect")
    near = np.stack([p[y + step + i * step, x + step + j * step] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    out = a.copy()
    out[y, x] = np.median(near, axis=0)
    return out


def turned(a: np.ndarray, degrees: float) -> np.ndarray:
    """The frame turned about its centre, bilinearly; the edge goes on outside."""
    t = np.deg2rad(degrees)
    h, w = a.shape
    y, x = np.indices(a.shape)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = np.clip(cy + (y - cy) * np.cos(t) - (x - cx) * np.sin(t), 0, h - 1)
    sx = np.clip(cx + (y - cy) * np.sin(t) + (x - cx) * np.cos(t), 0, w - 1)
    iy, ix = np.minimum(sy.astype(int), max(h - 2, 0)), np.minimum(sx.astype(int), max(w - 2, 0))
    jy, jx = np.minimum(iy + 1, h - 1), np.minimum(ix + 1, w - 1)
    fy, fx = sy - iy, sx - ix
    return (1 - fy) * ((1 - fx) * a[iy, ix] + fx * a[iy, jx]) + fy * ((1 - fx) * a[jy, ix] + fx * a[jy, jx])


def _finished(kind: str, a: np.ndarray, n: int, turn: float | None, mosaic: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """A smoothed master and, of a dark, the places that stand out in it."""
    hot = None
    if kind == "dark":
        bad = a > np.median(a) + 5 * K.mad_sigma(a)
        hot = bad if bad.any() else None
    sigma = max(1, WIDTHS[kind] // max(1, int(n**0.5)))
    if kind == "flat" and mosaic:
        a = a.copy()
        for dy in (0, 1):
            for dx in (0, 1):
                a[dy::2, dx::2] = K.gaussian(a[dy::2, dx::2], sigma)
    else:
        a = K.gaussian(a, sigma)
    if kind == "flat":
        middle = float(np.median(a))
        a = np.clip(a / middle, 0.4, 2.5) if middle > 1e-6 else np.ones(a.shape)
        if turn is not None and abs(turn) > 0.5:
            a = np.clip(turned(a, -turn), 0.4, 2.5)
    return a, hot


MASTERS = "light_group long, kind string, channel int, height int, width int, exptime double, data array<double>, hot array<int>"


def masters(frames: DataFrame, chosen: DataFrame) -> DataFrame:
    """Masters (light_group, kind, channel, height, width, exptime, data, hot) of planes (frame_id, channel, height, width, data)."""
    about = chosen.groupBy("light_group", "kind").agg(F.count(F.lit(1)).cast("int").alias("n"), F.first("exptime", True).alias("exptime"), F.first("turn", True).alias("turn"))
    mosaics = frames.groupBy("frame_id").agg((F.max("channel") == 0).alias("mosaic"))
    use = frames.join(chosen.select("light_group", "kind", "frame_id"), "frame_id").join(mosaics, "frame_id")
    planes = T.to_planes(T.stack_frames(use, ["light_group", "kind", "mosaic", "channel"], "frame_id", "median"), ["light_group", "kind", "mosaic", "channel"]).join(F.broadcast(about), ["light_group", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, d in zip(batch.drop_columns(["data"]).to_pylist(), batch.column("data"), strict=True):
                a = np.asarray(d.values.to_numpy(zero_copy_only=False), float).reshape(r["height"], r["width"])
                out.append(_finished(r["kind"], a, r["n"], r["turn"], r["mosaic"]))
            held = [batch.column(c) for c in ("light_group", "kind", "channel", "height", "width", "exptime")]
            hot = [None if h is None else np.flatnonzero(h).astype(np.int32) for _, h in out]
            yield pa.RecordBatch.from_arrays([*held, pa.array([a.ravel() for a, _ in out], pa.list_(pa.float64())), pa.array(hot, pa.list_(pa.int32()))], names=["light_group", "kind", "channel", "height", "width", "exptime", "data", "hot"])

    return planes.mapInArrow(run, MASTERS)


def corrected(a: np.ndarray, exptime: float | None, own: dict[str, tuple], mosaic: bool) -> np.ndarray:
    """A plane less bias and scaled dark, over the flat, not below zero, with the dark's hot pixels filled."""
    bias, dark, flat = (own.get(k) for k in ("bias", "dark", "flat"))
    out = a if bias is None else a - bias[0]
    if dark is not None:
        scale = exptime / dark[1] if exptime and dark[1] and exptime > 0 and dark[1] > 0 else 1.0
        out = out - scale * (dark[0] if bias is None else dark[0] - bias[0])
    if flat is not None:
        out = out / flat[0]
    out = np.maximum(out, 0)
    if dark is not None and dark[2] is not None:
        bad = np.zeros(a.size, bool)
        bad[dark[2]] = True
        out = fill_known(out, bad.reshape(a.shape), 2 if mosaic else 1)
    return out


def calibrate(lights: DataFrame, grouped: DataFrame, made: DataFrame, mosaic: bool) -> DataFrame:
    """Lights (frame_id, channel, height, width, data) by the masters of their groups; `mosaic` says that one plane is a mosaic."""
    spark, names = lights.sparkSession, ["frame_id", "channel", "height", "width", "data"]
    joined = lights.join(grouped, "frame_id", "left")
    size = made.agg(F.sum(F.col("height").cast("long") * F.col("width") * 8)).first()[0] or 0
    parse = lambda d, h, w: np.asarray(d, float).reshape(h, w)
    held = None
    if size <= HELD_BYTES:
        table: dict[tuple, dict] = {}
        for r in made.toLocalIterator():
            table.setdefault((r["light_group"], r["channel"], r["height"], r["width"]), {})[r["kind"]] = (parse(r["data"], r["height"], r["width"]), r["exptime"], r["hot"])
        held = spark.sparkContext.broadcast(table)
    else:
        whole = made.groupBy("light_group", "channel", "height", "width").agg(F.collect_list(F.struct("kind", "exptime", "data", "hot")).alias("masters"))  # three rows a group
        joined = joined.join(whole, ["light_group", "channel", "height", "width"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = zip(*(batch.column(c).to_pylist() for c in ("light_group", "channel", "height", "width", "exptime")), batch.column("data"), strict=True)
            for i, (group, channel, h, w, exptime, d) in enumerate(columns):
                if held is not None:
                    own = held.value.get((group, channel, h, w), {})
                else:
                    own = {m["kind"]: (parse(m["data"], h, w), m["exptime"], m["hot"]) for m in batch.column("masters")[i].as_py() or []}
                out.append(corrected(parse(d.values.to_numpy(zero_copy_only=False), h, w), exptime, own, mosaic).ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(out, pa.list_(pa.float64()))], names=names)

    extra = [] if held is not None else ["masters"]
    return joined.select(*names, "light_group", "exptime", *extra).mapInArrow(run, lights.select(*names).schema)
