"""Post-processing as a plan: ordered steps over whole images that share masks, skip by rule, are stored one by one and resume.

An image is a row (keys..., channels, height, width, data by planes). Before the first step each image is surveyed once: stars
and their width, a star mask, a mask of extended emission (connected regions over the border's sky that are no stars), and facts
that the rules ask for. A step whose rule refuses an image passes it on; its reason is kept. Every step's images are stored, so
a chain that broke off after step n goes on with n + 1, and another plan or other images begin anew. Images are rows, so many
sessions' stacks are processed side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import collaborative, detect, restore
from skyfold.functions import kernels as K
from skyfold.plans.run import Phases
from skyfold.sources import frames as files

FACTS = {"stars": "int", "fwhm": "double", "snr": "double", "emission": "double", "covered": "double", "dense": "boolean"}


@dataclass(frozen=True)
class Survey:
    """What the steps share of an image: detections, masks from 0 to 1, and facts."""

    stars: np.ndarray
    star_mask: np.ndarray
    emission_mask: np.ndarray
    facts: dict[str, object]


def emission(lum: np.ndarray, stars: np.ndarray, least: float = 0.005, sigma: float = 3.0) -> np.ndarray:
    """Extended light: connected regions of the smoothed frame, without its stars, that lie `sigma` deviations over the border's
    sky and cover `least` of the frame or more."""
    calm = restore.coarse_gaussian(np.where(stars > 0.1, K.median_filter(lum, 2) if lum.size < 1 << 22 else np.median(lum), lum), max(1.5, min(lum.shape) / 60))
    rim = restore.border(calm)
    level, spread = restore.clipped_sky(rim)
    label = restore.blobs(calm > level + sigma * max(spread, 1e-9))
    names, counts = np.unique(label[label > 0], return_counts=True)
    return np.isin(label, names[counts >= least * lum.size]).astype(float)


def survey(cube: np.ndarray, k: float = 5.0) -> Survey:
    lum = restore.luminance(cube.transpose(1, 2, 0)) if len(cube) == 3 else cube.mean(0)
    cell = max(16, min(64, min(lum.shape) // 4))
    stars = detect.detect(lum, None, k, border=1, cell=cell)
    fwhm = K.measure_fwhm(lum, stars) if len(stars) else 0.0
    mask = K.star_mask(lum.shape, stars, max(fwhm, 1.0))
    found = emission(lum, mask)
    noise = max(K.mad_sigma(lum), 1e-9)
    covered = float((mask > 0.05).mean())
    facts = {"stars": len(stars), "fwhm": float(fwhm), "snr": float((np.percentile(lum, 99) - np.median(lum)) / noise), "emission": float(found.mean()), "covered": covered, "dense": covered > 0.3}
    return Survey(stars, mask, found, facts)


@dataclass(frozen=True)
class Step:
    """A named change of a cube (channels, height, width), and the rule that refuses images (a reason or nothing)."""

    apply: Callable[[np.ndarray, Survey], np.ndarray]
    refuse: Callable[[dict, tuple[int, int, int]], str | None] = lambda facts, shape: None


def _planes(kernel: Callable[[np.ndarray, Survey], np.ndarray]) -> Callable[[np.ndarray, Survey], np.ndarray]:
    return lambda cube, s: np.stack([kernel(p, s) for p in cube])


def _colour(kernel: Callable[[np.ndarray, Survey], np.ndarray]) -> Callable[[np.ndarray, Survey], np.ndarray]:
    return lambda cube, s: kernel(cube.transpose(1, 2, 0), s).transpose(2, 0, 1)


def _flattened(a: np.ndarray, s: Survey) -> np.ndarray:
    """Less the mesh of the sky; under emission and stars the mesh goes on from its surroundings."""
    clear = (s.emission_mask < 0.5) & (s.star_mask < 0.3)
    if not clear.any():
        return a
    filled = np.where(clear, a, np.median(a[clear]))
    model = K.background(filled, max(8, min(a.shape) // 8))
    return a - model + np.median(model)


def _sharpened(a: np.ndarray, s: Survey) -> np.ndarray:
    psf, _ = restore.estimate_psf(a, s.stars, radius=min(8, min(a.shape) // 8), size=15)
    if psf is None:
        return a
    low = float(a.min())
    sharp = K.richardson_lucy(np.pad(a - low + 1e-6, 15, mode="symmetric"), psf, 10)[15:-15, 15:-15] + low
    return a + (1 - s.star_mask) * (sharp - a)


_no_stars = lambda f, shape: "no stars" if not f["stars"] else None
_mono = lambda f, shape: "one plane" if shape[0] != 3 else None

STEPS: dict[str, Step] = {
    "hot_pixels": Step(_planes(lambda a, s: K.fix_hot_pixels(a, 12.0))),
    "saturated": Step(lambda c, s: restore.repair_saturated(c.transpose(1, 2, 0)).transpose(2, 0, 1), _no_stars),
    "halos": Step(lambda c, s: restore.remove_halos(c.transpose(1, 2, 0), s.stars, float(s.facts["fwhm"])).transpose(2, 0, 1), lambda f, shape: "no stars" if not f["stars"] or not f["fwhm"] else None),
    "flatten": Step(_planes(_flattened), lambda f, shape: "emission covers the sky" if f["emission"] > 0.6 else None),
    "neutral_sky": Step(_colour(lambda a, s: restore.neutralise(a, np.maximum(s.star_mask, s.emission_mask), max(4.0, min(a.shape[:2]) / 8))), _mono),
    "chroma": Step(_colour(lambda a, s: restore.reduce_chroma(a, 2.0, mask=np.maximum(s.star_mask, s.emission_mask))), _mono),
    "cascade": Step(_planes(lambda a, s: K.median_cascade(a, 3))),
    "block_match": Step(_planes(lambda a, s: collaborative.block_match(a, K.neighbour_noise(a))), lambda f, shape: "noise is low" if f["snr"] > 200 else None),
    "sharpen": Step(_planes(_sharpened), lambda f, shape: "too few stars" if f["stars"] < 5 else "dense field" if f["dense"] else "faint" if f["snr"] < 5 else None),
    "reduce_stars": Step(_planes(lambda a, s: K.reduce_stars(a, s.star_mask)), lambda f, shape: "no stars" if not f["stars"] else "dense field" if f["dense"] else None),
    "local_contrast": Step(_planes(lambda a, s: K.local_contrast(a)), lambda f, shape: "faint" if f["snr"] < 3 else None),
}


def _cube(r: dict, d: pa.Scalar) -> np.ndarray:
    return np.nan_to_num(np.asarray(d.values.to_numpy(zero_copy_only=False), float).reshape(r["channels"], r["height"], r["width"]))


def surveyed(images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., height, width, facts, star and emission masks, stars): one pass over each image."""
    kinds = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        for batch in batches:
            found = [survey(_cube(r, d)) for r, d in zip(batch.select(["channels", "height", "width"]).to_pylist(), batch.column("data"), strict=True)]
            facts = [pa.array([s.facts[n] for s in found], types[t]) for n, t in FACTS.items()]
            arrays = [pa.array([getattr(s, n).ravel() for s in found], pa.list_(pa.float64())) for n in ("star_mask", "emission_mask", "stars")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("height"), batch.column("width"), *facts, *arrays], names=[*keys, "height", "width", *FACTS, "star_mask", "emission_mask", "stars_found"])

    facts = ", ".join(f"{n} {t}" for n, t in FACTS.items())
    return images.select(*keys, "channels", "height", "width", "data").mapInArrow(run, f"{kinds}, height int, width int, {facts}, star_mask array<double>, emission_mask array<double>, stars_found array<double>")


def apply_step(images: DataFrame, known: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Images (keys..., channels, height, width, data, skipped) after one step; `skipped` is the rule's reason or null."""
    step = STEPS[name]
    kinds = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*keys, "channels", "height", "width", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, reasons = [], []
            rows = batch.select(["channels", "height", "width", *FACTS]).to_pylist()
            masks = zip(*(batch.column(n) for n in ("star_mask", "emission_mask", "stars_found")), strict=True)
            for r, d, parts in zip(rows, batch.column("data"), masks, strict=True):
                cube = _cube(r, d)
                facts = {n: r[n] for n in FACTS}
                reason = step.refuse(facts, cube.shape)
                if reason is None:
                    star, extended, stars = (np.asarray(p.values.to_numpy(zero_copy_only=False), float) for p in parts)
                    cube = step.apply(cube, Survey(stars.reshape(-1, len(detect.COLUMNS)), star.reshape(cube.shape[1:]), extended.reshape(cube.shape[1:]), facts))
                reasons.append(reason)
                out.append(cube.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in columns[:-1]), pa.array(out, pa.list_(pa.float64())), pa.array(reasons, pa.string())], names=[*columns, "skipped"])

    joined = images.select(*columns).join(known.drop("height", "width"), list(keys))
    return joined.mapInArrow(run, f"{kinds}, channels int, height int, width int, data array<double>, skipped string")


def run_chain(spark: SparkSession, images: DataFrame, keys: Sequence[str], steps: Sequence[str], folder: str, inputs: str = "", sidecars: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The images after all steps, and (step, applied, keys..., skipped) of what was done.

    Steps are stored below `folder` for the same list of steps and the same `inputs`. With `sidecars`, a preview of every step
    and of the masks is written into that folder.
    """
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    stored = Phases(spark, folder, "post-" + hashlib.sha256(",".join(steps).encode()).hexdigest()[:16], inputs)
    now = stored.get("start", lambda: images.select(*keys, "channels", "height", "width", "data"))
    known = stored.get("survey", lambda: surveyed(now, keys))
    name_of = F.concat_ws("_", *(F.col(k).cast("string") for k in keys))

    def preview(label: str, df: DataFrame) -> None:
        titled = df.select(F.concat(name_of, F.lit(f"_{label}")).alias("name"), F.create_map().cast("map<string,string>").alias("header"), "channels", "height", "width", "data")
        files.write_files(files.encode(titled, "png"), sidecars).collect()

    if sidecars:
        for mask in ("star_mask", "emission_mask"):
            preview(mask, known.select(*keys, F.lit(1).alias("channels"), "height", "width", F.col(mask).alias("data")))
    done = None
    for i, name in enumerate(steps):
        before = now
        now = stored.get(f"step-{i:02d}-{name}", lambda b=before, n=name: apply_step(b, known, keys, n))
        if sidecars:
            preview(f"{i:02d}_{name}", now)
        said = now.select(F.lit(i).alias("step"), F.lit(name).alias("applied"), *keys, "skipped")
        done = said if done is None else done.unionByName(said)
    if done is None:
        done = now.select(F.lit(-1).alias("step"), F.lit("").alias("applied"), *keys, F.lit(None).cast("string").alias("skipped")).limit(0)
    return now.select(*keys, "channels", "height", "width", "data"), done
