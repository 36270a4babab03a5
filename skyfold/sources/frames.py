"""Frame sources and sinks: files of any file system that Spark reads, as rows.

`scan` gives one row a frame (a SER file has many) with its header; samples are decoded only if asked for. Files are listed and
read by Spark's binary source, so a directory of any size is spread over the executors.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions import scalars as S
from skyfold.sources import formats, jpeg, raw, tiff

#: Endings of raw files of the TIFF/EP family, and of all files that are scanned (fixed values).
RAW = ("dng", "nef", "nrw", "arw", "sr2", "pef", "3fr", "iiq", "cr2")
PATTERN = "*.{" + ",".join(("fits", "fit", "fts", "ser", "xisf", "tif", "tiff", *RAW)) + "}"

_SCHEMA = "path string, frame_index int, format string, header map<string,string>, channels int, height int, width int, data array<double>"


class Ranged:
    """A file as bytes that are read where they are asked for; its first part is read once."""

    FIRST = 1 << 16

    def __init__(self, file: pyarrow.NativeFile, length: int):
        self.file, self.length = file, length
        self.head = file.read_at(min(self.FIRST, length), 0)

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, at: slice) -> bytes:
        start, stop, _ = at.indices(self.length)
        return self.head[start:stop] if stop <= len(self.head) else self.file.read_at(max(stop - start, 0), start)


def _decode(path: str, data: bytes, samples: bool) -> list[tuple]:
    """(index, format, header, array or None) of a file's frames; an array is (height, width) or (channels, height, width)."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("fits", "fit", "fts"):
        if not samples:
            header, _ = formats.fits_header(data)
            return [(0, "fits", header, None)]
        a, header = formats.read_fits(data)
        return [(0, "fits", header, a)]
    if kind == "ser":
        h = formats.ser_header(data)
        text = {k: str(v) for k, v in h.items()}
        planes = lambda a: a.transpose(2, 0, 1) if a.ndim == 3 else a
        return [(i, "ser", text, planes(formats.read_ser(data, i)) if samples else None) for i in range(h["frames"])]
    if kind in ("tif", "tiff"):
        order, found = tiff.directories(data)
        out = []
        for i, page in enumerate(p for p in found if p.number(254) & 5 == 0):
            channels = min(page.number(277, 1), 3)  # a fourth one is no colour
            header = {"IMAGETYP": "Light Frame", "NAXIS": str(2 if channels == 1 else 3), "NAXIS1": str(page.number(256)), "NAXIS2": str(page.number(257))} | ({} if channels == 1 else {"NAXIS3": str(channels)})
            out.append((i, "tiff", header, tiff.page_array(data, order, page)[..., :3].transpose(2, 0, 1) if samples else None))
        return out
    if kind in RAW:
        try:
            a, header = raw.read(data) if samples else (None, raw.header(data))
        except ValueError as reason:  # one foreign file does not stop a scan; it has no samples
            a, header = None, {"IMAGETYP": "Light Frame", "UNREAD": str(reason)}
        return [(0, "raw", header, a)]
    if kind == "xisf":
        if not samples:
            return [(0, "xisf", formats.xisf_header(data)[1], None)]
        a, header = formats.read_xisf(data)
        return [(0, "xisf", header, a)]
    return []


def scan(spark: SparkSession, path: str, samples: bool = True, pattern: str = PATTERN, recursive: bool = False) -> DataFrame:
    """Frames under a path: path, frame_index, format, header, channels, height, width and data (channels, rows, columns).

    Without samples, files of a mounted path are read only as far as their headers go; other file systems, which Arrow may not
    reach with Spark's settings, give whole files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = ((p, b.as_py()) for p, b in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True)) if "content" in batch.schema.names else _headers(batch)
            for p, blob in blobs:
                for index, kind, header, a in _decode(p, blob, samples):
                    cube = None if a is None else a.reshape(-1, *a.shape[-2:])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p]), pa.array([index], pa.int32()), pa.array([kind]), pa.array([list(header.items())], pa.map_(pa.string(), pa.string())),
                            *(pa.array([None if cube is None else n], pa.int32()) for n in (cube.shape if cube is not None else (0, 0, 0))),
                            pa.array([None if cube is None else cube.ravel()], pa.list_(pa.float64())),
                        ],
                        names=["path", "frame_index", "format", "header", "channels", "height", "width", "data"],
                    )

    mounted = not samples and ("://" not in path or path.startswith("file:"))
    return files.select("path", "length" if mounted else "content").mapInArrow(run, _SCHEMA)


def _headers(batch: pa.RecordBatch) -> Iterator[tuple[str, Ranged]]:
    fs = pyarrow.fs.LocalFileSystem()
    for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
        with fs.open_input_file(re.sub("^file:/*", "/", path)) as file:
            yield path, Ranged(file, length)


def discover(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Header scan with the frame type; combined results are skipped."""
    found = scan(spark, path, samples=False, **options)
    head = lambda k: F.try_element_at("header", F.lit(k))
    kind = S.classify_frame(F.regexp_extract("path", r"([^/]+)$", 1), head("IMAGETYP"), S.header_number(F.col("header"), "EXPTIME", "EXPOSURE"))
    return found.withColumn("frame_type", kind).filter(F.coalesce(head("COMBINED"), F.lit("F")) != "T").drop("data")


def _one_slash(path: Column) -> Column:
    """Spark's sources write local paths with one or three slashes."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def with_sidecars(frames: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Fills header gaps from JSON sidecars (stem, meta map): values that a header has stay."""
    stem = _one_slash(F.regexp_replace(F.col("path"), r"\.[^./]+$", ""))
    j = frames.withColumn("_stem", stem).join(sidecars.select(F.col("stem").alias("_stem"), "meta"), "_stem", "left")
    fresh = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("header", k))
    return j.withColumn("header", F.map_concat("header", fresh)).drop("_stem", "meta")


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(stem, meta) of the JSON files under a path, with the camera's names turned into header keys."""
    names = {"iso": "ISOSPEED", "gain": "GAIN", "captureTemperatureC": "CCD-TEMP", "bayerPattern": "BAYERPAT"}
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).select(_one_slash(F.regexp_replace(F.input_file_name(), r"\.json$", "")).alias("stem"), F.from_json("value", "map<string,string>").alias("m"))
    pairs = [F.struct(F.lit(v).alias("key"), (F.upper(F.col("m")[k]) if k == "bayerPattern" else F.col("m")[k]).alias("value")) for k, v in names.items()]
    pairs.append(F.struct(F.lit("EXPTIME").alias("key"), (F.col("m")["exposureTimeMS"].try_cast("double") / 1000).cast("string").alias("value")))
    return raw.select("stem", F.map_filter(F.map_from_entries(F.array(*pairs)), lambda k, v: v.isNotNull()).alias("meta"))


def session_info(spark: SparkSession, path: str) -> DataFrame:
    """Session records (info.json, session.json, capture.json; the first found), numbers coerced or null."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "{info,session,capture}.json").text(path).select(F.input_file_name().alias("file"), "value")
    order = F.when(F.col("file").endswith("info.json"), 0).when(F.col("file").endswith("session.json"), 1).otherwise(2)
    body = F.coalesce(F.get_json_object("value", "$.StackedInfo"), F.col("value"))
    number = lambda p: F.get_json_object(body, p).try_cast("double")
    return raw.orderBy(order, "file").limit(1).select(
        F.get_json_object(body, "$.objectName").alias("object"), F.get_json_object(body, "$.dateTime").alias("date_time"), number("$.stackedDepth").cast("int").alias("depth"), number("$.fovX").alias("fov_x"), number("$.fovY").alias("fov_y"),
        number("$.celestial.first").alias("ra"), number("$.celestial.second").alias("dec"), number("$.captureParams.exposure").alias("exposure"), number("$.captureParams.temperature").alias("temperature"),
    )


def write_files(encoded: DataFrame, directory: str) -> DataFrame:
    """Writes rows (name, content) as files of a shared directory; returns (name, bytes).

    A file is written under a temporary name and then moved, so that a lost or repeated task leaves a whole file or none. It
    needs a directory that the executors reach through Arrow's file systems.
    """
    where = directory if "://" in directory or directory.startswith("file:") else "file://" + os.path.abspath(directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(where.replace("file:/", "file:///", 1) if where.startswith("file:/") and not where.startswith("file://") else where)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for name, blob in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                temporary = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}.tmp"  # no two attempts of a job share a number
                with fs.open_output_stream(temporary) as out:
                    out.write(blob.as_py())
                fs.move(temporary, f"{base}/{name}")
            yield pa.record_batch([batch.column("name"), pa.array([len(b.as_py()) for b in batch.column("content")], pa.int64())], names=["name", "bytes"])

    return encoded.select("name", "content").mapInArrow(run, "name string, bytes long")


#: Keywords of a sky solution, which files hold as numbers (fixed values).
SKY = ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "CDELT1", "CDELT2", "CROTA1", "CROTA2", "PC1_1", "PC1_2", "PC2_1", "PC2_2")


def _numbers(header: dict[str, str]) -> dict[str, object]:
    out: dict[str, object] = dict(header)
    for k in SKY:
        try:
            out |= {k: float(out[k])} if k in out else {}
        except (TypeError, ValueError):
            pass  # kept as text
    return out


def encode(frames: DataFrame, kind: str = "fits") -> DataFrame:
    """(name, content) for frames (name, header map, channels, height, width, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, header, c, h, w, d in zip(*(batch.column(n).to_pylist() for n in ("name", "header", "channels", "height", "width")), batch.column("data"), strict=True):
                a = np.asarray(d.values.to_numpy(zero_copy_only=False), float).reshape(c, h, w)
                if kind == "fits":
                    out.append(formats.write_fits(a[0] if c == 1 else a, _numbers(dict(header or {}))))
                elif kind == "xisf":
                    out.append(formats.write_xisf(a, dict(header or {})))
                elif kind == "tif":  # a page a plane, whole numbers
                    out.append(tiff.write([np.rint(p)[..., None].astype("u2") for p in a], tiff.LZW, 2))
                elif kind == "dng":
                    out.append(raw.write_dng(np.rint(a[0]).astype("u2"), dict(header or {}).get("BAYERPAT", "RGGB")))
                elif kind == "tiff":
                    out.append(formats.write_tiff(a))
                elif kind == "png":
                    out.append(formats.write_png(formats.preview(a)))
                elif kind == "jpg":
                    out.append(jpeg.write_jpeg(formats.preview(a)))
                elif kind == "ser":
                    out.append(formats.write_ser(np.rint(a)))
                else:
                    raise ValueError(f"unknown format {kind}")
            yield pa.record_batch([pa.array([f"{n}.{kind}" for n in batch.column("name").to_pylist()]), pa.array(out, pa.binary())], names=["name", "content"])

    return frames.select("name", "header", "channels", "height", "width", "data").mapInArrow(run, "name string, content binary")


def luminance(frames: DataFrame) -> DataFrame:
    """Scanned frames of any layout as one plane: weighted planes of three or more, the first of fewer."""
    size = F.col("height") * F.col("width")
    plane = lambda c: F.slice("data", c * size + 1, size)
    mixed = F.zip_with(F.zip_with(plane(0), plane(1), lambda r, g: 0.299 * r + 0.587 * g), plane(2), lambda v, b: v + 0.114 * b)
    return frames.withColumn("data", F.when(F.col("channels") >= 3, mixed).otherwise(plane(0))).withColumn("channels", F.when(F.col("channels").isNotNull(), 1))


def rgb(frames: DataFrame) -> DataFrame:
    """Scanned frames of any layout as three planes: the first three, or the only one three times."""
    size = F.col("height") * F.col("width")
    first = F.slice("data", 1, size)
    return frames.withColumn("data", F.when(F.col("channels") >= 3, F.slice("data", 1, 3 * size)).otherwise(F.concat(first, first, first))).withColumn("channels", F.when(F.col("channels").isNotNull(), 3))


def effective_config(values: dict[str, object]) -> str:
    """Parameters of a run as TOML text."""
    return "".join(f"{k} = {json.dumps(v)}\n" for k, v in sorted(values.items()) if v is not None)
