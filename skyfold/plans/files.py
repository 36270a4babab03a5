"""Registered queries of the frame files: sessions written and read back in three formats."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.plans.stacking import PIXELS_SQL
from skyfold.plans.tables import SIDE, pixels
from skyfold.sources import frames as files


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, a temporary one on a local master, and an error on any other."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-skyfold-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _round_trip(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A file per block of sixteen frames; samples rounded to whole numbers, as the formats hold."""
        px = pixels(spark, sf_dir).withColumn("v", F.round("v"))
        block = F.concat(F.lit("s"), F.col("session"), F.lit("_"), F.floor(F.col("frame_id") / 160).cast("string"))
        cube = px.groupBy(block.alias("name"), F.col("session")).agg(F.array_sort(F.collect_list(F.struct("frame_id", "y", "x", "v"))).alias("p"))
        shaped = cube.select(
            "name", F.create_map(F.lit("OBJECT"), F.concat(F.lit("S"), F.col("session").cast("string"))).alias("header"), (F.size("p") / (SIDE * SIDE)).cast("int").alias("channels"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.transform("p", lambda e: e["v"]).alias("data")
        )
        folder = shared_folder(spark, kind)
        written = files.write_files(files.encode(shaped, kind), folder)
        written.agg(F.sum("bytes")).collect()
        back = files.scan(spark, folder)
        sums = F.aggregate("data", F.lit(0.0), lambda s, v: s + v)
        listed = back.select(F.regexp_extract("path", r"/s(\d+)_", 1).cast("int").alias("session"), "format", (F.size("data") / (SIDE * SIDE)).cast("long").alias("n"), sums.alias("total"), F.array_max("data").alias("top"))
        return listed.groupBy("session", "format").agg(F.sum("n").alias("frames"), F.sum("total").alias("total"), F.max("top").alias("top"))

    return query


def dng_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame as a raw mosaic and back: patterns by session, samples over the white level's range."""
    px = pixels(spark, sf_dir).withColumn("v", F.round("v"))
    whole = px.groupBy("session", "frame_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    filters = F.element_at(F.array(*map(F.lit, ("RGGB", "BGGR", "GRBG", "GBRG"))), (F.col("session") % 4 + 1).cast("int"))
    name = F.format_string("s%d_f%d", "session", "frame_id")
    shaped = whole.select(name.alias("name"), F.create_map(F.lit("BAYERPAT"), filters).alias("header"), F.lit(1).alias("channels"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.transform("p", lambda e: e["v"]).alias("data"))
    folder = shared_folder(spark, "dng")
    files.write_files(files.encode(shaped, "dng"), folder).agg(F.sum("bytes")).collect()
    back = files.scan(spark, folder)
    total = F.aggregate("data", F.lit(0.0), lambda s, v: s + F.round(v * 65535))
    listed = back.select(F.regexp_extract("path", r"/s(\d+)_f", 1).cast("int").alias("session"), F.element_at("header", "BAYERPAT").alias("filters"), total.alias("total"), F.round(F.array_max("data") * 65535).alias("top"))
    return listed.groupBy("session", "filters").agg(F.count(F.lit(1)).alias("frames"), F.sum("total").alias("total"), F.max("top").alias("top"))


QUERIES = {f"{k}_round_trip": _round_trip(k) for k in ("fits", "ser", "xisf")} | {"tiff_round_trip": _round_trip("tif"), "dng_round_trip": dng_round_trip}
ORACLE_SQL = {
    f"{k}_round_trip": f"WITH {PIXELS_SQL}, r AS (SELECT session, frame_id, round(v) AS v FROM px) SELECT session, '{k}' AS format, count(DISTINCT frame_id) AS frames, sum(v) AS total, max(v) AS top FROM r GROUP BY session" for k in ("fits", "ser", "xisf", "tiff")
} | {
    "dng_round_trip": f"WITH {PIXELS_SQL}, r AS (SELECT session, frame_id, round(v) AS v FROM px) SELECT session, ['RGGB', 'BGGR', 'GRBG', 'GBRG'][1 + session % 4] AS filters, count(DISTINCT frame_id) AS frames, sum(v) AS total, max(v) AS top FROM r GROUP BY session"
}
