"""Readers and the relational views of frames: pixels from the array-valued frame table, per-session samples, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Side of the square frames held in `embeddings`.
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, outliers: bool = True) -> DataFrame:
    """(session, frame_id, y, x, v): each frame's samples on an ADU-like scale, with deterministic cosmic-ray hits."""
    frames = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "e"))
    value = 1000 + 1000 * F.col("e").cast("double")
    if outliers:
        value = value + F.when((F.col("vec_id") * 7 + F.col("p")) % 53 == 0, 5000.0).otherwise(0.0)
    return frames.select(
        F.col("label").cast("int").alias("session"), F.col("vec_id").alias("frame_id"), F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).cast("int").alias("x"), value.alias("v")
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq, v): one value stream per user in event order."""
    events = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("session"), seq.alias("seq"), F.col("value").cast("double").alias("v"))
