"""A live session: frames arrive, are calibrated, scored and gated, then registered and folded into an online clip.

The survey stores each micro-batch's planes, metrics and gate in a folder of its own, so a batch that is run again replaces
what it wrote. The fold places the accepted frames on the best one and clips in arrival order. Masters are the static side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyfold.operators import combine as C
from skyfold.operators import image_ops as I
from skyfold.plans import run as R
from skyfold.sources import frames as files

FRAME = "frame_id long, seq long, channel int, height int, width int, exposure double, data array<double>"


@dataclass(frozen=True)
class Masters:
    """Session masters (channel, y, x, value), built once and joined to every batch."""

    dark: DataFrame | None = None
    flat: DataFrame | None = None
    vignette: DataFrame | None = None


def session_masters(spark: SparkSession, frames: DataFrame, folder: str) -> Masters:
    """Median dark, else bias, and normalised flat of calibration frames (frame_id, channel, frame_type, height, width, data)."""
    from skyfold.operators.pixelwise import flat_norm

    kinds = {r[0] for r in frames.select("frame_type").distinct().collect()}

    def stored(name: str, master: DataFrame) -> DataFrame:
        master.write.mode("overwrite").parquet(f"{folder}/masters/{name}")
        return spark.read.parquet(f"{folder}/masters/{name}")

    level = next((k for k in ("dark", "bias") if k in kinds), None)
    dark = stored("dark", R._masters(frames, level)) if level else None
    flat = stored("flat", flat_norm(R._masters(frames, "flat"))) if "flat" in kinds else None
    return Masters(dark, flat)


def survey(spark: SparkSession, stream: DataFrame, masters: Masters, plan: R.StackPlan, folder: str) -> DataFrame:
    """Calibrates and scores all available frames (FRAME) and returns their metrics with the hard gate: score and stars."""

    def batch(rows: DataFrame, n: int) -> None:
        planes = rows.select("frame_id", "channel", "height", "width", "data")
        clean = I.chain(R._calibrated(planes, masters.dark, masters.flat), ["frame_id", "channel"], plan.clean)
        clean = clean if plan.debayer == "none" else I.debayer(clean, ["frame_id"], plan.debayer)
        clean = clean if masters.vignette is None else R.less_vignette(clean, masters.vignette)
        clean.write.mode("overwrite").parquet(f"{folder}/planes/batch={n}")
        stored = spark.read.parquet(f"{folder}/planes/batch={n}")
        found = I.flat_map_frames(R._lead(stored), ["frame_id"], R.METRICS, lambda a: R._measure(a, plan.star_sigma))
        about = rows.groupBy("frame_id").agg(F.min("seq").alias("seq"), F.max("exposure").alias("exposure"))
        gate = (F.col("score") >= plan.quality_threshold) & (F.col("star_count") > 0)
        found.join(about, "frame_id").withColumn("accepted", gate).write.mode("overwrite").parquet(f"{folder}/metrics/batch={n}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/metrics")


def fold(spark: SparkSession, metrics: DataFrame, plan: R.StackPlan, folder: str, burn_in: int = 10) -> tuple[DataFrame, DataFrame]:
    """(stack, shifts): accepted frames on the one with the highest score, clipped in arrival order.

    The stack has (channel, y, x, value, n_used). A star fit whose pairs scatter too far leaves its frame out.
    """
    kept = metrics.filter("accepted").select("frame_id", "seq", "score", "snr", "fwhm")
    best = kept.orderBy(F.desc("score"), "seq").select("frame_id").first()
    if best is None:
        raise ValueError("no frame passed the gate")
    planes = spark.read.parquet(f"{folder}/planes").drop("batch").join(kept, "frame_id")
    lead = R._lead(planes).withColumn("session", F.lit(0))
    one = lead.filter(F.col("frame_id") == best["frame_id"]).select("session", "height", "width", F.col("data").alias("r_data"))
    size = one.select("height", "width").first()
    same = (F.col("height") == size["height"]) & (F.col("width") == size["width"])
    reference = one.select("session", "r_data")
    reference = F.broadcast(reference) if size["height"] * size["width"] * 8 <= R.REFERENCE_BYTES else reference
    placed = I.register_to_reference(lead.filter(same), reference, ["session"], "frame_id", plan.star_sigma, 16 if plan.elastic else 0).drop("session")
    most = F.least(F.greatest(1.5 * F.col("fwhm") / F.greatest("snr", F.lit(1e-6)), F.lit(1.5)), F.lit(6.0))
    placed.join(kept.select("frame_id", most.alias("most")), "frame_id").filter("residual IS NULL OR residual <= most").drop("most").write.mode("overwrite").parquet(f"{folder}/shifts")
    shifts = spark.read.parquet(f"{folder}/shifts")
    px = I.warp_frames(planes.join(shifts, "frame_id"), ["seq", "channel"])
    stack = C.online_clip(px, ["channel", "y", "x"], order="seq", sigma=plan.sigma, burn_in=burn_in)
    return stack.select("channel", "y", "x", "value", "n_used"), shifts


def history(metrics: DataFrame) -> DataFrame:
    """What a live display shows after each accepted frame: frames, exposure and the signal-to-noise ratio so far.

    Sums run per batch first, so that a window holds one batch's frames, or one row a batch.
    """
    kept = metrics.filter("accepted")
    own = kept.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("exposure").alias("e"), F.sum(F.col("snr") * F.col("snr")).alias("s"))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # one row a batch
    start = own.select("batch", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "e", "s")])
    within = Window.partitionBy("batch").orderBy("seq", "frame_id").rowsBetween(Window.unboundedPreceding, 0)
    j = kept.join(start, "batch")
    return j.select("seq", "frame_id", "score", (F.col("_n") + F.count(F.lit(1)).over(within)).alias("frames"), (F.col("_e") + F.sum("exposure").over(within)).alias("total_exposure"), F.sqrt(F.col("_s") + F.sum(F.col("snr") * F.col("snr")).over(within)).alias("snr"))


def save_stack(spark: SparkSession, stack: DataFrame, metrics: DataFrame, output: str, name: str = "live") -> DataFrame:
    """Writes the linear stack with its totals, and a preview; returns (name, bytes)."""
    frames, exposure = metrics.filter("accepted").agg(F.count(F.lit(1)), F.sum("exposure")).first()
    header = {"COMBINED": "T", "RAWSTACK": "T", "NFRAMES": str(frames)} | ({"TOTEXP": f"{exposure:.1f}"} if exposure else {})
    titled = R.whole_image(spark, stack).select(F.lit(name).alias("name"), F.create_map(*[F.lit(x) for kv in header.items() for x in kv]).alias("header"), "channels", "height", "width", "data")
    return files.write_files(files.encode(titled, "fits"), output).unionByName(files.write_files(files.encode(titled, "png"), output))


def stream_stack(spark: SparkSession, stream: DataFrame, masters: Masters, plan: R.StackPlan, folder: str, output: str) -> dict[str, DataFrame]:
    """Survey, fold, save and publish: everything that has arrived, each time it is called."""
    metrics = survey(spark, stream, masters, plan, folder)
    stack, shifts = fold(spark, metrics, plan, folder)
    stack.write.mode("overwrite").parquet(f"{folder}/stack")
    stack = spark.read.parquet(f"{folder}/stack")
    save_stack(spark, stack, metrics, output).collect()
    published = history(metrics)
    published.coalesce(1).sortWithinPartitions("frames").write.mode("overwrite").json(f"{output.rstrip('/')}/history")
    return {"metrics": metrics, "shifts": shifts, "stack": stack, "history": published}
