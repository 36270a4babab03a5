"""Registered queries of the streaming operators, run over the tables as bounded streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.plans.files import shared_folder
from skyfold.plans.stacking import ORACLE_SQL as _STACKING
from skyfold.plans.stacking import PIXELS_SQL, _rounded
from skyfold.plans.tables import SIDE, table
from skyfold.streaming import live as L

KEYS, KINDS = ["session", "y", "x"], "session int, y int, x int"


#: Rows of an arrival file.
ARRIVAL_ROWS = 50_000


def _stream(spark: SparkSession, sf_dir: str, name: str, order: str) -> DataFrame:
    """The table as a directory of files that arrive in two micro-batches, the lower half of the order first; the number of
    files, and so of a micro-batch's tasks, grows with the table."""
    rows = table(spark, sf_dir, name)
    folder = shared_folder(spark, f"arrivals-{name}")
    n, middle = rows.agg(F.count(F.lit(1)), F.percentile_approx(order, 0.5)).first()
    files = max(2, n // (2 * ARRIVAL_ROWS) + 1)
    for half in (F.col(order) <= F.lit(middle), F.col(order) > F.lit(middle)):
        rows.filter(half).repartitionByRange(files, order).sortWithinPartitions(order).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _pixels(batch: DataFrame) -> DataFrame:
    p = batch.select("vec_id", "label", F.posexplode("embedding").alias("p", "e"))
    v = 1000 + 1000 * F.col("e").cast("double") + F.when((F.col("vec_id") * 7 + F.col("p")) % 53 == 0, 5000.0).otherwise(0.0)
    return p.select(F.col("label").cast("int").alias("session"), F.col("vec_id").alias("frame_id"), F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).cast("int").alias("x"), v.alias("v"), (0.5 + (F.col("vec_id") % 10) / 10.0).alias("w"))


def live_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.live_stack(spark, _stream(spark, sf_dir, "embeddings", "vec_id"), _pixels, KEYS, KINDS, shared_folder(spark, "live"))
    return _rounded(found, "value")


def live_online_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.online_clip_stream(spark, _stream(spark, sf_dir, "embeddings", "vec_id"), lambda b: _pixels(b).select(*KEYS, "frame_id", "v"), KEYS, KINDS, "frame_id", shared_folder(spark, "clip"))
    return _rounded(found.select(*KEYS, F.col("mean").alias("value"), "n"), "value")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly integration of the event stream; the state of open windows is dropped behind the watermark, complete ones are kept."""
    stream = _stream(spark, sf_dir, "events", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    windows = L.windowed_integration(stream, "ts", ["event_type"], "value", "1 day", "30 days")
    folder = shared_folder(spark, "windows")
    shaped = windows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "value", "n")
    query = shaped.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    latest = out.groupBy("day", "event_type").agg(F.max_by(F.struct("value", "n"), "batch").alias("r"))
    return _rounded(latest.select("day", "event_type", "r.value", "r.n"), "value")


QUERIES = {q.__name__: q for q in (live_stack, live_online_clip, event_windows)}
ORACLE_SQL = {
    # the streamed clip gives what the batch clip gives
    "live_online_clip": f"SELECT session, y, x, value, n_used AS n FROM ({_STACKING['stack_online_clip']})",
    "live_stack": f"WITH {PIXELS_SQL} SELECT session, y, x, round(sum((0.5 + (frame_id % 10) / 10.0::DOUBLE) * v) / sum(0.5 + (frame_id % 10) / 10.0::DOUBLE), 3) AS value, count(*) AS n FROM px GROUP BY session, y, x",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(avg(value), 3) AS value, count(*) AS n FROM events GROUP BY 1, 2",
}
