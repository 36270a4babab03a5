"""Live stacking: restarts, state versions, and the streamed clip against the batch one."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from skyfold.operators import combine as C
from skyfold.streaming import live as L

SCHEMA = "f long, p int, v double"


def arrivals(spark, folder, rows: list[tuple], files: int) -> None:
    for k, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        spark.createDataFrame([rows[i] for i in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def samples(n: int, seed: int = 4) -> list[tuple]:
    rng = np.random.default_rng(seed)
    a = rng.normal(100, 5, (n, 3))
    a[rng.random(a.shape) < 0.1] += 500
    return [(i, p, float(a[i, p])) for i in range(n) for p in range(3)]


def test_live_stack_restarts_where_it_was(spark, tmp_path):
    rows = samples(12)
    arrivals(spark, tmp_path / "in", rows[:18], 3)
    run = lambda: {r["p"]: (r["value"], r["n"]) for r in L.live_stack(spark, stream(spark, tmp_path / "in"), lambda b: b.withColumn("w", F.lit(1.0)), ["p"], "p int", f"{tmp_path}/live").collect()}
    first = run()
    assert first and run() == first  # nothing new: the last version
    arrivals(spark, tmp_path / "in", rows[18:], 1)
    second = run()
    for p in range(3):
        v = [r[2] for r in rows if r[1] == p]
        assert second[p][1] == 12 and abs(second[p][0] - np.mean(v)) < 1e-9
    assert len([n for n in os.listdir(tmp_path / "live" / "state") if n.startswith("v")]) == 2


def test_streamed_clip_equals_the_batch_clip(spark, tmp_path):
    rows = samples(40)
    arrivals(spark, tmp_path / "in", rows, 6)
    streamed = {r["p"]: r for r in L.online_clip_stream(spark, stream(spark, tmp_path / "in"), lambda b: b, ["p"], "p int", "f", f"{tmp_path}/clip", burn_in=10).collect()}
    for r in C.online_clip(spark.createDataFrame(rows, SCHEMA), ["p"], order="f").collect():
        s = streamed[r["p"]]
        assert (s["mean"], s["n"], s["m2"]) == (r["value"], r["n_used"], r["m2"]) and s["n"] < 40
    few = [r for r in rows if r[0] < 4]
    arrivals(spark, tmp_path / "few", few, 2)
    short = {r["p"]: r["mean"] for r in L.online_clip_stream(spark, stream(spark, tmp_path / "few"), lambda b: b, ["p"], "p int", "f", f"{tmp_path}/clip2").collect()}
    assert short == {r["p"]: r["value"] for r in C.online_clip(spark.createDataFrame(few, SCHEMA), ["p"], order="f").collect()}
