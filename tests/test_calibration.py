"""Lights are corrected by the darks, flats and bias frames that match their own settings."""

from __future__ import annotations

import numpy as np
import pytest

from skyfold.plans import calibration, run
from skyfold.sources import formats

SHAPE = (64, 72)


def spot(rng) -> np.ndarray:
    stars = np.random.default_rng(3)
    y, x = np.indices(SHAPE)
    a = np.zeros(SHAPE)
    for sy, sx, flux in np.column_stack([stars.uniform(8, 56, 24), stars.uniform(8, 64, 24), stars.uniform(900, 4000, 24)]):
        a += flux * np.exp(-((y - sy) ** 2 + (x - sx) ** 2) / (2 * 1.5**2))
    return a + rng.normal(0, 2, SHAPE)


def put(folder, name: str, a: np.ndarray, **header) -> None:
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.fits").write_bytes(formats.write_fits(a.astype("f4"), {k.replace("_", "-"): v for k, v in header.items()}))


def test_each_exposure_takes_its_own_dark(spark, tmp_path):
    """Two exposures, and darks of both in a library folder: with one median over all darks, half of the lights would be off by 200."""
    rng = np.random.default_rng(1)
    lights, library = tmp_path / "in", tmp_path / "library"
    for i in range(3):
        put(lights, f"img_a{i}", 1000 + 100 + spot(rng), EXPTIME=10.0, ISOSPEED="800")
        put(lights, f"img_b{i}", 1000 + 500 + spot(rng), EXPTIME=60.0, ISOSPEED="800")
        put(library, f"dark_a{i}", rng.normal(100, 1, SHAPE), EXPTIME=10.0, ISOSPEED="800")
        put(library, f"dark_b{i}", rng.normal(500, 1, SHAPE), EXPTIME=60.0, ISOSPEED="800")
        put(library, f"dark_c{i}", rng.normal(9000, 1, SHAPE), EXPTIME=60.0, ISOSPEED="6400")
        put(library, f"dark_d{i}", rng.normal(7000, 1, (20, 20)), EXPTIME=60.0, ISOSPEED="800")
    plan = run.StackPlan(clean=(), combine="median", weighted=False, quality_threshold=0.0, outlier_sigma=50.0, calibration=str(library))
    run.stack_directory(spark, str(lights), f"{tmp_path}/out", plan)
    cleaned = spark.read.parquet(f"{tmp_path}/out/phases-{plan.key()}/cleaned").collect()
    assert len(cleaned) == 6
    assert all(np.median(r["data"]) == pytest.approx(1000, abs=2) for r in cleaned)
    image, _ = formats.read_fits(open(f"{tmp_path}/out/stack.fits", "rb").read())
    assert np.median(image) == pytest.approx(1000, abs=2)


def test_scaled_darks_over_the_bias_flats_by_filter_and_hot_pixels(spark, tmp_path):
    rng = np.random.default_rng(2)
    dark = np.full(SHAPE, 300.0)
    dark[10, 12] = dark[40, 51] = 6000
    light = lambda current: 1000 + spot(rng) + 200 + current * (dark - 200)
    for i in range(2):
        put(tmp_path, f"img_{i}", light(2.0) * 1.0, EXPTIME=60.0, FILTER="Ha")
        put(tmp_path, f"dark_{i}", dark + rng.normal(0, 1, SHAPE), EXPTIME=30.0)
        put(tmp_path, f"bias_{i}", rng.normal(200, 1, SHAPE), EXPTIME=0.0)
        put(tmp_path, f"flat_h{i}", rng.normal(800, 1, SHAPE), EXPTIME=1.0, FILTER="ha")
        put(tmp_path, f"flat_o{i}", rng.normal(800, 1, SHAPE) * np.linspace(0.5, 1.5, SHAPE[1]), EXPTIME=1.0, FILTER="OIII")
    plan = run.StackPlan(clean=(), combine="mean", weighted=False, quality_threshold=0.0, outlier_sigma=50.0)
    result = run.stack_directory(spark, str(tmp_path), f"{tmp_path}/out", plan)
    phases = f"{tmp_path}/out/phases-{plan.key()}"
    made = {r["kind"]: r for r in spark.read.parquet(f"{phases}/masters").collect()}
    assert set(made) == {"bias", "dark", "flat"} and sorted(made["dark"]["hot"]) == [10 * SHAPE[1] + 12, 40 * SHAPE[1] + 51]
    assert np.allclose(made["flat"]["data"], 1, atol=0.02)  # the matching filter's
    for r in spark.read.parquet(f"{phases}/cleaned").collect():
        a = np.reshape(r["data"], SHAPE)
        assert np.median(a) == pytest.approx(1000, abs=12)
        assert a[10, 12] < 3000 and a[40, 51] < 6000
    assert result["stack"].count() == SHAPE[0] * SHAPE[1]


def test_large_masters_are_joined(spark, monkeypatch):
    frames = [(1, 0, "light", 30.0, 500.0), (2, 0, "light", 60.0, 500.0), (3, 0, "dark", 30.0, 100.0), (4, 0, "dark", 60.0, 250.0), (5, 0, "light", None, 500.0)]
    planes = spark.createDataFrame([(i, c, k, 2, 3, [v] * 6) for i, c, k, _, v in frames], "frame_id long, channel int, frame_type string, height int, width int, data array<double>")
    meta = spark.createDataFrame([(i, k, {} if e is None else {"EXPTIME": str(e)}) for i, _, k, e, _ in frames], "frame_id long, frame_type string, header map<string,string>")
    grouped, chosen = calibration.matched(calibration.settings(meta, planes.select("frame_id", "height", "width").distinct()))
    made = calibration.masters(planes, chosen)
    lights = planes.filter("frame_type = 'light'").drop("frame_type")
    got = []
    for limit in (calibration.HELD_BYTES, 0):
        monkeypatch.setattr(calibration, "HELD_BYTES", limit)
        got.append({r["frame_id"]: r["data"][0] for r in calibration.calibrate(lights, grouped, made, False).collect()})
    assert got[0] == pytest.approx(got[1]) and got[0][1] == pytest.approx(400) and got[0][2] == pytest.approx(250)
    assert calibration.calibrate(lights, grouped, made.limit(0), False).count() == 3


def test_turning_and_filling():
    a = np.zeros((41, 41))
    a[20, 30] = 1
    assert np.unravel_index(calibration.turned(a, 90).argmax(), a.shape) in ((10, 20), (30, 20))
    assert np.allclose(calibration.turned(calibration.turned(np.full((9, 12), 3.0), 30), -30), 3)
    m = np.tile([[1.0, 2.0], [3.0, 4.0]], (5, 5))
    bad = np.zeros(m.shape, bool)
    bad[4, 4] = bad[0, 1] = True
    broken = np.where(bad, 99, m)
    assert np.array_equal(calibration.fill_known(broken, bad, 2), m)
