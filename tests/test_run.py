"""The batch run over synthetic frames: calibration, the gate, registration, stacking, output and resuming."""

from __future__ import annotations

import os

import numpy as np

from skyfold.functions import kernels as K
from skyfold.functions import registration
from skyfold.plans import run
from skyfold.sources import formats


def write_session(folder, n: int = 6, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.indices((72, 80))
    stars = np.column_stack([rng.uniform(14, 58, 24), rng.uniform(14, 66, 24), rng.uniform(800, 4000, 24)])
    truth = None
    for i in range(n):
        dy, dx = (0, 0) if i == 0 else rng.integers(-4, 5, 2)
        a = np.full(y.shape, 1000.0)
        for sy, sx, flux in stars:
            a += flux * np.exp(-((y - sy - dy) ** 2 + (x - sx - dx) ** 2) / (2 * 1.5**2))
        truth = a if i == 0 else truth
        a = a * 0.9 + 50 + rng.normal(0, 5, a.shape)
        if i == 2:
            a[30:32, 20:60] += 3000
        (folder / f"img_{i}.fits").write_bytes(formats.write_fits(a.astype("f4"), {"EXPTIME": 30.0}))
    for i in range(3):
        (folder / f"dark_{i}.fits").write_bytes(formats.write_fits(rng.normal(50, 1, y.shape).astype("f4"), {"EXPTIME": 30.0}))
        (folder / f"flat_{i}.fits").write_bytes(formats.write_fits(rng.normal(900, 2, y.shape).astype("f4"), {"EXPTIME": 1.0}))
    (folder / "img_bad.fits").write_bytes(formats.write_fits(rng.normal(1000, 5, y.shape).astype("f4"), {"EXPTIME": 30.0}))
    return truth * 0.9


def test_stack_directory(spark, tmp_path):
    truth = write_session(tmp_path)
    out = f"{tmp_path}/out"
    plan = run.StackPlan(formats=("fits", "png"), clean=(), sigma=2.5)
    result = run.stack_directory(spark, str(tmp_path), out, plan)
    rows = {r["frame_id"]: r for r in result["metrics"].collect()}
    assert len(rows) == 7 and sum(not r["accepted"] for r in rows.values()) == 1
    image, header = formats.read_fits(open(f"{out}/stack.fits", "rb").read())
    assert header["NFRAMES"] == "6" and os.path.exists(f"{out}/stack.png") and "sigma_clip" in open(f"{out}/plan.toml").read()
    best = result["shifts"].filter("abs(dy) < 0.01 AND abs(dx) < 0.01").count()
    assert best >= 1
    core = image[12:60, 12:68]
    score = [np.corrcoef(core.ravel(), np.roll(truth, (dy, dx), (0, 1))[12:60, 12:68].ravel())[0, 1] for dy in range(-5, 6) for dx in range(-5, 6)]
    assert max(score) > 0.98
    stamp = os.path.getmtime(f"{out}/phases-{plan.key()}/stack/_SUCCESS")
    run.stack_directory(spark, str(tmp_path), out, plan)
    assert os.path.getmtime(f"{out}/phases-{plan.key()}/stack/_SUCCESS") == stamp  # resumed


def test_changed_inputs_are_run_again(spark, tmp_path):
    rng = np.random.default_rng(2)
    plan = run.StackPlan(clean=(), quality_threshold=0.0, combine="median", weighted=False)
    y, x = np.indices((40, 44))
    spot = 3000 * np.exp(-((y - 20) ** 2 + (x - 22) ** 2) / 8)
    for level in (100, 5000):
        for i in range(3):
            (tmp_path / f"img_{i}.fits").write_bytes(formats.write_fits((level + spot + rng.normal(0, 1, y.shape)).astype("f4"), {"EXPTIME": 30.0 + i}))
        found = run.stack_directory(spark, str(tmp_path), f"{tmp_path}/out", plan)["stack"]
        assert abs(found.filter("y < 8 AND x < 8").agg({"value": "avg"}).first()[0] - level) < 3


def test_drizzle_presets_and_sweep(spark, tmp_path):
    write_session(tmp_path, 4)
    fine = run.stack_directory(spark, str(tmp_path), f"{tmp_path}/out2", run.StackPlan.preset("quick", drizzle=2.0))
    assert fine["stack"].agg({"y": "max"}).first()[0] > 100
    swept = run.quality_sweep(spark, str(tmp_path)).collect()
    assert len({r["path"] for r in swept}) >= 5 and any(not r["accepted"] for r in swept)


def star_field(rng, n: int, shape: tuple[int, int], margin: float) -> np.ndarray:
    return np.column_stack([rng.uniform(margin, shape[0] - margin, n), rng.uniform(margin, shape[1] - margin, n), rng.uniform(800, 4000, n)])


def draw(shape: tuple[int, int], stars: np.ndarray) -> np.ndarray:
    y, x = np.indices(shape)
    a = np.full(shape, 1000.0)
    for sy, sx, flux in stars:
        a += flux * np.exp(-((y - sy) ** 2 + (x - sx) ** 2) / (2 * 1.5**2))
    return a


def turned(stars: np.ndarray, shape: tuple[int, int], dy: float, dx: float, degrees: float) -> np.ndarray:
    """Stars of the frame that `matrix(shape, dy, dx, angle)` brings back onto the field."""
    t = np.linalg.inv(registration.matrix(shape, dy, dx, np.deg2rad(degrees)))
    return np.column_stack([stars[:, :2] @ t[:2, :2].T + t[:2, 2], stars[:, 2]])


def test_subpixel_and_pyramid_shifts():
    rng = np.random.default_rng(1)
    stars = star_field(rng, 30, (160, 192), 30)
    reference = draw((160, 192), stars)
    moved = draw((160, 192), stars - [3.35, -7.8, 0])
    for found in (registration.refined_shift(reference, moved), registration.pyramid_shift(reference, moved, finest=0)):
        assert np.allclose(found, (3.35, -7.8), atol=0.06)
    assert np.allclose(registration.pyramid_shift(reference, moved), (3.35, -7.8), atol=0.3)
    assert registration.pyramid_shift(np.ones((9, 9)), np.ones((9, 9))) is not None


def test_register_by_stars_distances_and_shift():
    rng = np.random.default_rng(3)
    shape = (150, 170)
    stars = star_field(rng, 26, shape, 30)
    reference = draw(shape, stars) + rng.normal(0, 4, shape)
    for degrees, method in ((0.6, "stars"), (24.0, "distances")):
        moving = draw(shape, turned(stars, shape, 4.5, -3.25, degrees)) + rng.normal(0, 4, shape)
        fit = registration.register(reference, K.detect_stars(reference, k=8), moving, K.detect_stars(moving, k=8))
        assert fit.method == method and fit.matched >= 10 and fit.residual < 0.5
        assert np.allclose((fit.dy, fit.dx, np.rad2deg(fit.angle)), (4.5, -3.25, degrees), atol=0.15)
    none = np.empty((0, 5))
    assert registration.register(reference, none, reference, none) == registration.Fit(0.0, 0.0)


def test_turned_colour_frames_are_stacked(spark, tmp_path):
    rng = np.random.default_rng(9)
    shape, gains = (96, 110), np.array([0.5, 1.0, 0.8])[:, None, None]
    stars = star_field(rng, 24, shape, 24)
    for i, (dy, dx, degrees) in enumerate(((0, 0, 0), (1.5, -2, 2.0), (-2, 1, -3.0), (2.5, 2, 4.0))):
        a = draw(shape, turned(stars, shape, dy, dx, degrees)) * gains + rng.normal(0, 3 + i, (3, *shape))
        (tmp_path / f"img_{i}.fits").write_bytes(formats.write_fits(a.astype("f4"), {"EXPTIME": 30.0}))
    plan = run.StackPlan(clean=(), combine="mean", weighted=False, outlier_sigma=50.0, shift_sigma=50.0)
    result = run.stack_directory(spark, str(tmp_path), f"{tmp_path}/out", plan)
    fits = result["shifts"].collect()
    assert len(fits) == 4 and {f["method"] for f in fits} <= {"stars", "distances"} and max(abs(f["angle"]) for f in fits) > np.deg2rad(1.5)
    image, _ = formats.read_fits(open(f"{tmp_path}/out/stack.fits", "rb").read())
    assert image.shape == (3, *shape)
    inner = (slice(None), slice(24, 72), slice(24, 86))
    levels = np.median(image[inner], axis=(1, 2))
    assert np.allclose(levels / levels[1], gains.ravel(), atol=0.03)
    references = [draw(shape, turned(stars, shape, dy, dx, d))[24:72, 24:86] for dy, dx, d in ((0, 0, 0), (1.5, -2, 2.0), (-2, 1, -3.0), (2.5, 2, 4.0))]
    assert max(np.corrcoef(image[1, 24:72, 24:86].ravel(), r.ravel())[0, 1] for r in references) > 0.98


def test_debayered_run_keeps_three_planes(spark, tmp_path):
    rng = np.random.default_rng(4)
    shape = (64, 72)
    field = draw(shape, star_field(rng, 18, shape, 10))
    y, x = np.indices(shape)
    mosaic = field * np.where((y + x) % 2 == 1, 1.0, np.where(y % 2 == 0, 0.6, 0.8))
    for i in range(3):
        (tmp_path / f"img_{i}.fits").write_bytes(formats.write_fits((mosaic + rng.normal(0, 3, shape)).astype("f4"), {"EXPTIME": 30.0}))
    plan = run.StackPlan(clean=(), combine="median", weighted=False, outlier_sigma=50.0, debayer="bilinear")
    stack = run.stack_directory(spark, str(tmp_path), f"{tmp_path}/out", plan)["stack"]
    levels = [r[1] for r in stack.groupBy("channel").agg({"value": "median"}).orderBy("channel").collect()]
    assert np.allclose(levels, [600, 1000, 800], rtol=0.05)
