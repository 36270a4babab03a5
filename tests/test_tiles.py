"""Combiners over tiles of whole frames equal the row form, whatever the tiles' size."""

from __future__ import annotations

import numpy as np
import pytest

from skyfold.operators import combine as C
from skyfold.operators import image_ops as I
from skyfold.operators import tiles as T


def fixture(n: int = 30, h: int = 12, w: int = 14, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    a = rng.normal(1000, 30, (n, h, w))
    a.ravel()[rng.choice(a.size, a.size // 15, replace=False)] += rng.uniform(200, 2000, a.size // 15) * rng.choice([-1, 1], a.size // 15)
    a[:, 0, 0] = 7.0  # no spread
    a[:, 0, 1] = np.nan  # no samples
    a[1:, 0, 2] = np.nan  # one sample
    a[2:, 0, 3] = np.nan
    a[rng.random(a.shape) < 0.03] = np.nan
    return a


METHODS = [
    ("mean", {}), ("median", {}), ("sigma_clip", {}), ("sigma_clip", {"robust": False, "sigma": 2.0}), ("winsorized", {"sigma": 2.5}), ("percentile", {}), ("percentile", {"low": 49.9, "high": 50.1}),
    ("linear_fit", {}), ("linear_fit", {"sigma_low": 1.5, "sigma_high": 1.5}), ("trimmed_mean", {}), ("trimmed_mean", {"low": 0.5, "high": 0.5}), ("esd", {}), ("esd", {"most": 3}),
]


@pytest.mark.parametrize(("n", "weighted"), [(30, False), (9, True), (1, False)])
def test_tiles_equal_rows(spark, n, weighted):
    a = fixture(n)
    weights = np.random.default_rng(1).uniform(0.5, 1.5, n)
    rows = [(0, i, float(weights[i]), *a.shape[1:], [float(v) for v in a[i].ravel()]) for i in range(n)]
    frames = spark.createDataFrame(rows, "session int, frame_id int, weight double, height int, width int, data array<double>").repartition(3).cache()
    px = I.to_pixels(frames, ["session", "frame_id", "weight"]).cache()
    for method, params in METHODS:
        extra = {"weight": "weight"} if weighted and method != "median" else {}
        by = {"order": "frame_id"} if method in ("linear_fit", "trimmed_mean", "esd") else {}
        expected = {(r["y"], r["x"]): (r["value"], r["n_used"], r["n_rejected"]) for r in C.combine(px, ["session", "y", "x"], "v", method, **params, **extra, **by).collect()}
        for size in (5, 64):
            got = {(r["y"], r["x"]): (r["value"], r["n_used"], r["n_rejected"]) for r in T.to_pixels(T.stack_frames(frames, ["session"], "frame_id", method, size=size, **extra, **params), ["session"]).collect()}
            assert len(got) == a.shape[1] * a.shape[2]
            for at, (value, used, rejected) in got.items():
                if at not in expected:  # the row form has no row for a pixel without samples
                    assert (value, used, rejected) == (0, 0, 0), (method, at)
                    continue
                assert value == pytest.approx(expected[at][0], abs=1e-6) and (used, rejected) == expected[at][1:], (method, params, size, at)


def test_planes_come_back_whole(spark):
    a = fixture(3)
    rows = [(k, i, *a.shape[1:], [float(v) for v in np.nan_to_num(a[i]).ravel()]) for k in (0, 1) for i in range(3)]
    frames = spark.createDataFrame(rows, "session int, frame_id int, height int, width int, data array<double>")
    planes = {r["session"]: np.reshape(r["data"], (r["height"], r["width"])) for r in T.to_planes(T.stack_frames(frames, ["session"], "frame_id", "mean", size=5), ["session"]).collect()}
    assert set(planes) == {0, 1} and all(np.allclose(p, np.nan_to_num(a).mean(0)) for p in planes.values())


def test_tiles_stay_within_the_budget():
    assert T.side(1) == T.LARGEST and T.side(10**9) == T.SMALLEST
    for n in (100, 1000, 50_000):
        assert 8 * n * T.side(n) ** 2 <= T.BUDGET
    with pytest.raises(ValueError):
        T.combine_tiles(None, [], "unknown", "frame_id")
