"""Correlation of the clear parts of frames, and trials that end with the inlier share."""

from __future__ import annotations

import numpy as np
import pytest

from skyfold.functions import kernels as K
from skyfold.functions import registration as R


def scene(shape=(96, 112), dy: float = 0.0, dx: float = 0.0, seed: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.indices(shape)
    a = np.full(shape, 500.0)
    for _ in range(60):
        a += rng.uniform(50, 400) * np.exp(-((y - rng.uniform(-10, shape[0] + 10) - dy) ** 2 + (x - rng.uniform(-10, shape[1] + 10) - dx) ** 2) / (2 * rng.uniform(1.5, 4) ** 2))
    return a


@pytest.mark.parametrize("shift", [(0, 0), (5, -7), (-11.4, 3.3)])
def test_shift_of_the_clear_half(shift):
    rng = np.random.default_rng(1)
    reference = scene() + rng.normal(0, 3, (96, 112))
    moving = scene(dy=-shift[0], dx=-shift[1]) + rng.normal(0, 3, (96, 112))
    cloud = np.zeros(moving.shape, bool)
    cloud[:, 56:] = True
    y, x = np.indices(moving.shape)
    covered = np.where(cloud, 3000 + 500 * np.sin(y / 11) + 300 * np.cos(x / 7) + rng.normal(0, 3, moving.shape), moving)
    dy, dx, agreement = R.masked_shift(reference, covered, np.ones(moving.shape, bool), ~cloud)
    assert (dy, dx) == pytest.approx(shift, abs=0.3) and agreement > 0.8
    assert R.pyramid_shift(reference, covered, finest=0) != pytest.approx(shift, abs=1)
    seen = R.clear_samples(covered)
    assert (seen[:, :48]).mean() > 0.6 and not seen[:, 64:].any()
    fit = R.register(reference, np.empty((0, 5)), covered, np.empty((0, 5)))
    assert fit.method == "masked" and (fit.dy, fit.dx) == pytest.approx(shift, abs=0.5)


def test_masks_without_anything_in_common():
    a = scene((20, 20))
    none = np.zeros(a.shape, bool)
    assert R.masked_shift(a, a, none, none)[2] <= 0
    assert R.masked_shift(a, a, ~none, ~none)[:2] == pytest.approx((0, 0), abs=0.05)


def test_consensus_among_wrong_pairs_and_few_trials(monkeypatch):
    rng = np.random.default_rng(2)
    src = rng.uniform(0, 500, (55, 2))
    t = R.matrix((500, 500), 12.0, -7.0, np.deg2rad(3.7))
    dst = src @ t[:2, :2].T + t[:2, 2] + rng.normal(0, 0.2, src.shape)
    dst[40:] = rng.uniform(0, 500, (15, 2))
    found, inliers = K.rigid_ransac(src, dst)
    assert inliers[:40].all() and inliers[40:].sum() <= 1
    assert np.rad2deg(np.arctan2(found[1, 0], found[0, 0])) == pytest.approx(3.7, abs=0.05)
    count = []
    fit = K.rigid_fit
    monkeypatch.setattr(K, "rigid_fit", lambda *a: count.append(1) or fit(*a))
    K.rigid_ransac(src[:40], dst[:40])
    assert len(count) < 10  # all agree: one trial and the refit would do
    count.clear()
    K.rigid_ransac(rng.uniform(0, 500, (40, 2)), rng.uniform(0, 500, (40, 2)))
    assert len(count) >= 200
