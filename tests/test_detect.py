"""Star detection on a local noise map, two-step block matching and the rotational gradient."""

from __future__ import annotations

import numpy as np
import pytest

from skyfold.functions import collaborative as B
from skyfold.functions import detect as D
from skyfold.functions import kernels as K


def field(n: int, seed: int, fwhm: float = 3.0, shape=(300, 400)) -> tuple[np.ndarray, np.ndarray]:
    """Stars on a sloped sky whose noise grows along the slope, with hot pixels and a trail."""
    rng = np.random.default_rng(seed)
    y, x = np.indices(shape)
    a = 500 + 3.0 * x + 0.5 * y
    a = a + rng.normal(0, 1, shape) * (4 + 16 * x / shape[1])
    places = []
    while len(places) < n:
        p = (rng.uniform(15, shape[0] - 15), rng.uniform(15, shape[1] - 15))
        if all(np.hypot(p[0] - q[0], p[1] - q[1]) > 15 for q in places):
            places.append(p)
    for sy, sx in places:
        a += rng.uniform(250, 3000) * np.exp(-((y - sy) ** 2 + (x - sx) ** 2) / (2 * (fwhm / 2.3548) ** 2))
    for _ in range(20):
        a[rng.integers(10, shape[0] - 10), rng.integers(10, shape[1] - 10)] += 2500
    return a, np.array(places)


def f1(found: np.ndarray, truth: np.ndarray) -> float:
    gap = np.hypot(found[:, None, 0] - truth[None, :, 0], found[:, None, 1] - truth[None, :, 1])
    hits = (gap.min(0) < 1.5).sum() if len(found) else 0
    return 2 * hits / (len(found) + len(truth))


@pytest.mark.parametrize(("n", "fwhm"), [(20, 3.0), (32, 2.4), (45, 4.5)])
def test_stars_on_a_sloped_sky(n, fwhm):
    a, truth = field(n, n, fwhm)
    for given in (fwhm, None):
        assert f1(D.detect(a, given), truth) > 0.9
    assert f1(D.detect(a, fwhm), truth) > f1(K.detect_stars(a, fwhm), truth)
    assert D.width(a) == pytest.approx(fwhm, rel=0.3)
    best = D.detect(a, fwhm)
    gap = np.hypot(best[:, None, 0] - truth[None, :, 0], best[:, None, 1] - truth[None, :, 1])
    assert np.median(gap.min(1)) < 0.15


def test_strips_of_any_height_give_the_same_stars():
    a, _ = field(30, 7)
    whole = D.detect(a, strip=10_000)
    for strip in (300, 64, 17, 1):
        assert np.array_equal(D.detect(a, strip=strip), whole)


def test_small_flat_and_empty_frames():
    assert D.detect(np.full((8, 8), 5.0)).shape == (0, 7)
    assert D.detect(np.zeros((1, 1)), border=0).shape == (0, 7)
    trail = np.random.default_rng(1).normal(100, 2, (80, 80))
    trail[40] += 300
    assert len(D.detect(trail, 3.0)) == 0


def test_transforms_are_orthonormal():
    for n in (2, 4, 8, 16):
        assert np.allclose(B.dct_matrix(n) @ B.dct_matrix(n).T, np.eye(n)) and np.allclose(B.hadamard(n) @ B.hadamard(n).T, np.eye(n))


def test_like_blocks_are_those_of_a_full_search():
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, (20, 24))
    ys, xs = np.array([0, 7, 14]), np.array([0, 9, 18])
    py, px = B.like_blocks(a, ys, xs, 5, 4, 8)
    for r, (y, x) in enumerate((y, x) for y in ys for x in xs):
        d = sorted(((a[y : y + 5, x : x + 5] - a[v : v + 5, u : u + 5]) ** 2).sum() for v in range(max(0, y - 4), min(15, y + 4) + 1) for u in range(max(0, x - 4), min(19, x + 4) + 1))
        got = [((a[y : y + 5, x : x + 5] - a[v : v + 5, u : u + 5]) ** 2).sum() for v, u in zip(py[r], px[r], strict=True)]
        assert (py[r, 0], px[r, 0]) == (y, x) and np.allclose(sorted(got), d[: len(got)], atol=1e-4)


def test_two_steps_beat_one_and_keep_edges():
    rng = np.random.default_rng(4)
    y, x = np.indices((96, 96))
    truth = 100.0 * ((x // 24 + y // 24) % 2) + 20 * np.sin(x / 5)
    noisy = truth + rng.normal(0, 20, truth.shape)
    error = lambda b: np.sqrt(((b - truth) ** 2).mean())
    one = B._pass(noisy, noisy, 20.0, 8, 16, 8, 3, False, 2.7)
    two = B.block_match(noisy, 20.0)
    assert error(two) < error(one) < 0.6 * error(noisy)
    assert error(two) < 0.4 * error(noisy)
    assert np.array_equal(B.block_match(noisy, 0.0), noisy) and B.block_match(noisy[:5, :7], 20.0).shape == (5, 7)
    assert np.allclose(B.block_match(np.full((20, 20), 7.0), 3.0), 7)


def test_jets_appear_and_a_round_coma_vanishes():
    y, x = np.indices((81, 81))
    dy, dx = y - 40.0, x - 40.0
    coma = 1000 / (1 + np.hypot(dy, dx))
    jet = 60 * np.exp(-((np.arctan2(dy, dx) - 0.6) ** 2) / 0.01) * (np.hypot(dy, dx) > 3)
    ring = (np.hypot(dy, dx) > 8) & (np.hypot(dy, dx) < 30)
    plain = B.rotational_gradient(coma, 40, 40, 0.0, 20)
    assert np.abs(plain[ring]).max() < 1.5
    both = B.rotational_gradient(coma + jet, 40, 40, 0.0, 20)
    at = np.unravel_index(np.where(ring, both, -np.inf).argmax(), both.shape)
    assert abs(np.arctan2(at[0] - 40, at[1] - 40) - 0.6) < 0.1 and both[at] > 80
