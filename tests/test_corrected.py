"""Corrected kernels: gradient demosaicing, few samples in the deviate test, saturated cores, halos, PSF and star masks."""

from __future__ import annotations

import numpy as np
import pytest

from skyfold.functions import kernels as K
from skyfold.functions import restore as R
from skyfold.operators import combine as C


@pytest.mark.parametrize("pattern", ["RGGB", "BGGR", "GRBG", "GBRG"])
def test_gradient_demosaicing_of_impulses_and_planes(pattern):
    flat = K.debayer_gradient(np.full((20, 24), 500.0), pattern)
    assert np.allclose(flat, 500)
    masks = K.bayer_masks((20, 24), pattern)
    y, x = np.argwhere(masks["R"][6:14, 6:14])[0] + 6
    raw = np.zeros((20, 24))
    raw[y, x] = 8
    rgb = K.debayer_gradient(raw, pattern)
    assert rgb[y, x].tolist() == [8, 4, 6]  # the published kernels' middles: 1, 4/8 and 6/8
    assert rgb[y, x + 2, 1] == -1 and rgb[y + 2, x, 2] == -1.5 and rgb[y + 1, x + 1, 0] == 2 and rgb[y, x + 1, 0] == 4
    step = np.repeat(np.where(np.arange(60) < 30, 0.0, 1000.0)[None], 60, 0)
    error = lambda f: np.abs(f(step)[10:-10, 10:-10, 1] - step[10:-10, 10:-10]).mean()
    assert error(K.debayer_gradient) <= error(K.debayer_bilinear)


def test_deviates_of_one_to_three_samples(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 100.0), ("b", 1.0), ("b", 100.0), ("c", 7.0), ("d", 1.0), ("d", 2.0), ("d", 3.0), ("e", None)]
    got = {r["k"]: (r["value"], r["n_used"], r["n_rejected"]) for r in C.esd(spark.createDataFrame(rows, "k string, v double"), ["k"]).collect()}
    assert got == {"a": (1.0, 2, 1), "b": (50.5, 2, 0), "c": (7.0, 1, 0), "d": (2.0, 3, 0)}
    assert C.esd_limit(3, 0.05) == pytest.approx(1.1543, abs=1e-4)  # tabulated critical values
    assert C.esd_limit(10, 0.05) == pytest.approx(2.290, abs=1e-3)


def star(amplitude: float, alpha: float = 4.0, beta: float = 2.6, shape=(120, 120), at=(60, 60), sky: float = 100.0) -> np.ndarray:
    y, x = np.indices(shape)
    return sky + amplitude * R.moffat((y - at[0]) ** 2 + (x - at[1]) ** 2, alpha, beta)


def test_clipped_cores_rise_and_keep_their_colour():
    truth = np.stack([star(60000), star(45000), star(30000)], -1)
    cut = np.minimum(truth, 25000)
    out = R.repair_saturated(cut)
    assert out.shape == cut.shape and (out >= cut).all()
    for c in range(3):
        assert out[60, 60, c] == pytest.approx(truth[60, 60, c], rel=0.15)
    assert out[60, 60, 0] > out[60, 60, 1] > out[60, 60, 2]
    assert (out[60, 90] == cut[60, 90]).all()


def test_cores_at_the_edge_and_hot_pixels():
    truth = star(60000, at=(60, 4))
    out = R.repair_saturated(np.minimum(truth, 20000))
    assert out[60, 4] > 40000
    plain = star(5000)
    plain[5, 5] = 2 * plain.max()
    assert R.repair_saturated(plain)[5, 5] == plain[5, 5]


def test_halos_of_all_bright_stars_go_in_one_model():
    y, x = np.indices((120, 160))
    a, places = np.full(y.shape, 100.0), [(40, 40), (70, 110)]
    for sy, sx in places:
        r2 = (y - sy) ** 2 + (x - sx) ** 2
        a += 5000 * np.exp(-r2 / (2 * 1.5**2)) + 60 * np.exp(-r2 / (2 * 12.0**2))
    stars = np.array([(sy, sx, 5000.0, 5000.0, 0.0) for sy, sx in places])
    out = R.remove_halos(a, stars, 3.5)
    for sy, sx in places:
        assert out[sy, sx] == a[sy, sx]
        assert abs(out[sy, sx + 12] - 100) < 0.35 * (a[sy, sx + 12] - 100)
    assert np.abs(out[0:5, 80:100] - a[0:5, 80:100]).max() < 3


def test_psf_needs_lone_stars():
    rng = np.random.default_rng(2)
    a, stars = np.zeros((200, 200)), []
    for sy in range(20, 190, 24):
        for sx in range(20, 190, 24):
            at = (sy + rng.uniform(-0.5, 0.5), sx + rng.uniform(-0.5, 0.5))
            a += star(1000, 2.4, 3.0, a.shape, at, 0.0)
            stars.append((*at, 1.0))
    a += 50 + rng.normal(0, 1, a.shape)
    psf, width = R.estimate_psf(a, np.array(stars))
    assert width == pytest.approx(2 * 2.4 * (2 ** (1 / 3) - 1) ** 0.5, rel=0.05) and psf.sum() == pytest.approx(1)
    doubled = np.array([*stars, *((y + 2, x, 1.0) for y, x, _ in stars)])
    assert R.estimate_psf(a, doubled) == (None, 0.0)


def test_star_masks_cover_dense_fields():
    stars = np.argwhere(np.ones((40, 40)))[::1].astype(float) * 5
    mask = K.star_mask((200, 200), stars, 1.0)
    assert (mask[tuple(stars.astype(int).T)] > 0.3).all()
