"""Array kernels against direct versions and known images."""

from __future__ import annotations

import numpy as np
import pytest

from skyfold.functions import collaborative
from skyfold.functions import kernels as K


def field(shape=(64, 64), n=12, seed=0, sky=100.0, noise=2.0):
    rng = np.random.default_rng(seed)
    y, x = np.indices(shape)
    a = rng.normal(sky, noise, shape)
    stars = np.column_stack([rng.uniform(8, shape[0] - 8, n), rng.uniform(8, shape[1] - 8, n)])
    for sy, sx in stars:
        a += 800 * np.exp(-((y - sy) ** 2 + (x - sx) ** 2) / (2 * 1.3**2))
    return a, stars


def test_filters_by_loops():
    a = np.random.default_rng(0).normal(0, 1, (9, 11))
    p = np.pad(a, 1, mode="symmetric")
    assert np.allclose(K.median_filter(a), [[np.median(p[i : i + 3, j : j + 3]) for j in range(11)] for i in range(9)])
    k = np.arange(9.0).reshape(3, 3)
    assert np.allclose(K.convolve(a, k), [[(p[i : i + 3, j : j + 3] * k[::-1, ::-1]).sum() for j in range(11)] for i in range(9)])
    assert np.allclose(K.gaussian(np.full((8, 8), 3.0), 1.5), 3.0)
    assert abs(K.gaussian(np.pad([[1.0]], 10), 1.0).sum() - 1) < 1e-9


def test_transforms_invert():
    a = np.random.default_rng(1).normal(0, 1, (16, 24))
    assert np.allclose(sum(K.starlet(a, 3)), a)
    ll, d = K.haar2(a)
    assert np.allclose(K.unhaar2(ll, d), a)


def test_debayering_keeps_flat_colours_and_own_samples():
    raw = np.zeros((16, 16))
    for c, v in zip("RGB", (1000, 800, 600)):
        raw[K.bayer_masks(raw.shape)[c]] = v
    for f in (K.debayer_bilinear, K.debayer_directional):
        rgb = f(raw)[2:-2, 2:-2]
        assert np.allclose(rgb, [1000, 800, 600], atol=1e-6), f.__name__
    grey = K.debayer_gradient(np.full((16, 16), 500.0))
    assert np.allclose(grey, 500)


def test_denoisers_lower_noise_and_keep_the_level():
    rng = np.random.default_rng(2)
    clean = np.add.outer(np.linspace(0, 40, 32), np.linspace(0, 40, 32)) + 200
    noisy = clean + rng.normal(0, 8, clean.shape)
    before = np.sqrt(((noisy - clean) ** 2).mean())
    for out in (K.denoise_starlet(noisy), K.denoise_bayes_shrink(noisy, 3), K.bilateral(noisy, 30.0), K.non_local_means(noisy, 12.0), K.median_cascade(noisy), K.contrast_denoise(noisy), collaborative.block_match(noisy, 8.0), K.diffuse(noisy, 10, 40.0)):
        assert np.sqrt(((out - clean) ** 2).mean()) < before
        assert abs(out.mean() - clean.mean()) < 2


def test_hot_pixels_cosmics_and_trails():
    a, _ = field()
    hot = a.copy()
    hot[30, 31] += 3000
    assert abs(K.fix_hot_pixels(hot, 12.0)[30, 31] - a[30, 31]) < 300
    mosaic = hot.copy()
    assert K.fix_hot_bayer(mosaic, 12.0)[30, 31] < 1500
    cleaned, mask = K.reject_cosmics(hot)
    assert mask[30, 31] and cleaned[30, 31] < 1000
    flat = np.random.default_rng(3).normal(100, 2, (48, 48))
    line = flat.copy()
    for i in range(48):
        line[i, i] += 500
    filled, mask = K.fill_trails(line)
    assert mask.diagonal().mean() > 0.95 and np.abs(filled.diagonal() - 100).max() < 60
    assert not K.fill_trails(flat)[1].any()


def test_deconvolution_sharpens():
    a, _ = field(noise=0.5)
    psf = K.moffat_psf(9, 2.0, 2.5)
    pad = np.zeros(a.shape)
    pad[:9, :9] = psf
    blurred = np.fft.irfft2(np.fft.rfft2(a) * np.fft.rfft2(np.roll(pad, (-4, -4), (0, 1))), a.shape)
    before = ((blurred - a) ** 2).mean()
    assert ((K.richardson_lucy(blurred, psf, 10) - a) ** 2).mean() < before
    assert ((K.tv_deconvolve(blurred, psf, 20) - a) ** 2).mean() < before


def test_background_models():
    a, stars = field(noise=1.0)
    tilt = np.add.outer(np.linspace(0, 60, 64), np.linspace(0, 30, 64))
    for model in (K.background(a + tilt, 8), K.surface(a + tilt)):
        assert np.abs(model - tilt - 100).mean() < 8
    assert K.star_mask((64, 64), stars, 3.0).max() == 1
    mask = K.star_mask((64, 64), stars, 3.0)
    assert K.reduce_stars(a, mask).max() < a.max()


def test_detection_and_width():
    a, stars = field()
    found = K.detect_stars(a, 3.0, 8.0)
    hit = [np.hypot(*(found[:, :2] - s).T).min() < 0.6 for s in stars]
    assert np.mean(hit) > 0.9 and len(found) <= len(stars) + 1
    assert abs(K.measure_fwhm(a, found) - 2.3548 * 1.3) < 1.0
    assert K.measure_fwhm(a, np.zeros((0, 5))) == 0


def test_registration_and_warps():
    a, stars = field(noise=0.1)
    moved, cover = K.lanczos_warp(a, np.array([[1, 0, 2.4], [0, 1, -1.7], [0, 0, 1]]))
    assert not cover[0].any() and cover[10:50, 10:50].all()
    dy, dx = K.phase_shift(a, np.where(cover, moved, np.median(a)))
    assert abs(dy + 2.4) < 0.15 and abs(dx - 1.7) < 0.15
    t = np.deg2rad(3.7)
    r = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    rng = np.random.default_rng(4)
    src = rng.uniform(0, 200, (55, 2))
    dst = src @ r.T + [5, -3] + rng.normal(0, 0.1, src.shape)
    dst[40:] = rng.uniform(0, 200, (15, 2))
    m, inliers = K.rigid_ransac(src, dst)
    assert inliers[:40].all() and inliers.sum() <= 43
    assert np.allclose(m[:2, :2], r, atol=1e-2) and np.allclose(m[:2, 2], [5, -3], atol=0.5)
    assert np.allclose(K.lanczos_warp(a, np.eye(3))[0], a)


def one_by_one(src, dst, tolerance, relative, least):
    """The consensus by one fit a hypothesis."""
    def pairs(p):
        i, j = np.triu_indices(len(p), 1)
        return i, j, np.hypot(*(p[i] - p[j]).T)

    (ai, aj, ad), (bi, bj, bd) = pairs(src), pairs(dst)
    order = np.argsort(bd)
    bi, bj, bd = bi[order], bj[order], bd[order]
    best, matrix, tried = 0, np.eye(3), 0
    for i, j, d in sorted(zip(ai, aj, ad, strict=True), key=lambda t: -t[2]):
        width = max(2 * tolerance, relative * d)
        for k in range(*np.searchsorted(bd, [d - width, d + width])):
            for p, q in ((bi[k], bj[k]), (bj[k], bi[k])):
                tried += 1
                t = K.rigid_fit(src[[i, j]], dst[[p, q]])
                gap = np.hypot(*((src @ t[:2, :2].T + t[:2, 2])[:, None] - dst[None]).transpose(2, 0, 1))
                ok = gap.min(1) < tolerance
                if ok.sum() > best:
                    best, matrix = int(ok.sum()), K.rigid_fit(src[ok], dst[gap[ok].argmin(1)])
        if best >= 0.9 * min(len(src), len(dst)):
            break
    return (matrix, best, tried) if best >= least else (np.eye(3), 0, tried)


@pytest.mark.parametrize("at_once", [7, 200_000])
def test_rigid_from_pairs_counts_hypotheses_without_fitting_each(monkeypatch, at_once):
    from skyfold.functions import stars as T

    monkeypatch.setattr(T, "HYPOTHESES", at_once)
    rng, fit = np.random.default_rng(5), K.rigid_fit
    total = fits = 0
    for k in range(60):
        grid = [np.stack(np.divmod(rng.choice(64, n, replace=False), 8), 1).astype(float) for n in rng.integers(0, 11, 2)]
        if k % 3 == 0:  # a turned copy with other stars
            turned = (grid[0] @ fit(np.array([(0, 0), (1, 0)]), np.array([(2, 2), (2.8, 2.6)]))[:2, :2].T) + [3, -2]
            grid[1] = np.concatenate([turned[: len(turned) // 2 + 1], grid[1]])
        elif k % 3 == 1:  # repeated places have no direction
            grid = [np.concatenate([g, g[:2]]) for g in grid]
        matrix, best, tried = one_by_one(*grid, 0.6, 0.01, 3)
        calls = []
        monkeypatch.setattr(K, "rigid_fit", lambda a, b, calls=calls: calls.append(1) or fit(a, b))
        found, n = T.rigid_from_pairs(*grid, 0.6, 0.01, 3)
        monkeypatch.setattr(K, "rigid_fit", fit)
        assert n == best and np.array_equal(found, matrix)
        if k % 3 != 1:
            total, fits = total + tried, fits + len(calls)
    assert fits < total / 20


def test_blind_match_keeps_a_session_out_of_one_task(spark):
    from skyfold.plans import stars as P

    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    plan = P.blind_match(session, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
