"""Star detection over a local noise map.

Sky and noise are clipped medians and deviations of a mesh, interpolated to every sample. A zero-sum Gaussian of the stars' own
width is matched to the frame less its sky, in strips of lines with a halo, so that memory does not grow with the frame; a star
belongs to the strip that its peak lies in, and strips of any height give the same stars. Peaks over `k` local deviations are
kept if enough samples around them rise over the noise (hot pixels have one) and their moments are round enough (trails are not).
"""

from __future__ import annotations

import numpy as np

from skyfold.functions import kernels as K
from skyfold.functions.restore import upsample

#: Columns of a detection.
COLUMNS = ("y", "x", "flux", "peak", "roundness", "snr", "samples")


def mesh(a: np.ndarray, cell: int = 64, sigma: float = 3.0, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Grids of sky and noise; a cell's samples beyond `sigma` deviations of its median are left out step by step."""
    h, w = a.shape
    ny, nx = max(1, h // cell), max(1, w // cell)
    sky, noise = np.zeros((ny, nx)), np.zeros((ny, nx))
    for i in range(ny):
        for j in range(nx):
            v = np.sort(a[i * h // ny : (i + 1) * h // ny, j * w // nx : (j + 1) * w // nx], axis=None)
            lo, hi = 0, len(v)
            for _ in range(rounds):
                own = v[lo:hi]
                m = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
                s = max(K.mad_sigma(own), 1e-9)
                first, last = lo + int(np.searchsorted(own, m - sigma * s)), lo + int(np.searchsorted(own, m + sigma * s, "right"))
                if (first, last) == (lo, hi) or first >= last:
                    break
                lo, hi = first, last
            sky[i, j], noise[i, j] = np.median(v[lo:hi]), max(K.mad_sigma(v[lo:hi]), 1e-6)
    if min(ny, nx) >= 3:  # a cell under a bright star follows its neighbours
        sky, noise = K.median_filter(sky, 1), K.median_filter(noise, 1)
    return sky, noise


def _kernel(fwhm: float) -> np.ndarray:
    s = fwhm / 2.3548
    r = max(1, int(round(2 * s)))
    y, x = np.indices((2 * r + 1,) * 2) - r
    k = np.exp(-(y * y + x * x) / (2 * s * s))
    k -= k.mean()
    return k / np.sqrt((k**2).sum())


def _matched(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation of a padded array, without windows: one pass a kernel sample."""
    r = kernel.shape[0] // 2
    h, w = a.shape[0] - 2 * r, a.shape[1] - 2 * r
    out = np.zeros((h, w))
    for i in range(2 * r + 1):
        for j in range(2 * r + 1):
            out += kernel[i, j] * a[i : i + h, j : j + w]
    return out


def width(a: np.ndarray, k: float = 8.0, start: float = 3.0, low: float = 1.5, high: float = 10.0) -> float:
    """The stars' width at half maximum as the frame itself shows it; `start` where it shows none."""
    found = detect(a, start, max(k, 8.0))
    bright = found[: min(len(found), 60)]
    measured = K.measure_fwhm(a, bright, radius=int(np.ceil(high / 2)) + 2, most=60) if len(bright) >= 3 else 0.0
    return float(np.clip(measured, low, high)) if measured else start


def detect(a: np.ndarray, fwhm: float | None = 2.5, k: float = 5.0, border: int = 2, cell: int = 64, strip: int = 512, least_samples: int = 3, roundest: float = 0.6) -> np.ndarray:
    """Rows of `COLUMNS`, brightest first; without `fwhm` the frame's own width is measured first."""
    a = np.asarray(a, float)
    if fwhm is None:
        fwhm = width(a, k)
    h, w = a.shape
    sky, noise = (upsample(g, (h, w)) for g in mesh(a, cell))
    kernel = _kernel(fwhm)
    r = kernel.shape[0] // 2
    reach = max(1, int(round(fwhm / 2)))  # of two peaks nearer than this the higher one stays
    halo = r + reach
    core = max(2, int(round(fwhm)))
    rest = np.pad(a - sky, halo, mode="symmetric")
    out = []
    for top in range(0, h, strip):
        n = min(strip, h - top)
        # lines top - reach to top + n + reach of the significance
        snr = _matched(rest[top : top + n + 2 * halo], kernel)
        inside = np.pad(noise, ((reach, reach), (reach, reach)), mode="edge")[top : top + n + 2 * reach]
        snr = snr / inside
        own = snr[reach : reach + n, reach : reach + w]
        peak = own > k
        for i in range(-reach, reach + 1):
            for j in range(-reach, reach + 1):
                if i or j:
                    other = snr[reach + i : reach + i + n, reach + j : reach + j + w]
                    peak &= (own > other) if (i, j) < (0, 0) else (own >= other)
        ys, xs = np.nonzero(peak)
        out.append(np.column_stack([ys + top, xs, own[ys, xs]]))
    found = np.concatenate(out) if out else np.zeros((0, 3))
    y, x = found[:, 0].astype(int), found[:, 1].astype(int)
    keep = (y >= border) & (y < h - border) & (x >= border) & (x < w - border)
    y, x, snr = y[keep], x[keep], found[keep, 2]
    padded = np.pad(a - sky, core, mode="constant")
    gy, gx = np.indices((2 * core + 1,) * 2) - core
    cuts = padded[(y[:, None, None] + core + gy), (x[:, None, None] + core + gx)] if len(y) else np.zeros((0, *gy.shape))
    high = cuts > 2 * noise[y, x][:, None, None]
    samples = (high & (gy**2 + gx**2 <= core**2)).sum((1, 2))
    light = np.where(gy**2 + gx**2 <= core**2, np.maximum(cuts, 0), 0)
    total = light.sum((1, 2))
    safe = np.maximum(total, 1e-12)
    my, mx = (light * gy).sum((1, 2)) / safe, (light * gx).sum((1, 2)) / safe
    dy, dx = gy - my[:, None, None], gx - mx[:, None, None]
    vy, vx, vc = ((light * p).sum((1, 2)) / safe for p in (dy * dy, dx * dx, dy * dx))
    roundness = np.sqrt((vy - vx) ** 2 + 4 * vc**2) / np.maximum(vy + vx, 1e-9)  # 0: round, 1: a line
    good = (total > 0) & (samples >= least_samples) & (roundness <= roundest)
    rows = np.column_stack([y + my, x + mx, total, a[y, x], roundness, snr, samples])[good] if len(y) else np.zeros((0, 7))
    return rows[np.lexsort((rows[:, 1], rows[:, 0], -rows[:, 2]))]
