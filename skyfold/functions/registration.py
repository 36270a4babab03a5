"""Registration of one frame on another: subpixel correlation, a pyramid of halved frames, star-matched rigid transforms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from skyfold.functions import kernels as K
from skyfold.functions import stars as T

#: Star pairs that a transform must rest on.
LEAST_PAIRS = 6


def refined_shift(reference: np.ndarray, moving: np.ndarray, upsample: int = 20) -> tuple[float, float]:
    """Shift (dy, dx) that brings `moving` onto `reference`, to 1/upsample of a pixel.

    The correlation's whole-pixel peak is refined on a fine grid of 1.5 pixels around it, which two small matrix products
    evaluate from the cross spectrum.
    """
    spectrum = np.fft.fft2(reference - reference.mean()) * np.conj(np.fft.fft2(moving - moving.mean()))
    c = np.fft.ifft2(spectrum).real
    peak = np.unravel_index(c.argmax(), c.shape)
    whole = [p - n if p > n // 2 else p for p, n in zip(peak, c.shape, strict=True)]
    if upsample <= 1:
        return float(whole[0]), float(whole[1])
    steps = np.arange(-np.ceil(0.75 * upsample), np.ceil(0.75 * upsample) + 1) / upsample
    ys, xs = whole[0] + steps, whole[1] + steps
    rows = np.exp(2j * np.pi * np.outer(ys, np.fft.fftfreq(c.shape[0])))
    columns = np.exp(2j * np.pi * np.outer(np.fft.fftfreq(c.shape[1]), xs))
    fine = (rows @ spectrum @ columns).real
    i, j = np.unravel_index(fine.argmax(), fine.shape)
    return float(ys[i]), float(xs[j])


def halve(a: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 blocks; an odd last line or column is left out."""
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    return a[:h, :w].reshape(h // 2, 2, w // 2, 2).mean((1, 3))


def pyramid_shift(reference: np.ndarray, moving: np.ndarray, levels: int = 4, least: int = 32, finest: int = 1) -> tuple[float, float]:
    """Shift found on the smallest of the halved frames and corrected at each finer size.

    Frames are halved up to `levels` - 1 times while their sides stay at `least` or more. `finest` is the level at which the
    search ends (0: full size, 1: half size).
    """
    stack = [(reference, moving)]
    while len(stack) < levels and min(stack[-1][0].shape) // 2 >= least:
        stack.append((halve(stack[-1][0]), halve(stack[-1][1])))
    dy = dx = 0.0
    last = min(finest, len(stack) - 1)
    for level in range(len(stack) - 1, last - 1, -1):
        r, m = stack[level]
        near = (round(dy), round(dx))
        ey, ex = refined_shift(r, np.roll(m, near, (0, 1)))
        dy, dx = near[0] + ey, near[1] + ex
        if level > last:
            dy, dx = 2 * dy, 2 * dx
    return dy * 2**last, dx * 2**last


def masked_shift(reference: np.ndarray, moving: np.ndarray, reference_valid: np.ndarray, moving_valid: np.ndarray, overlap: float = 0.3) -> tuple[float, float, float]:
    """Shift (dy, dx) that brings `moving` onto `reference`, and its correlation, from the valid samples of both alone.

    For every shift the correlation coefficient is taken over the samples that are valid in both, by transforms; shifts whose
    common samples are fewer than `overlap` of the most that any shift has are out. A parabola through the peak refines it.
    """
    shape = [a + b - 1 for a, b in zip(reference.shape, moving.shape, strict=True)]
    level = lambda a, m: np.where(m, a - a[m].mean(), 0.0) if m.any() else np.zeros(a.shape)
    r, m = level(reference.astype(float), reference_valid), level(moving.astype(float), moving_valid)
    f = lambda a: np.fft.rfft2(a, shape)
    over = lambda a, b: np.fft.irfft2(a * np.conj(b), shape)
    fr, fm, fr2, fm2, vr, vm = f(r), f(m), f(r * r), f(m * m), f(reference_valid.astype(float)), f(moving_valid.astype(float))
    n = np.maximum(np.rint(over(vr, vm)), 0)
    safe = np.maximum(n, 1)
    sr, sm = over(fr, vm), over(vr, fm)
    spread = np.maximum(over(fr2, vm) - sr * sr / safe, 0) * np.maximum(over(vr, fm2) - sm * sm / safe, 0)
    good = (n >= max(overlap * n.max(), 2)) & (spread > 1e-12 * max(spread.max(), 1e-30))
    c = np.where(good, (over(fr, fm) - sr * sm / safe) / np.sqrt(np.where(good, spread, 1.0)), -1.0)
    peak = np.unravel_index(c.argmax(), c.shape)
    out = []
    for axis, p in enumerate(peak):
        line = np.take(c, peak[1 - axis], 1 - axis)
        size = len(line)
        a, b, d = line[(p - 1) % size], line[p], line[(p + 1) % size]
        bend = a - 2 * b + d
        sub = 0.5 * (a - d) / bend if bend < -1e-12 and min(a, d) > -1 else 0.0
        out.append((p if p < reference.shape[axis] else p - size) + sub)
    return float(out[0]), float(out[1]), float(c[peak])


def clear_samples(a: np.ndarray, cell: int = 16, limit: float = 4.0) -> np.ndarray:
    """Where the sky lies near the frame's own level: cells whose median is `limit` times the usual scatter of cells off it are not clear."""
    h, w = a.shape
    ny, nx = max(1, h // cell), max(1, w // cell)
    grid = np.array([[np.median(a[i * h // ny : (i + 1) * h // ny, j * w // nx : (j + 1) * w // nx]) for j in range(nx)] for i in range(ny)])
    low = np.percentile(grid, 25)  # clouds shine; the darker cells are the sky
    own = grid[grid <= np.median(grid)]
    ok = grid <= low + limit * max(K.mad_sigma(own), K.neighbour_noise(a) / 2, 1e-9)  # less than that is a star, not a cloud
    y, x = np.minimum(np.arange(h) * ny // h, ny - 1), np.minimum(np.arange(w) * nx // w, nx - 1)
    return ok[np.ix_(y, x)]


def mutual_pairs(src: np.ndarray, dst: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of points that are each other's nearest within the radius."""
    if not len(src) or not len(dst):
        return np.array([], int), np.array([], int)
    gap = np.hypot(src[:, None, 0] - dst[None, :, 0], src[:, None, 1] - dst[None, :, 1])
    to, back = gap.argmin(1), gap.argmin(0)
    i = np.arange(len(src))
    i = i[(back[to] == i) & (gap[i, to] <= radius)]
    return i, to[i]


@dataclass(frozen=True)
class Fit:
    """Rotation and displacement of the frame's centre, how they were found, the pairs behind them and their scatter."""

    dy: float
    dx: float
    angle: float = 0.0
    method: str = "shift"
    matched: int = 0
    residual: float | None = None
    #: Places of the agreeing stars on the reference, and where the rigid transform brings the frame's.
    places: np.ndarray | None = None
    brought: np.ndarray | None = None


def matrix(shape: tuple[int, int], dy: float, dx: float, angle: float) -> np.ndarray:
    """3x3 transform over (y, x) that turns a frame about its centre and moves the centre by (dy, dx)."""
    centre = (np.array(shape) - 1) / 2
    c, s = np.cos(angle), np.sin(angle)
    out = np.eye(3)
    out[:2, :2] = [[c, -s], [s, c]]
    out[:2, 2] = centre + [dy, dx] - out[:2, :2] @ centre
    return out


def _from_matrix(shape: tuple[int, int], t: np.ndarray) -> tuple[float, float, float]:
    centre = (np.array(shape) - 1) / 2
    dy, dx = t[:2, :2] @ centre + t[:2, 2] - centre
    return float(dy), float(dx), float(np.arctan2(t[1, 0], t[0, 0]))


def _settle(shape: tuple[int, int], src: np.ndarray, dst: np.ndarray, start: np.ndarray, radius: float, method: str) -> Fit | None:
    """Consensus over the pairs that a first transform brings together; none where fewer than half of them agree."""
    moved = src @ start[:2, :2].T + start[:2, 2]
    i, j = mutual_pairs(moved, dst, radius)
    if len(i) < LEAST_PAIRS:
        return None
    t, inliers = K.rigid_ransac(src[i], dst[j])
    n = int(inliers.sum())
    if n < max(LEAST_PAIRS, len(i) / 2):
        return None
    places, brought = dst[j][inliers], src[i][inliers] @ t[:2, :2].T + t[:2, 2]
    return Fit(*_from_matrix(shape, t), method, n, float(np.sqrt(((brought - places) ** 2).sum(1).mean())), places, brought)


def register(reference: np.ndarray, reference_stars: np.ndarray, moving: np.ndarray, moving_stars: np.ndarray, radius: float = 6.0, most: int = 200, blind: int = 30) -> Fit:
    """Places a frame on its reference: stars near the correlation's shift, else stars by equal distances, else the shift; where
    clouds cover parts of a frame, the shift of the clear parts.

    Stars are rows (y, x, ...), brightest first; the `most` brightest decide. Frames that are turned so far that the shift
    pairs no stars are matched through the distances among the `blind` brightest.
    """
    shape = moving.shape
    dy, dx = pyramid_shift(reference, moving, finest=0)
    src, dst = moving_stars[:most, :2], reference_stars[:most, :2]
    fit = _settle(shape, src, dst, matrix(shape, dy, dx, 0.0), radius, "stars")
    if fit is None and min(len(src), len(dst)) >= LEAST_PAIRS:
        t, agreed = T.rigid_from_pairs(src[:blind], dst[:blind])
        if agreed >= LEAST_PAIRS:
            fit = _settle(shape, src, dst, t, 3.0, "distances")
    if fit is None:
        valid = clear_samples(reference), clear_samples(moving)
        if min(v.mean() for v in valid) < 0.95 and all(v.mean() > 0.1 for v in valid):  # parts of a frame are covered
            my, mx, agreement = masked_shift(reference, moving, *valid)
            if agreement > 0.3:
                return Fit(my, mx, method="masked")
    return fit or Fit(dy, dx)
