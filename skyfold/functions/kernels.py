"""Array kernels of the neighbourhood operators: pure numpy functions of one frame (height, width[, channels]).

They run inside Arrow batches of frames (operators.image_ops); nothing here knows of Spark.
"""

from __future__ import annotations

import functools

import numpy as np

MAD_SCALE = 1.4826


def mad_sigma(a: np.ndarray) -> float:
    m = np.median(a)
    s = MAD_SCALE * float(np.median(np.abs(a - m)))
    return s if s > 1e-12 else float(a.std())


def _reflected(n: int, radius: int) -> np.ndarray:
    """Places of a line's samples and of `radius` more at either end, edges reflected."""
    at = np.arange(-radius, n + radius) % (2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def windows(a: np.ndarray, radius: int) -> np.ndarray:
    """(h, w, k, k) views of the neighbourhoods, edges reflected."""
    k = 2 * radius + 1
    padded = a
    for axis, n in enumerate(a.shape):
        padded = np.take(padded, _reflected(n, radius), axis)
    return np.lib.stride_tricks.sliding_window_view(padded, (k, k))


def median_filter(a: np.ndarray, radius: int = 1) -> np.ndarray:
    return np.median(windows(a, radius), axis=(2, 3))


def convolve(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = kernel.shape[0] // 2
    return np.einsum("ijkl,kl->ij", windows(a, r), kernel[::-1, ::-1])


#: Samples times taps up to which a Gaussian's shifted copies are taken in one piece.
AT_ONCE = 1 << 17


@functools.lru_cache(maxsize=16)
def _taps(sigma: float) -> np.ndarray:
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


@functools.lru_cache(maxsize=16)
def _mirrored(n: int, taps: int) -> np.ndarray:
    """(taps, n): which of a line's samples each tap takes, edges reflected."""
    return _reflected(n, taps // 2)[np.arange(taps)[:, None] + np.arange(n)]


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, four deviations wide, edges reflected. Taps are added in order, in either form."""
    a = a.astype(float)
    if sigma <= 0:
        return a
    k = _taps(sigma)
    for axis in (0, 1):
        n = a.shape[axis]
        if a.size > 1 and a.size * len(k) <= AT_ONCE:
            line = a if axis == 0 else a.T
            a = np.add.reduce(line[_mirrored(n, len(k))] * k[:, None, None], axis=0, initial=0.0)
            a = a if axis == 0 else np.ascontiguousarray(a.T)
            continue
        pad = [(0, 0), (0, 0)]
        pad[axis] = (len(k) // 2, len(k) // 2)
        p = np.pad(a, pad, mode="symmetric")
        a = sum(w * (p[i : i + n] if axis == 0 else p[:, i : i + n]) for i, w in enumerate(k))
    return a


def laplacian(a: np.ndarray) -> np.ndarray:
    return convolve(a, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float))


def bayer_masks(shape: tuple[int, int], pattern: str = "RGGB") -> dict[str, np.ndarray]:
    y, x = np.indices(shape)
    phase = (y % 2) * 2 + x % 2
    return {c: np.isin(phase, [i for i, p in enumerate(pattern) if p == c]) for c in "RGB"}


_BILINEAR = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]], float) / 4


def _filter_weights(shape: tuple[int, int], pattern: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each channel's mask and the weight of its own filter around every sample."""
    return [(mask, np.maximum(convolve(mask.astype(float), _BILINEAR), 1e-12)) for mask in bayer_masks(shape, pattern).values()]


_kept_weights = functools.lru_cache(maxsize=4)(_filter_weights)


def debayer_bilinear(raw: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """Each channel is the mean of its own filter's neighbours."""
    out = []
    for mask, weight in (_kept_weights if raw.size <= 1 << 14 else _filter_weights)(raw.shape, pattern):
        out.append(np.where(mask, raw, convolve(raw * mask, _BILINEAR) / weight))
    return np.stack(out, -1)


#: The published 5x5 kernels of gradient-corrected interpolation, in eighths. Rows are lines of the mosaic.
GRADIENT_KERNELS = {
    # green where the filter is red or blue
    "green": [[0, 0, -1, 0, 0], [0, 0, 2, 0, 0], [-1, 2, 4, 2, -1], [0, 0, 2, 0, 0], [0, 0, -1, 0, 0]],
    # a colour at green whose own filters stand left and right, then above and below
    "beside": [[0, 0, 0.5, 0, 0], [0, -1, 0, -1, 0], [-1, 4, 5, 4, -1], [0, -1, 0, -1, 0], [0, 0, 0.5, 0, 0]],
    "above": [[0, 0, -1, 0, 0], [0, -1, 4, -1, 0], [0.5, 0, 5, 0, 0.5], [0, -1, 4, -1, 0], [0, 0, -1, 0, 0]],
    # red where the filter is blue, and the other way round
    "across": [[0, 0, -1.5, 0, 0], [0, 2, 0, 2, 0], [-1.5, 0, 6, 0, -1.5], [0, 2, 0, 2, 0], [0, 0, -1.5, 0, 0]],
}


def debayer_gradient(raw: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """Gradient-corrected linear interpolation with the four 5x5 kernels; edges are mirrored at the outer samples."""
    masks = bayer_masks(raw.shape, pattern)
    p = np.pad(raw.astype(float), 2, mode="reflect")
    h, w = raw.shape
    found = {}
    for name, kernel in GRADIENT_KERNELS.items():
        found[name] = sum(k / 8 * p[i : i + h, j : j + w] for i, row in enumerate(kernel) for j, k in enumerate(row) if k)
    out = []
    for c, other in (("R", "B"), ("G", None), ("B", "R")):
        if other is None:
            out.append(np.where(masks["G"], raw, found["green"]))
            continue
        lines = masks[c].any(axis=1, keepdims=True)  # lines of the mosaic that have this colour's filters
        at_green = np.where(lines, found["beside"], found["above"])
        out.append(np.where(masks[c], raw, np.where(masks[other], found["across"], at_green)))
    return np.stack(out, -1)


def debayer_directional(raw: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """Green along the direction of the smaller gradient, colours from the smooth colour differences."""
    masks = bayer_masks(raw.shape, pattern)
    p = np.pad(raw.astype(float), 2, mode="reflect")
    c = p[2:-2, 2:-2]
    h = 0.5 * (p[2:-2, 1:-3] + p[2:-2, 3:-1]) + 0.25 * (2 * c - p[2:-2, :-4] - p[2:-2, 4:])
    v = 0.5 * (p[1:-3, 2:-2] + p[3:-1, 2:-2]) + 0.25 * (2 * c - p[:-4, 2:-2] - p[4:, 2:-2])
    dh = gaussian(np.abs(p[2:-2, 4:] - c) + np.abs(p[2:-2, :-4] - c), 1.0)
    dv = gaussian(np.abs(p[4:, 2:-2] - c) + np.abs(p[:-4, 2:-2] - c), 1.0)
    green = np.where(masks["G"], raw, np.where(dh <= dv, h, v))
    out = [None, green, None]
    kernel = np.array([[1, 2, 1], [2, 4, 2], [1, 2, 1]], float) / 4
    for i, n in ((0, "R"), (2, "B")):
        difference = convolve((raw - green) * masks[n], kernel) / np.maximum(convolve(masks[n].astype(float), kernel), 1e-12)
        out[i] = np.where(masks[n], raw, green + difference)
    return np.maximum(np.stack(out, -1), 0)


def spread_about_zero(d: np.ndarray, fallback: bool = True) -> float:
    """Scaled median of the magnitudes; the deviation where that vanishes, or nothing."""
    s = MAD_SCALE * float(np.median(np.abs(d)))
    return s if s >= 1e-6 else float(d.std()) if fallback else 0.0


def fix_hot_pixels(a: np.ndarray, sigma: float = 5.0) -> np.ndarray:
    """Samples `sigma` deviations over the median of their neighbours take that median."""
    m = median_filter(a, 1)
    return np.where(a - m > sigma * spread_about_zero(a - m), m, a)


def fix_hot_colour(rgb: np.ndarray, sigma: float = 12.0) -> np.ndarray:
    """Where the luminance is hot, every channel takes the mean of its 3x3 box."""
    lum = rgb @ np.array([0.299, 0.587, 0.114])
    d = lum - median_filter(lum, 1)
    hot = d > sigma * spread_about_zero(d)
    return np.stack([np.where(hot, windows(rgb[..., c], 1).mean((2, 3)), rgb[..., c]) for c in range(rgb.shape[2])], -1)


def fix_hot_bayer(raw: np.ndarray, sigma: float = 5.0, known: np.ndarray | None = None) -> np.ndarray:
    """The same on each colour lattice of a mosaic; pixels of a known map take the median first."""
    out = raw.astype(float).copy()
    for dy in (0, 1):
        for dx in (0, 1):
            own = out[dy::2, dx::2]
            m = median_filter(own, 1)
            if known is not None:
                own = np.where(known[dy::2, dx::2], m, own)
            s = spread_about_zero(own - m, False)
            out[dy::2, dx::2] = np.where((own - m > sigma * s) & (s > 0), m, own)
    return out


def reject_cosmics(a: np.ndarray, sigclip: float = 4.5, objlim: float = 5.0, gain: float = 1.0, read_noise: float = 6.5) -> tuple[np.ndarray, np.ndarray]:
    """Cosmic-ray hits by the Laplacian edge test against a noise model: cleaned frame and mask."""
    smooth = median_filter(a, 2)
    noise = np.maximum(np.sqrt(np.maximum(smooth, 0) / gain + (read_noise / gain) ** 2), 1e-6)
    edge = np.maximum(-laplacian(a), 0) / (2 * noise)  # a Laplacian doubles the noise
    mask = (edge > sigclip) & (edge / np.maximum(median_filter(edge, 1), 1e-6) > objlim)
    return np.where(mask, smooth, a), mask


def starlet(a: np.ndarray, levels: int) -> list[np.ndarray]:
    """A-trous planes from fine to coarse; their sum is the frame."""
    out, base = [], np.array([1, 4, 6, 4, 1], float) / 16
    c = a.astype(float)
    for j in range(levels):
        k = np.zeros(4 * 2**j + 1)
        k[:: 2**j] = base
        r = len(k) // 2
        s = c
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (r, r)
            p = np.pad(s, pad, mode="symmetric" if r <= s.shape[axis] else "wrap")
            s = sum(w * np.take(p, range(i, i + s.shape[axis]), axis) for i, w in enumerate(k) if w)
        out.append(c - s)
        c = s
    return [*out, c]


def denoise_starlet(a: np.ndarray, levels: int = 3, k: float = 3.0) -> np.ndarray:
    """Soft thresholds on the fine planes."""
    *planes, rest = starlet(a, levels)
    return rest + sum(np.sign(p) * np.maximum(np.abs(p) - k * mad_sigma(p) / (j + 1), 0) for j, p in enumerate(planes))


def haar2(a: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One level of the orthogonal two-dimensional Haar transform of an even-sized frame."""
    lo, hi = (a[0::2] + a[1::2]) / 2**0.5, (a[0::2] - a[1::2]) / 2**0.5
    split = lambda b: ((b[:, 0::2] + b[:, 1::2]) / 2**0.5, (b[:, 0::2] - b[:, 1::2]) / 2**0.5)
    (ll, lh), (hl, hh) = split(lo), split(hi)
    return ll, (lh, hl, hh)


def unhaar2(ll: np.ndarray, details: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    lh, hl, hh = details

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((a.shape[0], 2 * a.shape[1]))
        out[:, 0::2], out[:, 1::2] = (a + b) / 2**0.5, (a - b) / 2**0.5
        return out

    lo, hi = join(ll, lh), join(hl, hh)
    out = np.empty((2 * lo.shape[0], lo.shape[1]))
    out[0::2], out[1::2] = (lo + hi) / 2**0.5, (lo - hi) / 2**0.5
    return out


def denoise_bayes_shrink(a: np.ndarray, levels: int = 2) -> np.ndarray:
    """Subband-adaptive soft thresholds: noise variance over signal deviation."""
    if levels == 0 or min(a.shape) < 2 or a.shape[0] % 2 or a.shape[1] % 2:
        return a.astype(float)
    ll, details = haar2(a.astype(float))
    noise = float(np.median(np.abs(details[2]))) / 0.6745
    out = []
    for d in details:
        signal = np.sqrt(max(float((d * d).mean()) - noise**2, 0.0))
        t = noise**2 / signal if signal > 1e-12 else float(np.abs(d).max())
        out.append(np.sign(d) * np.maximum(np.abs(d) - t, 0))
    return unhaar2(denoise_bayes_shrink(ll, levels - 1), tuple(out))


def bilateral(a: np.ndarray, sigma_color: float, sigma_space: float = 1.5, radius: int = 3) -> np.ndarray:
    w = windows(a.astype(float), radius)
    y, x = np.indices((2 * radius + 1,) * 2) - radius
    weight = np.exp(-(y * y + x * x) / (2 * sigma_space**2)) * np.exp(-((w - a[..., None, None]) ** 2) / (2 * sigma_color**2))
    return (weight * w).sum((2, 3)) / weight.sum((2, 3))


def non_local_means(a: np.ndarray, h: float, patch: int = 1, distance: int = 3) -> np.ndarray:
    total, weights = np.zeros(a.shape), np.zeros(a.shape)
    p = np.pad(a.astype(float), distance, mode="symmetric")
    box = np.ones((2 * patch + 1,) * 2) / (2 * patch + 1) ** 2
    for dy in range(-distance, distance + 1):
        for dx in range(-distance, distance + 1):
            moved = p[distance + dy : distance + dy + a.shape[0], distance + dx : distance + dx + a.shape[1]]
            w = np.exp(-np.maximum(convolve((a - moved) ** 2, box), 0) / (h * h))
            total += w * moved
            weights += w
    return total / weights


def median_cascade(a: np.ndarray, levels: int = 4, k: float = 3.0, scale: float = 1.0) -> np.ndarray:
    """Multiscale medians (3, 5, 9, 17 wide): the finest layer gives the noise, each layer a soft threshold that falls with the
    root of its level; `scale` raises it for colour planes."""
    c, layers = a.astype(float), []
    for j in range(levels):
        s = median_filter(c, 2**j)
        layers.append(c - s)
        c = s
    noise = max(scale * float(np.median(np.abs(layers[0]))) / 0.6745, 1e-12)
    return c + sum(np.sign(d) * np.maximum(np.abs(d) - k * noise / (j + 1) ** 0.5, 0) for j, d in enumerate(layers))


def neighbour_noise(a: np.ndarray) -> float:
    """Noise from differences of neighbours that both lie in (0, 80th percentile)."""
    sky = (a > 0) & (a < np.percentile(a, 80))
    d = np.concatenate([(a[:, 1:] - a[:, :-1])[sky[:, 1:] & sky[:, :-1]], (a[1:] - a[:-1])[sky[1:] & sky[:-1]]])
    return float(np.median(np.abs(d - np.median(d))) / (0.6745 * 2**0.5)) if len(d) else 0.0


def contrast_denoise(a: np.ndarray, sigma: float = 1.5, k: float = 3.0) -> np.ndarray:
    """Blends towards a Gaussian where the local contrast is within the noise."""
    noise = neighbour_noise(a)
    if noise < 1e-10:
        return a.astype(float)
    s = gaussian(a, sigma)
    w = np.exp(-0.5 * (np.abs(a - s) / max(k * noise, 1e-12)) ** 2)
    return w * s + (1 - w) * a


def diffuse(a: np.ndarray, rounds: int = 10, kappa: float = 50.0, gamma: float = 0.1, option: int = 1) -> np.ndarray:
    """Anisotropic diffusion with periodic edges."""
    a, gamma = a.astype(float), min(max(gamma, 1e-6), 0.25)
    for _ in range(rounds):
        flow = np.zeros(a.shape)
        for axis, by in ((0, 1), (0, -1), (1, 1), (1, -1)):
            d = np.roll(a, by, axis) - a
            flow += d * (np.exp(-((d / kappa) ** 2)) if option == 1 else 1 / (1 + (d / kappa) ** 2))
        a = a + gamma * flow
    return np.maximum(a, 0)


def richardson_lucy(a: np.ndarray, psf: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Multiplicative deconvolution by transforms with periodic edges."""
    k = np.zeros(a.shape)
    k[: psf.shape[0], : psf.shape[1]] = psf / psf.sum()
    k = np.roll(k, (-(psf.shape[0] // 2), -(psf.shape[1] // 2)), (0, 1))
    f = np.fft.rfft2(k)
    blur = lambda x, t: np.fft.irfft2(np.fft.rfft2(x) * t, a.shape)
    a = np.maximum(a.astype(float), 1e-9)
    out = a.copy()
    for _ in range(rounds):
        out = np.maximum(out * blur(a / np.maximum(blur(out, f), 1e-9), np.conj(f)), 0)
    return out


def tv_deconvolve(a: np.ndarray, psf: np.ndarray, rounds: int = 20, weight: float = 0.01, step: float = 0.5) -> np.ndarray:
    """Gradient descent on the data term and the total variation."""
    k = np.zeros(a.shape)
    k[: psf.shape[0], : psf.shape[1]] = psf / psf.sum()
    f = np.fft.rfft2(np.roll(k, (-(psf.shape[0] // 2), -(psf.shape[1] // 2)), (0, 1)))
    out = a.astype(float).copy()
    for _ in range(rounds):
        miss = np.fft.irfft2((np.fft.rfft2(out) * f - np.fft.rfft2(a)) * np.conj(f), a.shape)
        gy, gx = np.roll(out, -1, 0) - out, np.roll(out, -1, 1) - out
        n = np.sqrt(gy**2 + gx**2 + 1e-6)
        div = gy / n - np.roll(gy / n, 1, 0) + gx / n - np.roll(gx / n, 1, 1)
        out = np.maximum(out - step * (miss - weight * div), 0)
    return out


def moffat_psf(size: int, alpha: float, beta: float) -> np.ndarray:
    y, x = np.indices((size, size)) - size // 2
    p = (1 + (y * y + x * x) / alpha**2) ** -beta
    return p / p.sum()


def detect_stars(a: np.ndarray, fwhm: float = 2.5, k: float = 5.0, border: int = 2) -> np.ndarray:
    """Matched-filter detection: rows (y, x, flux, peak, roundness), brightest first, centroids within the core."""
    sky, sigma = float(np.median(a)), max(mad_sigma(a), 1e-6)
    s = fwhm / 2.3548
    r = max(1, int(round(1.5 * s)))
    y, x = np.indices((2 * r + 1,) * 2) - r
    kernel = np.exp(-(y * y + x * x) / (2 * s * s))
    kernel -= kernel.mean()
    kernel /= np.sqrt((kernel**2).sum())
    snr = convolve(a - sky, kernel) / sigma
    top = windows(snr, 1).max((2, 3))
    ys, xs = np.nonzero((snr >= top) & (snr > k))
    out = []
    for cy, cx in zip(ys.tolist(), xs.tolist(), strict=True):
        if not (border <= cy < a.shape[0] - border and border <= cx < a.shape[1] - border):
            continue
        rr = min(2, border)
        cut = np.maximum(a[cy - rr : cy + rr + 1, cx - rr : cx + rr + 1] - sky, 0)
        total = cut.sum()
        if total <= 0:
            continue
        gy, gx = np.indices(cut.shape) - rr
        my, mx = (gy * cut).sum() / total, (gx * cut).sum() / total
        vy, vx = (cut * (gy - my) ** 2).sum() / total, (cut * (gx - mx) ** 2).sum() / total
        out.append((cy + my, cx + mx, total, a[cy, cx], abs(vy - vx) / max(vy + vx, 1e-9)))
    return np.array(sorted(out, key=lambda t: -t[2])).reshape(-1, 5)


def measure_fwhm(a: np.ndarray, stars: np.ndarray, radius: int = 5, most: int = 20) -> float:
    """Median full width at half maximum from the area over half of each star's peak; 0 without stars."""
    found = []
    for y, x in stars[:, :2] if len(stars) else ():
        iy, ix = int(round(y)), int(round(x))
        cut = a[max(0, iy - radius) : iy + radius + 1, max(0, ix - radius) : ix + radius + 1].astype(float)
        sky = np.sort(cut, axis=None)[cut.size // 4]
        peak = cut.max() - sky
        area = int(((cut - sky) > peak / 2).sum())
        if peak > 0 and area > 0:
            found.append(2 * np.sqrt(area / np.pi))
        if len(found) == most:
            break
    return float(np.median(found)) if found else 0.0


def phase_shift(reference: np.ndarray, moving: np.ndarray) -> tuple[float, float]:
    """Shift (dy, dx) that brings `moving` onto `reference`, from the cross-correlation's peak and a parabola through it."""
    f = np.fft.rfft2(reference - reference.mean()) * np.conj(np.fft.rfft2(moving - moving.mean()))
    c = np.fft.irfft2(f, reference.shape)
    peak = np.unravel_index(c.argmax(), c.shape)
    out = []
    for axis, p in enumerate(peak):
        n = c.shape[axis]
        line = np.take(c, peak[1 - axis], 1 - axis)
        a, b, d = line[(p - 1) % n], line[p], line[(p + 1) % n]
        bend = a - 2 * b + d
        sub = 0.5 * (a - d) / bend if abs(bend) > 1e-12 else 0.0
        out.append((p - n if p > n // 2 else p) + sub)
    return out[0], out[1]


def rigid_fit(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """3x3 rotation and shift from point pairs by least squares."""
    ms, md = src.mean(0), dst.mean(0)
    u, _, vt = np.linalg.svd((dst - md).T @ (src - ms))
    r = u @ np.diag([1, np.sign(np.linalg.det(u @ vt))]) @ vt
    out = np.eye(3)
    out[:2, :2], out[:2, 2] = r, md - r @ ms
    return out


def rigid_ransac(src: np.ndarray, dst: np.ndarray, limit: float = 2.0, trials: int = 200, seed: int = 0, certainty: float = 0.9999) -> tuple[np.ndarray, np.ndarray]:
    """Rigid transform with the largest consensus, refitted on it: matrix and inlier mask.

    The trials end once a sample of inliers alone has been drawn with the given certainty, by the share that agrees so far.
    """
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    size, done, needed = min(3, len(src)), 0, trials
    while done < needed:
        i = rng.choice(len(src), size, replace=False)
        t = rigid_fit(src[i], dst[i])
        ok = np.hypot(*(src @ t[:2, :2].T + t[:2, 2] - dst).T) < limit
        done += 1
        if ok.sum() > best.sum():
            best = ok
            pure = (ok.sum() / len(src)) ** size
            needed = min(trials, done if pure >= 1 else int(np.ceil(np.log(1 - certainty) / np.log1p(-pure))))
    return (rigid_fit(src[best], dst[best]) if best.sum() >= 2 else np.eye(3)), best


def lanczos_warp(a: np.ndarray, matrix: np.ndarray, shape: tuple[int, int] | None = None, taps: int = 3, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Resamples by the inverse of a 3x3 matrix over (y, x): frame and coverage; outside is zero.

    `moved` (height, width, 2) is how far each place of the result still lies from where the matrix brings it.
    """
    h, w = shape or a.shape
    inv = np.linalg.inv(matrix)
    y, x = np.indices((h, w)).astype(float)
    if moved is not None:
        y, x = y - moved[..., 0], x - moved[..., 1]
    sy = inv[0, 0] * y + inv[0, 1] * x + inv[0, 2]
    sx = inv[1, 0] * y + inv[1, 1] * x + inv[1, 2]
    cover = (sy >= -0.5) & (sy <= a.shape[0] - 0.5) & (sx >= -0.5) & (sx <= a.shape[1] - 0.5)
    iy, ix = np.floor(sy).astype(int), np.floor(sx).astype(int)
    weight = lambda d: np.sinc(d) * np.sinc(d / taps) * (np.abs(d) < taps)
    total, norm = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(1 - taps, taps + 1):
        wy, yy = weight(sy - (iy + dy)), np.clip(iy + dy, 0, a.shape[0] - 1)
        for dx in range(1 - taps, taps + 1):
            k = wy * weight(sx - (ix + dx))
            total += k * a[yy, np.clip(ix + dx, 0, a.shape[1] - 1)]
            norm += k
    return np.where(cover, total / np.where(np.abs(norm) < 1e-9, 1, norm), 0), cover


def background(a: np.ndarray, cell: int = 4, sigma: float = 3.0) -> np.ndarray:
    """Clipped medians of a mesh, smoothed and interpolated bilinearly to the frame."""
    h, w = a.shape
    gy, gx = max(1, h // cell), max(1, w // cell)
    grid = np.zeros((gy, gx))
    for i in range(gy):
        for j in range(gx):
            v = a[i * h // gy : (i + 1) * h // gy, j * w // gx : (j + 1) * w // gx].ravel()
            for _ in range(3):
                kept = v[np.abs(v - np.median(v)) <= sigma * max(mad_sigma(v), 1e-9)]
                if len(kept) in (0, len(v)):
                    break
                v = kept
            grid[i, j] = np.median(v)
    grid = median_filter(grid, 1)
    y = np.clip((np.arange(h) + 0.5) * gy / h - 0.5, 0, gy - 1)
    x = np.clip((np.arange(w) + 0.5) * gx / w - 0.5, 0, gx - 1)
    y0, x0 = np.minimum(y.astype(int), max(gy - 2, 0)), np.minimum(x.astype(int), max(gx - 2, 0))
    y1, x1 = np.minimum(y0 + 1, gy - 1), np.minimum(x0 + 1, gx - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    return (1 - fy) * ((1 - fx) * grid[np.ix_(y0, x0)] + fx * grid[np.ix_(y0, x1)]) + fy * ((1 - fx) * grid[np.ix_(y1, x0)] + fx * grid[np.ix_(y1, x1)])


def surface(a: np.ndarray, mask: np.ndarray | None = None, rounds: int = 3) -> np.ndarray:
    """Robust second-degree surface by reweighted least squares."""
    h, w = a.shape
    y, x = np.indices((h, w))
    y, x = (y / max(1, h - 1) - 0.5).ravel(), (x / max(1, w - 1) - 0.5).ravel()
    design = np.stack([np.ones(h * w), y, x, y * y, x * x, x * y], 1)
    v = a.astype(float).ravel()
    weight = np.ones(h * w) if mask is None else (~mask).astype(float).ravel()
    fit = np.full(h * w, v.mean())
    for _ in range(rounds):
        k = np.sqrt(weight)[:, None]
        fit = design @ np.linalg.lstsq(design * k, v * k[:, 0], rcond=None)[0]
        s = max(mad_sigma((v - fit)[weight > 0]), 1e-9)
        u = np.clip((v - fit) / (4.685 * s), -1, 1)
        weight = (1 - u * u) ** 2 * (1 if mask is None else (~mask).ravel())
    return fit.reshape(h, w)


def star_mask(shape: tuple[int, int], stars: np.ndarray, fwhm: float) -> np.ndarray:
    """One at the places of all stars, falling off by their width."""
    m = np.zeros(shape)
    if len(stars):
        y, x = np.minimum(np.rint(stars[:, :2]).astype(int), np.array(shape) - 1).T
        m[y, x] = 1
    m = gaussian(m, max(fwhm, 0.5))
    return m / m.max() if m.max() > 0 else m


def reduce_stars(a: np.ndarray, mask: np.ndarray, amount: float = 0.5, sigma: float = 2.0) -> np.ndarray:
    return a * (1 - amount * mask) + gaussian(a, sigma) * amount * mask


def local_contrast(a: np.ndarray, strength: float = 0.3, scales: tuple[float, ...] = (1, 2, 4)) -> np.ndarray:
    """Unsharp masks at several scales, strongest in the mid tones."""
    top = max(float(a.max()), 1e-12)
    mid = 4 * (a / top) * (1 - a / top)
    return np.maximum(a + strength * mid * sum(a - gaussian(a, s) for s in scales) / len(scales), 0)


def fill_trails(a: np.ndarray, sigma: float = 5.0, share: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """Straight bright trails by a Hough count over the bright pixels; filled from their neighbours."""
    bright = a > np.median(a) + sigma * max(mad_sigma(a), 1e-9)
    ys, xs = np.nonzero(bright)
    mask = np.zeros(a.shape, bool)
    if len(ys) >= 3:
        angles = np.deg2rad(np.arange(0, 180, 1))
        rho = np.rint(ys[:, None] * np.sin(angles) + xs[:, None] * np.cos(angles)).astype(int)
        low = rho.min()
        votes = np.stack([np.bincount(rho[:, i] - low, minlength=rho.max() - low + 1) for i in range(len(angles))])
        i, r = np.unravel_index(votes.argmax(), votes.shape)
        if votes[i, r] >= share * max(a.shape):
            y, x = np.indices(a.shape)
            mask = np.abs(y * np.sin(angles[i]) + x * np.cos(angles[i]) - (r + low)) <= 1
            if mask.mean() > 0.3:
                mask[:] = False
    keep = (~mask).astype(float)
    fill = gaussian(a * keep, 1.5) / np.maximum(gaussian(keep, 1.5), 1e-6)
    return np.where(mask, fill, a), mask
