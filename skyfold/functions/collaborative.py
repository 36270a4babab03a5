"""Two-step collaborative filtering of like blocks, and the rotational gradient about a nucleus; pure numpy."""

from __future__ import annotations

import numpy as np


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II: rows are frequencies."""
    k, i = np.indices((n, n))
    m = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * (2 / n) ** 0.5
    m[0] /= 2**0.5
    return m


def hadamard(n: int) -> np.ndarray:
    """Orthonormal Walsh-Hadamard matrix of a power of two."""
    m = np.ones((1, 1))
    while len(m) < n:
        m = np.block([[m, m], [m, -m]]) / 2**0.5
    return m


def like_blocks(a: np.ndarray, ys: np.ndarray, xs: np.ndarray, block: int, search: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """(references, group) places of the blocks most like each reference (ys x xs), itself first.

    For every offset of the search window the squared differences are summed over blocks by a summed-area table, for all
    references at once; ties go to the offset that comes first.
    """
    h, w = a.shape
    offsets = [(0, 0), *((dy, dx) for dy in range(-search, search + 1) for dx in range(-search, search + 1) if dy or dx)]
    gy, gx = (g.ravel() for g in np.meshgrid(ys, xs, indexing="ij"))
    distance = np.full((len(offsets), len(gy)), np.inf, np.float32)
    top, bottom = max(0, ys.min() - search), min(h, ys.max() + block + search)
    band = a[top:bottom]
    for k, (dy, dx) in enumerate(offsets):
        y0, y1, x0, x1 = max(0, -dy), min(len(band), len(band) - dy), max(0, -dx), min(w, w - dx)
        if y1 - y0 < block or x1 - x0 < block:
            continue
        d = (band[y0:y1, x0:x1] - band[y0 + dy : y1 + dy, x0 + dx : x1 + dx]) ** 2
        table = np.zeros((d.shape[0] + 1, d.shape[1] + 1))
        np.cumsum(np.cumsum(d, 0), 1, out=table[1:, 1:])
        sums = table[block:, block:] - table[:-block, block:] - table[block:, :-block] + table[:-block, :-block]
        iy, ix = gy - top - y0, gx - x0
        ok = (iy >= 0) & (iy < sums.shape[0]) & (ix >= 0) & (ix < sums.shape[1])
        distance[k, ok] = np.maximum(sums[iy[ok], ix[ok]], 0)
    distance[0] = -1  # the reference itself
    size = 1 << (min(group, int(np.isfinite(distance).sum(0).min())).bit_length() - 1)
    best = np.argsort(distance, axis=0, kind="stable")[:size].T
    table = np.array(offsets)
    return gy[:, None] + table[best, 0], gx[:, None] + table[best, 1]


def _pass(a: np.ndarray, guide: np.ndarray, sigma: float, block: int, group: int, search: int, step: int, wiener: bool, limit: float) -> np.ndarray:
    h, w = a.shape
    total, weights = np.zeros(h * w), np.zeros(h * w)
    rows = sorted({*range(0, h - block + 1, step), h - block})
    xs = np.array(sorted({*range(0, w - block + 1, step), w - block}))
    d = dct_matrix(block)
    inner = np.arange(block)
    each = max(1, 60_000 // (len(xs) * group))  # lines of references whose groups are held at once
    for k in range(0, len(rows), each):
        py, px = like_blocks(guide, np.array(rows[k : k + each]), xs, block, search, group)
        at = (py[..., None, None] + inner[:, None]) * w + px[..., None, None] + inner
        g = hadamard(py.shape[1])
        forward = lambda v: np.einsum("kg,rgij->rkij", g, d @ v @ d.T)  # noqa: B023, E731
        spectrum = forward(a.ravel()[at])
        if wiener:
            power = forward(guide.ravel()[at]) ** 2
            shrink = power / (power + sigma**2)
            shrink[:, 0, 0, 0] = 1  # the group's level
            weight = 1 / np.maximum((shrink**2).sum((1, 2, 3)), 1e-9)
            spectrum *= shrink
        else:
            kept = np.abs(spectrum) >= limit * sigma
            kept[:, 0, 0, 0] = True
            weight = 1 / kept.sum((1, 2, 3))
            spectrum *= kept
        clean = d.T @ np.einsum("kg,rkij->rgij", g, spectrum) @ d
        wide = np.broadcast_to(weight[:, None, None, None], clean.shape)
        total += np.bincount(at.ravel(), (clean * wide).ravel(), h * w)
        weights += np.bincount(at.ravel(), wide.ravel(), h * w)
    return (total / np.maximum(weights, 1e-12)).reshape(h, w)


def block_match(a: np.ndarray, sigma: float, block: int = 8, group: int = 16, search: int = 8, step: int = 3, limit: float = 2.7) -> np.ndarray:
    """Denoises by groups of like blocks: hard thresholds of their joint transform (DCT in the block, Hadamard along the group)
    give a first estimate, which guides the groups and the Wiener gains of the second step."""
    a = a.astype(float)
    block = min(block, *a.shape)
    if sigma <= 0 or block < 2:
        return a
    first = _pass(a, a, sigma, block, group, search, step, False, limit)
    return _pass(a, first, sigma, block, group, search, step, True, limit)


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples; places outside take the edge."""
    y, x = np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)
    iy, ix = np.minimum(y.astype(int), max(a.shape[0] - 2, 0)), np.minimum(x.astype(int), max(a.shape[1] - 2, 0))
    jy, jx = np.minimum(iy + 1, a.shape[0] - 1), np.minimum(ix + 1, a.shape[1] - 1)
    fy, fx = y - iy, x - ix
    return (1 - fy) * ((1 - fx) * a[iy, ix] + fx * a[iy, jx]) + fy * ((1 - fx) * a[jy, ix] + fx * a[jy, jx])


def rotational_gradient(a: np.ndarray, y: float, x: float, shift: float = 1.0, degrees: float = 15.0) -> np.ndarray:
    """Twice the frame less itself turned by both signs of an angle about a nucleus and moved inwards by `shift`: what is round
    about the nucleus vanishes, jets stay."""
    gy, gx = np.indices(a.shape).astype(float)
    dy, dx = gy - y, gx - x
    r = np.hypot(dy, dx)
    near = np.maximum(r - shift, 0)
    share = np.where(r > 0, near / np.maximum(r, 1e-12), 0)
    out = 2 * a.astype(float)
    for turn in (np.deg2rad(degrees), -np.deg2rad(degrees)):
        c, s = np.cos(turn), np.sin(turn)
        out -= sample(a, y + share * (dy * c - dx * s), x + share * (dy * s + dx * c))
    return out
