"""Tangent planes: one flat panel of the sky on another's grid, weights that fall towards a panel's edges, offsets of a graph.

A solution is (ra, dec, px, py, c11, c12, c21, c22): the direction in degrees that pixel (px, py), counted from 0, points at, and
the matrix from pixels (x, y) to degrees east and north on the plane that touches the sphere there.
"""

from __future__ import annotations

import numpy as np


def basis(ra: float, dec: float) -> np.ndarray:
    """Rows: unit vectors east, north and outwards at a direction in degrees."""
    a, d = np.radians([ra, dec])
    sa, ca, sd, cd = np.sin(a), np.cos(a), np.sin(d), np.cos(d)
    return np.array([[-sa, ca, 0.0], [-sd * ca, -sd * sa, cd], [cd * ca, cd * sa, sd]])


def _plane(solution: np.ndarray) -> np.ndarray:
    """3x3 matrix from pixels (x, y, 1) to the plane (east, north, 1) in radians."""
    _, _, px, py, c11, c12, c21, c22 = solution
    c = np.radians([[c11, c12], [c21, c22]])
    out = np.eye(3)
    out[:2, :2] = c
    out[:2, 2] = -c @ [px, py]
    return out


def between(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """3x3 matrix from homogeneous pixels (x, y, 1) of `target` to those of `source`.

    Both planes are seen from the sphere's centre, so straight lines stay straight and a whole reprojection is one matrix; a
    third coordinate that is not positive lies behind the observer.
    """
    return np.linalg.inv(_plane(source)) @ basis(*source[:2]) @ basis(*target[:2]).T @ _plane(target)


def mapped(matrix: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places under a homogeneous matrix; not a number behind the observer."""
    a, b, c = (m[0] * x + m[1] * y + m[2] for m in matrix)
    c = np.where(c > 1e-9, c, np.nan)
    return a / c, b / c


def feather(valid: np.ndarray) -> np.ndarray:
    """Distance of each valid sample to the nearest that is not, over the largest; beyond the frame nothing is valid.

    Steps along lines count 1 and diagonal ones the root of 2, in two sweeps over the lines.
    """
    h, w = valid.shape
    d = np.where(np.pad(valid, 1), np.inf, 0.0)
    column = np.arange(w + 2)
    for lines, back in ((range(1, h + 2), -1), (range(h, -1, -1), 1)):
        for i in lines:
            before = d[i + back]
            line = np.minimum(d[i], before + 1)
            line[1:] = np.minimum(line[1:], before[:-1] + np.sqrt(2))
            line[:-1] = np.minimum(line[:-1], before[1:] + np.sqrt(2))
            line = np.minimum.accumulate(line - column) + column
            d[i] = (np.minimum.accumulate((line + column)[::-1]))[::-1] - column
    d = d[1:-1, 1:-1]
    top = d.max(initial=0.0)
    return d / top if top > 0 else d


def border_sky(a: np.ndarray, share: float = 0.05, sigma: float = 3.0) -> float:
    """Clipped median of the positive samples near a panel's border; 0 where there are none."""
    h, w = a.shape
    rim = np.ones(a.shape, bool)
    by, bx = max(5, int(h * share)), max(5, int(w * share))
    rim[by : h - by, bx : w - bx] = False
    v = a[rim]
    v = v[np.isfinite(v) & (v > 0)]
    if not v.size:
        return 0.0
    middle = np.median(v)
    near = v[np.abs(v - middle) < sigma * v.std()]
    return float(np.median(near)) if near.size else float(middle)


def bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples at places between pixels; not a number outside or beside a missing sample that counts."""
    h, w = a.shape
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    x, y = np.where(inside, x, 0.0), np.where(inside, y, 0.0)
    ix, iy = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - ix, y - iy
    out = np.zeros(x.shape)
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            k = wy * wx
            out += np.where(k > 0, k * a[np.minimum(iy + dy, h - 1), np.minimum(ix + dx, w - 1)], 0.0)
    return np.where(inside, out, np.nan)


def reproject(a: np.ndarray, solution: np.ndarray, grid: np.ndarray, shape: tuple[int, int], size: int, level: bool = True):
    """Yields (y0, x0, values, weights) of the grid's tiles that a panel reaches; values that it does not cover are not numbers.

    Zero and non-finite samples are not covered. With `level` the panel's own border sky is taken off.
    """
    valid = np.isfinite(a) & (a != 0)
    own, soft = np.where(valid, a - (border_sky(a) if level else 0.0), np.nan), feather(valid)
    to_panel = between(solution, grid)
    h, w = a.shape
    # a panel's outline is straight on the grid, so its corners bound it
    cx, cy = mapped(np.linalg.inv(to_panel), np.array([0.0, w - 1, 0, w - 1]), np.array([0.0, 0, h - 1, h - 1]))
    if not np.isfinite(cx).all():
        raise ValueError("a panel reaches beyond the plane of its mosaic")
    left, right = max(int(np.floor(cx.min())), 0), min(int(np.ceil(cx.max())), shape[1] - 1)
    low, high = max(int(np.floor(cy.min())), 0), min(int(np.ceil(cy.max())), shape[0] - 1)
    for y0 in range(low // size * size, high + 1, size):
        for x0 in range(left // size * size, right + 1, size):
            gy, gx = np.mgrid[y0 : min(y0 + size, shape[0]), x0 : min(x0 + size, shape[1])].astype(float)
            x, y = mapped(to_panel, gx, gy)
            v = bilinear(own, x, y)
            seen = np.isfinite(v)
            if seen.any():
                yield y0, x0, v, np.where(seen, np.maximum(bilinear(soft, x, y), 1e-6), 0.0)


def graph_offsets(a: np.ndarray, b: np.ndarray, n: np.ndarray, difference: np.ndarray, count: int) -> np.ndarray:
    """Offsets o of `count` nodes that minimise the sum of n (o[a] + difference - o[b])², of mean 0 in each connected part.

    Conjugate gradients on the graph's Laplacian from zero, which keeps to the least offsets.
    """
    n = n.astype(float)

    def laplacian(o: np.ndarray) -> np.ndarray:
        flow = n * (o[a] - o[b])
        return np.bincount(a, flow, count) - np.bincount(b, flow, count)

    r = np.bincount(b, n * difference, count) - np.bincount(a, n * difference, count)
    o, p, rest = np.zeros(count), r.copy(), r @ r
    limit = 1e-24 * max(rest, 1e-300)
    for _ in range(4 * count + 20):
        if rest <= limit:
            break
        q = laplacian(p)
        step = rest / max(p @ q, 1e-300)
        o, r = o + step * p, r - step * q
        rest, last = r @ r, rest
        p = r + rest / last * p
    return o
