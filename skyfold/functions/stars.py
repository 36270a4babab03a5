"""Star-shape kernels of one frame: sharpness of peaks, dispersion, moments, photometry and field aberration."""

from __future__ import annotations

import numpy as np

from skyfold.functions import kernels as K


def cutouts(a: np.ndarray, stars: np.ndarray, radius: int, most: int = 50) -> list[np.ndarray]:
    """Square cutouts around star positions (y, x, ...) that lie fully inside, sky removed by each one's lower quartile."""
    out = []
    for y, x in stars[:most, :2] if len(stars) else ():
        iy, ix = int(round(y)), int(round(x))
        if radius <= iy < a.shape[0] - radius and radius <= ix < a.shape[1] - radius:
            cut = a[iy - radius : iy + radius + 1, ix - radius : ix + radius + 1].astype(float)
            out.append(cut - np.sort(cut, axis=None)[cut.size // 4])
    return out


def strehl(a: np.ndarray, stars: np.ndarray, fwhm: float, radius: int = 5) -> float:
    """Median of the stars' normalised peaks over that of a Gaussian of the frame's width, held to 0 to 5."""
    found = [c.max() / c.sum() for c in cutouts(a, stars, radius) if c.sum() > 0]
    if not found or fwhm <= 0:
        return 0.0
    s = fwhm / 2.3548
    y, x = np.indices((2 * radius + 1,) * 2) - radius
    g = np.exp(-(y * y + x * x) / (2 * s * s))
    return float(np.clip(np.median(found) / (g.max() / g.sum()), 0, 5))


def dispersion(rgb: np.ndarray, stars: np.ndarray, radius: int = 5) -> float:
    """Median over stars of the mean distance between the channels' centroids."""
    found = []
    y, x = np.indices((2 * radius + 1,) * 2) - radius
    for cuts in zip(*(cutouts(rgb[..., c], stars, radius) for c in range(3)), strict=True):
        centres = []
        for c in cuts:
            c = np.maximum(c, 0)
            if c.sum() > 0:
                centres.append(((y * c).sum() / c.sum(), (x * c).sum() / c.sum()))
        if len(centres) == 3:
            found.append(np.mean([np.hypot(*np.subtract(centres[i], centres[j])) for i, j in ((0, 1), (0, 2), (1, 2))]))
    return float(np.median(found)) if found else 0.0


def zernike_terms(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fifteen modes over the unit disc of a cutout: (modes, pixels) and the disc's mask."""
    y, x = (np.indices((2 * radius + 1,) * 2) - radius) / radius
    r, t = np.hypot(y, x), np.arctan2(y, x)
    modes = [
        np.ones_like(r), r * np.cos(t), r * np.sin(t), 2 * r**2 - 1, r**2 * np.cos(2 * t), r**2 * np.sin(2 * t), (3 * r**3 - 2 * r) * np.cos(t), (3 * r**3 - 2 * r) * np.sin(t), r**3 * np.cos(3 * t), r**3 * np.sin(3 * t),
        6 * r**4 - 6 * r**2 + 1, (4 * r**4 - 3 * r**2) * np.cos(2 * t), (4 * r**4 - 3 * r**2) * np.sin(2 * t), r**4 * np.cos(4 * t), r**4 * np.sin(4 * t),
    ]
    disc = r <= 1
    return np.stack([m[disc] for m in modes]), disc


def zernike(a: np.ndarray, stars: np.ndarray, radius: int = 5) -> dict[str, float]:
    """Median coefficients over the stars: root mean square beyond tilt, defocus, astigmatism, coma and spherical."""
    modes, disc = zernike_terms(radius)
    fits = [np.linalg.lstsq(modes.T, c[disc] / max(c.max(), 1e-12), rcond=None)[0] for c in cutouts(a, stars, radius)]
    if not fits:
        return dict.fromkeys(("rms", "defocus", "astig", "coma", "spherical"), 0.0)
    m = np.median(fits, axis=0)
    return {"rms": float(np.sqrt((m[3:] ** 2).sum())), "defocus": float(m[3]), "astig": float(np.hypot(m[4], m[5])), "coma": float(np.hypot(m[6], m[7])), "spherical": float(m[10])}


def aperture_flux(a: np.ndarray, stars: np.ndarray, radius: float = 6, inner: float = 8, outer: float = 12) -> np.ndarray:
    """Flux inside the radius over the median of the ring, per star."""
    y, x = np.indices(a.shape)
    out = []
    for sy, sx in stars[:, :2] if len(stars) else ():
        d = np.hypot(y - sy, x - sx)
        ring = a[(d >= inner) & (d <= outer)]
        hole = d <= radius
        out.append(float(a[hole].sum() - hole.sum() * (np.median(ring) if ring.size else 0)))
    return np.array(out)


def wavelet_entropy_ratio(a: np.ndarray, levels: int = 4) -> float:
    """Shannon entropy of the finest detail bands over that of the coarsest, by an orthogonal transform."""
    entropies, ll = [], a.astype(float)
    for _ in range(levels):
        if min(ll.shape) < 2 or ll.shape[0] % 2 or ll.shape[1] % 2:
            break
        ll, details = K.haar2(ll)
        total = 0.0
        for d in details:
            p = d.ravel() ** 2
            p = p[p > 0] / max(p.sum(), 1e-12)
            total -= float((p * np.log2(p)).sum())
        entropies.append(total)
    return entropies[0] / entropies[-1] if entropies and entropies[-1] > 0 else 0.0


def field_aberration(shape: tuple[int, int], stars: np.ndarray, widths: np.ndarray) -> dict[str, float | str]:
    """Tilt (plane through the widths), growth towards the corners and a diagnosis, from star positions and widths."""
    if len(stars) < 6:
        return {"tilt": 0.0, "radial": 0.0, "diagnosis": "too few stars"}
    y, x = stars[:, 0] / shape[0] - 0.5, stars[:, 1] / shape[1] - 0.5
    design = np.column_stack([np.ones(len(y)), y, x])
    plane = np.linalg.lstsq(design, widths, rcond=None)[0]
    tilt = float(np.hypot(plane[1], plane[2]) / max(np.median(widths), 1e-9))
    r = np.hypot(y, x)
    radial = float(np.corrcoef(r, widths)[0, 1]) if r.std() > 0 and widths.std() > 0 else 0.0
    kind = "tilt" if tilt > 0.25 else "field curvature" if radial > 0.5 else "even"
    return {"tilt": tilt, "radial": radial, "diagnosis": kind}


#: Distances that are taken at once when hypotheses are counted.
HYPOTHESES = 200_000


def rigid_from_pairs(src: np.ndarray, dst: np.ndarray, tolerance: float = 3.0, relative: float = 0.01, least: int = 6) -> tuple[np.ndarray, int]:
    """Rigid transform between two star lists with unknown rotation: pairs of equal distance give hypotheses, consensus decides.

    The hypotheses are tried from the longest pair on, the first one with the most agreeing stars wins, and the search ends
    after a pair that brings nine tenths together. Many are counted at once, as rotations of the complex plane; where rounding
    could decide a count, and for the winner, the fit itself is made.
    """
    def pairs(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.triu_indices(len(p), 1)
        return i, j, np.hypot(*(p[i] - p[j]).T)

    (ai, aj, ad), (bi, bj, bd) = pairs(src), pairs(dst)
    order = np.argsort(bd)
    bi, bj, bd = bi[order], bj[order], bd[order]
    order = np.argsort(-ad, kind="stable")
    ai, aj, ad = ai[order], aj[order], ad[order]
    width = np.maximum(2 * tolerance, relative * ad)
    low = np.searchsorted(bd, ad - width)
    # two hypotheses for each pair of equal length, one for each direction
    ends = np.cumsum(2 * (np.searchsorted(bd, ad + width) - low))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    zs, zd = (p[:, 0] + 1j * p[:, 1] for p in (src, dst))
    extent = 1.0 + max((float(np.abs(z).max()) for z in (zs, zd) if len(z)), default=0.0)
    near, far = max(tolerance - 1e-9 * extent, 0.0) ** 2, (tolerance + 1e-9 * extent) ** 2

    def named(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        g = np.searchsorted(ends, h, "right")
        k, turned = low[g] + (h - starts[g]) // 2, (h - starts[g]) % 2 == 1
        return g, ai[g], aj[g], np.where(turned, bj[k], bi[k]), np.where(turned, bi[k], bj[k])

    def gaps(i: int, j: int, p: int, q: int) -> np.ndarray:
        t = K.rigid_fit(src[[i, j]], dst[[p, q]])
        moved = src @ t[:2, :2].T + t[:2, 2]
        return np.hypot(*(moved[:, None] - dst[None]).transpose(2, 0, 1))

    best, winner, enough = 0, None, 0.9 * min(len(src), len(dst))
    last = int(ends[-1]) if len(ends) else 0  # hypotheses from here on are not tried
    start, most = 0, max(1, HYPOTHESES // max(1, len(src) * len(dst)))
    step = min(most, 256)
    while start < last:
        g, i, j, p, q = named(np.arange(start, min(start + step, last)))
        turn = (zd[q] - zd[p]) * np.conj(zs[j] - zs[i])
        size = np.abs(turn)
        blurred = size <= 1e-9 * extent * extent  # no direction to speak of
        turn = np.where(blurred, 1.0, turn / np.where(blurred, 1.0, size))
        moved = turn[:, None] * zs + ((zd[p] + zd[q]) / 2 - turn * (zs[i] + zs[j]) / 2)[:, None]
        gap = moved[:, :, None] - zd
        gap = (gap.real**2 + gap.imag**2).min(2)
        sure, possible = np.where(blurred, 0, (gap < near).sum(1)), np.where(blurred, len(src), (gap < far).sum(1))
        h = -1
        while True:
            more = np.flatnonzero(possible[h + 1 : last - start] > best)
            if not len(more):
                break
            h += 1 + int(more[0])
            n = int(sure[h]) if sure[h] == possible[h] else int((gaps(i[h], j[h], p[h], q[h]).min(1) < tolerance).sum())
            if n > best:
                best, winner = n, (i[h], j[h], p[h], q[h])
                if best >= enough:
                    last = min(last, int(ends[g[h]]))
        start, step = start + step, min(most, 4 * step)
    if winner is None or best < least:
        return np.eye(3), 0
    gap = gaps(*winner)
    ok = gap.min(1) < tolerance
    return K.rigid_fit(src[ok], dst[gap[ok].argmin(1)]), best
