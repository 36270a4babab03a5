"""Scalar functions over columns: stretches, colour, headers, names, dates and angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    y = luminance(r, g, b)
    return y, (b - y) * 0.564, (r - y) * 0.713


def rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    r, b = y + cr / 0.713, y + cb / 0.564
    return r, (y - 0.299 * r - 0.114 * b) / 0.587, b


def asinh(x: Column) -> Column:
    """From logarithms, as engines round asinh differently."""
    return F.signum(x) * F.log(F.abs(x) + F.sqrt(x * x + 1))


def hyperbolic_stretch(v: Column, black: float, white: float, k: float, sp: float, lp: float = 0.0, hp: float = 1.0) -> Column:
    """Generalized hyperbolic stretch around the symmetry point; linear for a vanishing k."""
    n = F.greatest(F.least((v - black) / (white - black), F.lit(1.0)), F.lit(0.0))
    if abs(k) < 1e-6:
        return n
    low, high = asinh(F.lit(k * (lp - sp))), asinh(F.lit(k * (hp - sp)))
    return F.when(n <= lp, 0.0).when(n >= hp, 1.0).otherwise((asinh(k * (n - sp)) - low) / (high - low))


def arcsinh_stretch(v: Column, sky: Column) -> Column:
    """First factor of the ladder 3, 5, 10, 20, 50, 100 that lifts the sky to 0.15."""
    lift = lambda x, f: asinh(x * f) / asinh(F.lit(float(f)))
    out = lift(v, 100)
    for f in (50, 20, 10, 5, 3):
        out = F.when(lift(sky, f) >= 0.15, lift(v, f)).otherwise(out)
    return out


def linear_rescale(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least((v - low) / F.greatest(high - low, F.lit(1e-12)), F.lit(1.0)), F.lit(0.0))


def scnr(target: Column, a: Column, b: Column, amount: float) -> Column:
    """Subtractive green-noise removal: the target is held to the mean of the others."""
    return F.greatest(target * (1 - amount) + F.least(target, (a + b) / 2) * amount, F.lit(0.0))


def soft_threshold(x: Column, t: Column | float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0)) + 0.0  # no negative zero


def moffat(r: Column, amplitude: float, alpha: float, beta: float) -> Column:
    return amplitude * F.pow(1 + (r / alpha) * (r / alpha), F.lit(-beta))


def gaussian(r: Column, amplitude: float, sigma: float) -> Column:
    return amplitude * F.exp(-0.5 * (r / sigma) * (r / sigma))


def magnitude_to_flux(m: Column) -> Column:
    return F.pow(F.lit(10.0), -0.4 * m)


def circular_difference(a: Column, b: Column) -> Column:
    """Difference of two angles in [-180, 180)."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def rotation_degrees(m00: Column, m10: Column) -> Column:
    return F.degrees(F.atan2(m10, m00))


def compass(angle: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.pmod(F.round(angle / 45), F.lit(8)) + 1).cast("int"))


def normalize_id(name: Column) -> Column:
    """Catalogue identifiers: upper case, single spaces, a space between catalogue and number."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(name), r"\s+", " "), r"^(M|NGC|IC|SH2-?|B) ?0*([0-9]+)$", "$1 $2"))


def catalog_ids(text: Column, digits: int | None = 4) -> Column:
    """All catalogue identifiers in a text, of at most so many digits (None: of any number)."""
    number = r"\d+" if digits is None else rf"\d{{1,{digits}}}"
    return F.regexp_extract_all(text, F.lit(rf"(?i)\b((?:NGC|IC|M|Sh2-)\s?{number})\b"), 1)


def strip_date(name: Column) -> Column:
    return F.regexp_replace(name, r"[_\- ]?\d{4}-?\d{2}-?\d{2}$", "")


def folder_label(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def virtual_frame(path: Column) -> tuple[Column, Column]:
    """File and frame number of a virtual path `file::n`."""
    return F.regexp_extract(path, r"^(.*?)(?:::(\d+))?$", 1), F.nullif(F.regexp_extract(path, r"::(\d+)$", 1), F.lit("")).cast("int")


def header_number(header: Column, *names: str) -> Column:
    """First of several header keys that reads as a number."""
    return F.coalesce(*[F.try_element_at(header, F.lit(n)).try_cast("double") for n in names])


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.pmod(F.floor(s / 60), F.lit(60)).cast("long"), F.pmod(s, F.lit(60)).cast("long"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def classify_frame(path: Column, imagetyp: Column, exptime: Column) -> Column:
    """light, dark, flat or bias from name, header type and exposure."""
    name, kind = F.lower(path), F.lower(F.coalesce(imagetyp, F.lit("")))
    has = lambda w: name.contains(w) | (kind == w)
    return F.when(has("dark"), "dark").when(has("flat"), "flat").when(has("bias"), "bias").when(exptime == 0, "bias").otherwise("light")


def object_type(otype: Column) -> Column:
    """Internal class of a catalogue object type; the order of the tests counts."""
    o = F.lower(otype)
    has = lambda *w: F.greatest(*[o.contains(x).cast("int") for x in w], F.lit(0)) == 1
    return F.when(has("glob"), "globular").when(has("cl", "opc"), "star_field").when(has("pn"), "planetary").when(has("hii", "snr", "em"), "emission").when(has("rne", "ref"), "reflection").when(has("g", "agn"), "galaxy").otherwise("unknown")


def bv_from_bprp(c: Column) -> Column:
    """Johnson colour from the survey colour by a cubic."""
    return 0.0981 + 1.4290 * c * 0.5 - 0.0269 * c * c + 0.0061 * c * c * c


def tan_wcs(ra: Column, dec: Column, fov_x: Column, fov_y: Column, width: Column, height: Column, orientation: Column) -> dict[str, Column]:
    """Keywords of a tangent-plane solution from centre, field of view and orientation (degrees)."""
    sx, sy, t = -fov_x / width, fov_y / height, F.radians(orientation)
    return {"CRVAL1": ra, "CRVAL2": dec, "CRPIX1": width / 2 + 0.5, "CRPIX2": height / 2 + 0.5, "CD1_1": sx * F.cos(t), "CD1_2": -sy * F.sin(t), "CD2_1": sx * F.sin(t), "CD2_2": sy * F.cos(t)}


def sky_to_pixel(ra: Column, dec: Column, ra0: float, dec0: float, scale: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Tangent-plane pixel position at `scale` degrees a pixel."""
    d, r, d0 = F.radians(dec), F.radians(ra - ra0), F.radians(F.lit(dec0))
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(r)
    xi, eta = F.cos(d) * F.sin(r) / c, (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(r)) / c
    return cx - F.degrees(xi) / scale, cy + F.degrees(eta) / scale
