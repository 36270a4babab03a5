"""Mosaics of solved panels: a common tangent plane, tiles of reprojected panels, sky offsets from the overlaps, feathered sums.

Panels are rows (keys..., panel, channel, header, height, width, data); `keys`, of which there is at least one, name the mosaic. The plane follows from sums and
extremes of the panels' corners. Each panel becomes blocks of the plane's tiles where it lies, so what is shuffled is a block a
panel and tile; tiles give the sums of differences of the panels that meet there, added up to one row a pair of neighbours, of
which one small least-squares system a mosaic and channel makes the offsets. A last pass adds the tiles up.

Headers are (CTYPE, CRVAL, CRPIX and a CD matrix, or CDELT with PC or CROTA2) of the gnomonic projection. A panel without them
is not solved. Null or empty data, and zero or non-finite samples, cover nothing. Channels are told apart by number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import scalars as S
from skyfold.functions import sky
from skyfold.operators import tiles as T
from skyfold.operators.image_ops import _array, _kinds

SOLUTION = ["ra", "dec", "px", "py", "c11", "c12", "c21", "c22"]
GRID = ["grid_ra", "grid_dec", "grid_scale", "grid_left", "grid_bottom", "grid_height", "grid_width"]


def solution(panels: DataFrame) -> DataFrame:
    """Panels with a column `wcs` of SOLUTION's fields from their headers; null where a panel is not solved."""
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731 - a value that is named is evaluated once
    names = ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CDELT1", "CDELT2", "CROTA2", *(f"{m}{i}_{j}" for m in ("CD", "PC") for i in (1, 2) for j in (1, 2)))
    numbers = F.struct(*(S.header_number(F.col("header"), n).alias(n) for n in names))

    def solved(n: Column) -> Column:
        turn, zero = F.radians(F.coalesce(n["CROTA2"], F.lit(0.0))), F.lit(0.0)
        turned = {(1, 1): n["CDELT1"] * F.cos(turn), (1, 2): -n["CDELT2"] * F.sin(turn), (2, 1): n["CDELT1"] * F.sin(turn), (2, 2): n["CDELT2"] * F.cos(turn)}
        scaled = lambda i, j: n[f"CDELT{i}"] * F.coalesce(n[f"PC{i}_{j}"], zero)
        matrix = [F.when(n["CD1_1"].isNotNull(), F.coalesce(n[f"CD{i}_{j}"], zero)).when(n["PC1_1"].isNotNull(), scaled(i, j)).otherwise(turned[i, j]) for i in (1, 2) for j in (1, 2)]
        values = [n["CRVAL1"], n["CRVAL2"], n["CRPIX1"] - 1, n["CRPIX2"] - 1, *matrix]
        return F.struct(*(v.alias(s) for v, s in zip(values, SOLUTION, strict=True)))

    def usable(w: Column) -> Column:
        known = F.abs(w["c11"] * w["c22"] - w["c12"] * w["c21"]) > 1e-30
        for s in SOLUTION:
            known = known & w[s].isNotNull() & ~F.isnan(w[s])
        return F.when(known, w)

    kind = lambda name: F.upper(F.try_element_at("header", F.lit(name)))
    flat = kind("CTYPE1").rlike("^RA-.*-TAN$") & kind("CTYPE2").rlike("^DEC.*-TAN$")
    return panels.withColumn("wcs", F.when(flat, once(numbers, lambda n: once(solved(n), usable))))


def _basis(ra: Column, dec: Column) -> list[tuple[Column, Column, Column]]:
    a, d = F.radians(ra), F.radians(dec)
    return [(-F.sin(a), F.cos(a), F.lit(0.0)), (-F.sin(d) * F.cos(a), -F.sin(d) * F.sin(a), F.cos(d)), (F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))]


def common_grid(panels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., GRID...): the plane that touches the sky at the mean of all corners, north up, with the finest panel's scale, and
    as large as the corners reach; grid_left and grid_bottom are its first column and line counted from the point of touch.

    A corner that lies more than 85 degrees from that point stops the query.
    """
    keys = list(keys)
    one = panels.filter("wcs IS NOT NULL AND height > 0 AND width > 0").select(*keys, "wcs", "height", "width").distinct()
    edge = lambda n: F.array(F.lit(-0.5), n - 0.5)
    corners = one.select(*keys, "wcs", F.explode(edge(F.col("width"))).alias("_x"), "height").select(*keys, "wcs", "_x", F.explode(edge(F.col("height"))).alias("_y"))
    w = {s: F.col("wcs")[s] for s in SOLUTION}
    x, y = F.col("_x") - w["px"], F.col("_y") - w["py"]
    plane = (F.radians(w["c11"] * x + w["c12"] * y), F.radians(w["c21"] * x + w["c22"] * y), F.lit(1.0))
    axes = _basis(w["ra"], w["dec"])
    ahead = [sum((p * axis[i] for p, axis in zip(plane, axes, strict=True)), F.lit(0.0)) for i in range(3)]
    length = F.sqrt(sum((c * c for c in ahead), F.lit(0.0)))
    seen = corners.select(*keys, F.sqrt(F.abs(w["c11"] * w["c22"] - w["c12"] * w["c21"])).alias("_s"), *((c / length).alias(f"_d{i}") for i, c in enumerate(ahead)))
    total = seen.groupBy(*keys).agg(*(F.sum(f"_d{i}").alias(f"_t{i}") for i in range(3)), F.min("_s").alias("grid_scale"))
    flat = F.sqrt(F.col("_t0") ** 2 + F.col("_t1") ** 2)
    centre = total.select(*keys, F.pmod(F.degrees(F.atan2("_t1", "_t0")), F.lit(360.0)).alias("grid_ra"), F.degrees(F.atan2(F.col("_t2"), flat)).alias("grid_dec"), "grid_scale")
    j = seen.join(centre, keys)
    east, north, out = (sum((F.col(f"_d{i}") * axis[i] for i in range(3)), F.lit(0.0)) for axis in _basis(F.col("grid_ra"), F.col("grid_dec")))
    near = F.when(out > 0.0872, out).otherwise(F.raise_error(F.lit("panels lie too far apart for one plane")))
    at = j.select(*keys, "grid_ra", "grid_dec", "grid_scale", (-F.degrees(east / near) / F.col("grid_scale")).alias("_gx"), (F.degrees(north / near) / F.col("grid_scale")).alias("_gy"))
    low, high = (lambda c: F.ceil(F.min(c) - 1e-6).cast("int")), (lambda c: F.floor(F.max(c) + 1e-6).cast("int"))
    return at.groupBy(*keys, "grid_ra", "grid_dec", "grid_scale").agg(low("_gx").alias("grid_left"), low("_gy").alias("grid_bottom"), (high("_gy") - low("_gy") + 1).alias("grid_height"), (high("_gx") - low("_gx") + 1).alias("grid_width")).select(*keys, *GRID)


def blocks(panels: DataFrame, grid: DataFrame, keys: Sequence[str], size: int, level: bool = True) -> DataFrame:
    """(keys..., channel, panel, y0, x0, th, tw, block, weights) of solved panels on their mosaic's grid."""
    keys = list(keys)
    named = [*keys, "channel", "panel"]
    placed = panels.filter("wcs IS NOT NULL AND size(data) > 0").join(grid, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (d, h, w) in enumerate(zip(batch.column("data"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)):
                own = np.array([batch.column(s)[i].as_py() for s in SOLUTION], float)
                ra, dec, scale, left, bottom, rows, columns = (batch.column(g)[i].as_py() for g in GRID)
                plane = np.array([ra, dec, -left, -bottom, -scale, 0.0, 0.0, scale])
                for y0, x0, v, soft in sky.reproject(_array(d, h, w), own, plane, (rows, columns), size, level):
                    at = pa.array([i])
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in named), *T.blocks([(y0, x0, v)]), pa.array([np.ascontiguousarray(soft, "<f8").tobytes()], pa.binary())], names=[*named, *T.NAMES, "weights"])

    flat = placed.select(*named, *(F.col("wcs")[s].alias(s) for s in SOLUTION), *GRID, "height", "width", "data")
    return flat.mapInArrow(run, f"{_kinds(panels, named)}, {T.KINDS}, weights binary")


def _stacked(table: pa.Table, column: str) -> np.ndarray:
    return np.stack([np.frombuffer(b.as_buffer(), "<f8") for c in table.column(column).chunks for b in c])


def overlaps(cut: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., channel, a, b, n, difference): mean of panel a less panel b over the n samples that both cover, a before b."""
    by = [*keys, "channel", "y0", "x0"]
    named = [*keys, "channel"]
    kind = cut.schema["panel"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("panel")
        v = _stacked(table, "block")
        there = np.isfinite(v).astype(float)
        n = there @ there.T
        total = np.where(there > 0, v, 0.0) @ there.T  # of the first, where the second is too
        i, j = np.nonzero(np.triu(n > 0, 1))
        names = table.column("panel").combine_chunks()
        first = [table.column(k).combine_chunks().take(pa.array(np.zeros(len(i), int))) for k in named]
        return pa.table([*first, names.take(pa.array(i)), names.take(pa.array(j)), pa.array(n[i, j].astype(np.int64)), pa.array((total - total.T)[i, j])], names=[*named, "a", "b", "n", "_d"])

    found = cut.select(*by, "panel", "block").groupBy(*by).applyInArrow(run, f"{_kinds(cut, named)}, a {kind}, b {kind}, n bigint, _d double")
    return found.groupBy(*named, "a", "b").agg(F.sum("n").alias("n"), F.sum("_d").alias("_d")).select(*named, "a", "b", "n", (F.col("_d") / F.col("n")).alias("difference"))


def offsets(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., channel, panel, sky_offset): what each panel that overlaps another has to gain; their mean is 0 in each connected
    part of a mosaic. A task holds one mosaic's pairs of neighbours."""
    named = [*keys, "channel"]
    kind = pairs.schema["a"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        ends = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).combine_chunks().dictionary_encode()
        at, n = ends.indices.to_numpy(), len(table)
        found = sky.graph_offsets(at[:n], at[n:], table.column("n").to_numpy(), table.column("difference").to_numpy(), len(ends.dictionary))
        first = [table.column(k).combine_chunks().take(pa.array(np.zeros(len(found), int))) for k in named]
        return pa.table([*first, ends.dictionary, pa.array(found)], names=[*named, "panel", "sky_offset"])

    return pairs.orderBy(*named, "a", "b").groupBy(*named).applyInArrow(run, f"{_kinds(pairs, named)}, panel {kind}, sky_offset double")


def coadd(cut: DataFrame, shifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles (keys..., channel, y0, x0, th, tw, value, n_used, n_rejected) of the panels' feathered means; 0 where none reaches."""
    named = [*keys, "channel"]
    by = [*named, "y0", "x0", "th", "tw"]
    lifted = cut.join(shifts, [*named, "panel"], "left").withColumn("sky_offset", F.coalesce("sky_offset", F.lit(0.0)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("panel")
        v, w = _stacked(table, "block"), _stacked(table, "weights")
        there = np.isfinite(v)
        v, w = np.where(there, v + table.column("sky_offset").to_numpy()[:, None], 0.0), np.where(there, w, 0.0)
        total = w.sum(0)
        value, used = (v * w).sum(0) / np.where(total > 0, total, 1.0), there.sum(0).astype(np.int64)
        kinds = [pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([*table.select(by).slice(0, 1).columns, *(pa.array([a], k) for a, k in zip((value, used, np.zeros_like(used)), kinds, strict=True))], names=[*by, "value", "n_used", "n_rejected"])

    return lifted.select(*by, "panel", "sky_offset", "block", "weights").groupBy(*by).applyInArrow(run, f"{_kinds(cut, by)}, value array<double>, n_used array<bigint>, n_rejected array<bigint>")


def side(panels: DataFrame, keys: Sequence[str]) -> int:
    """Side of tiles of which the blocks and weights of a mosaic's panels stay within the tile budget, wherever they lie."""
    most = panels.groupBy(*keys, "channel").count().agg(F.max("count")).first()[0]
    return T.side(2 * (most or 1))
