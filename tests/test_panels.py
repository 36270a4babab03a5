"""Panel mosaics and merged stacks: planted offsets and turns, whole runs over files, guards and empty inputs."""

from __future__ import annotations

import numpy as np
import pytest
from test_run import draw, star_field, turned

from skyfold.functions import sky
from skyfold.operators import merging, panels
from skyfold.operators import tiles as T
from skyfold.plans import panels as plans
from skyfold.plans import run
from skyfold.sources import formats

SCALE = 0.01


def scene(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    """A smooth sky with broad blobs, in degrees about (150, 30)."""
    x, y = (ra - 150) * np.cos(np.radians(dec)) / SCALE, (dec - 30) / SCALE
    return 500 + 3 * x - 2 * y + 400 * np.exp(-((x - 8) ** 2 + (y + 5) ** 2) / 120) + 300 * np.exp(-((x + 20) ** 2 + (y - 10) ** 2) / 200)


def directions(solution, shape):
    y, x = np.indices(shape).astype(float)
    ahead = np.einsum("ij,ikl->jkl", sky.basis(*solution[:2]), np.einsum("ij,jkl->ikl", sky._plane(solution), np.stack([x, y, np.ones(shape)])))
    ahead /= np.sqrt((ahead**2).sum(0))
    return np.degrees(np.arctan2(ahead[1], ahead[0])) % 360, np.degrees(np.arcsin(ahead[2]))


def header(solution) -> dict[str, str]:
    ra, dec, px, py, c11, c12, c21, c22 = (repr(float(v)) for v in solution)
    return {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": ra, "CRVAL2": dec, "CRPIX1": repr(float(solution[2]) + 1), "CRPIX2": repr(float(solution[3]) + 1), "CD1_1": c11, "CD1_2": c12, "CD2_1": c21, "CD2_2": c22}


def solved_panels(shape=(44, 52), gaps=(0.0, 30.0, -12.0, 55.0)):
    """Four turned panels that overlap around (150, 30), each with a sky of its own."""
    out = []
    for i, (dx, dy, degrees) in enumerate(((-16, -14, 4.0), (17, -12, -7.0), (-15, 13, 181.0), (16, 15, 12.0))):
        c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
        solution = np.array([150 + dx * SCALE / np.cos(np.radians(30)), 30 + dy * SCALE, (shape[1] - 1) / 2, (shape[0] - 1) / 2, -SCALE * c, SCALE * s, SCALE * s, SCALE * c])
        out.append((solution, scene(*directions(solution, shape)) + gaps[i]))
    return out


def test_planes_follow_each_other():
    a = np.array([10.0, 60.0, 5.0, 7.0, -0.02, 0.003, 0.003, 0.02])
    b = np.array([10.4, 60.3, 9.0, 2.0, -0.01, 0.0, 0.0, 0.01])
    there, back = sky.between(a, b), sky.between(b, a)
    x, y = np.array([0.0, 3.0, 8.0]), np.array([1.0, 9.0, 4.0])
    assert np.allclose(sky.mapped(back, *sky.mapped(there, x, y)), (x, y))
    # both pixels look the same way
    px, py = sky.mapped(there, x, y)
    look = lambda s, x, y: sky.basis(*s[:2]).T @ sky._plane(s) @ np.stack([x, y, np.ones(3)])
    u, v = look(b, x, y), look(a, px, py)
    assert np.allclose(u / np.sqrt((u**2).sum(0)), v / np.sqrt((v**2).sum(0)))
    behind = sky.between(np.array([190.0, -60.0, 5, 7, -0.02, 0, 0, 0.02]), b)
    assert np.isnan(sky.mapped(behind, x, y)).all()


def test_feather_is_the_distance_to_the_nearest_gap():
    rng = np.random.default_rng(1)
    valid = rng.random((23, 31)) > 0.02
    y, x = np.nonzero(~np.pad(valid, 1))
    gy, gx = np.indices(valid.shape) + 1
    dy, dx = np.abs(gy[..., None] - y), np.abs(gx[..., None] - x)
    steps = (np.maximum(dy, dx) + (np.sqrt(2) - 1) * np.minimum(dy, dx)).min(-1)
    assert np.allclose(sky.feather(valid), steps / steps.max())
    assert not sky.feather(np.zeros((3, 3), bool)).any()
    assert np.allclose(sky.feather(np.ones((3, 5), bool))[1], [0.5, 1, 1, 1, 0.5])


def test_offsets_of_a_graph_match_dense_least_squares():
    rng = np.random.default_rng(2)
    a, b = np.array([0, 0, 1, 2, 5, 6]), np.array([1, 2, 3, 3, 6, 7])
    n, d = rng.integers(1, 900, 6), rng.normal(0, 40, 6)
    rows = np.zeros((6, 9))
    rows[np.arange(6), a], rows[np.arange(6), b] = np.sqrt(n), -np.sqrt(n)
    dense = np.linalg.lstsq(rows, -np.sqrt(n) * d, rcond=None)[0]
    assert np.allclose(sky.graph_offsets(a, b, n, d, 9), dense, atol=1e-6)
    assert not sky.graph_offsets(a[:0], b[:0], n[:0], d[:0], 2).any()


def frame(spark, rows):
    """Rows (mosaic, panel, channel, header, array)."""
    flat = [(m, p, c, h, a.shape[0], a.shape[1], a.ravel().tolist()) for m, p, c, h, a in rows]
    return spark.createDataFrame(flat, "mosaic string, panel string, channel int, header map<string,string>, height int, width int, data array<double>")


def image(tiles, grid):
    h, w = grid["grid_height"], grid["grid_width"]
    out = np.full((h, w), np.nan)
    for r in T.to_pixels(tiles, ["mosaic"]).filter("n_used > 0").collect():
        out[r["y"], r["x"]] = r["value"]
    return out


def test_planted_offsets_are_recovered(spark):
    gaps = (0.0, 30.0, -12.0, 55.0)
    found = solved_panels(gaps=gaps)
    rows = [("m", f"p{i}", 0, header(s), a) for i, (s, a) in enumerate(found)]
    rows += [("unsolved", "q", 0, {"OBJECT": "x"}, found[0][1]), ("alone", "z", 0, header(found[0][0]), found[0][1])]
    solved = panels.solution(frame(spark, rows))
    assert [r["panel"] for r in solved.filter("wcs IS NULL").collect()] == ["q"]
    grid, shifts, tiles = plans.stitch(solved, ["mosaic"], 16, level=False)
    got = {r["panel"]: r["sky_offset"] for r in shifts.collect()}
    assert np.allclose([got[f"p{i}"] for i in range(4)], np.mean(gaps) - np.array(gaps), atol=0.4) and set(got) == {f"p{i}" for i in range(4)}
    grids = {r["mosaic"]: r for r in grid.collect()}
    assert set(grids) == {"m", "alone"} and abs(grids["m"]["grid_ra"] - 150) < 0.05 and abs(grids["m"]["grid_dec"] - 30) < 0.05
    g = grids["m"]
    out = image(tiles.filter("mosaic = 'm'"), g)
    plane = np.array([g["grid_ra"], g["grid_dec"], -g["grid_left"], -g["grid_bottom"], -g["grid_scale"], 0, 0, g["grid_scale"]])
    rest = out - scene(*directions(plane, out.shape)) - np.mean(gaps)
    assert np.isfinite(rest).sum() > 4000 and np.nanmax(np.abs(rest)) < 1.5  # no seams
    alone = image(tiles.filter("mosaic = 'alone'"), grids["alone"])
    assert np.isfinite(alone).sum() > 1800
    # tiles of another size give the same sums
    _, _, wide = plans.stitch(solved, ["mosaic"], 64, level=False)
    assert np.allclose(image(wide.filter("mosaic = 'm'"), g), out, atol=1e-7, equal_nan=True)


def test_missing_samples_cover_nothing(spark):
    (s, a), *_ = solved_panels()
    holed = a.copy()
    holed[10:14, 10:14], holed[20, 30] = 0.0, np.nan
    rows = [("m", "a", 0, header(s), holed), ("m", "empty", 0, header(s), np.zeros((0, 0)))]
    _, shifts, tiles = plans.stitch(panels.solution(frame(spark, rows)), ["mosaic"], 32, level=False)
    assert shifts.count() == 0
    pixels = T.to_pixels(tiles, ["mosaic"])
    assert 15 <= pixels.filter("n_used = 0 AND y BETWEEN 5 AND 40 AND x BETWEEN 5 AND 48").count() <= 60
    assert abs(pixels.filter("n_used > 0").agg({"value": "min"}).first()[0] - a.min()) < 5
    none = panels.solution(frame(spark, rows).limit(0))
    assert all(df.count() == 0 for df in plans.stitch(none, ["mosaic"], 32))


def test_header_forms_agree(spark):
    c, s = float(np.cos(0.3)), float(np.sin(0.3))
    base = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": "5", "CRVAL2": "6", "CRPIX1": "1", "CRPIX2": "2", "CDELT1": "-0.02", "CDELT2": "0.03"}
    forms = [
        base | {"CROTA2": repr(0.3 * 180 / np.pi)},
        base | {"PC1_1": repr(c), "PC1_2": repr(1.5 * s), "PC2_1": repr(-s / 1.5), "PC2_2": repr(c)},
        base | {"CD1_1": repr(-0.02 * c), "CD1_2": repr(-0.03 * s), "CD2_1": repr(-0.02 * s), "CD2_2": repr(0.03 * c)},
    ]
    forms += [base | {"CTYPE1": "GLON-TAN"}, {k: v for k, v in base.items() if k != "CRPIX1"}, base | {"CDELT1": "0"}]
    got = panels.solution(frame(spark, [("m", str(i), 0, f, np.ones((2, 2))) for i, f in enumerate(forms)])).orderBy("panel").collect()
    turned_ = [r["wcs"] for r in got]
    assert turned_[3:] == [None] * 3
    assert np.allclose(turned_[0], turned_[2]) and np.allclose(turned_[0][:4], [5, 6, 0, 1])
    # the PC form's rows are scaled by their own CDELT
    assert np.allclose(turned_[1][4:], [-0.02 * c, -0.03 * s, -0.02 * s, 0.03 * c])


def test_stitched_files(spark, tmp_path):
    gains = np.array([0.5, 1.0, 0.8])[:, None, None]
    (tmp_path / "in").mkdir()
    for i, (s, a) in enumerate(solved_panels()):
        numbers = {k: float(v) if not k.startswith("CTYPE") else v for k, v in header(s).items()}
        (tmp_path / "in" / f"p{i}.fits").write_bytes(formats.write_fits(a * gains, numbers | {"OBJECT": "field"}))
    shifts = plans.stitch_directory(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert shifts.count() == 12
    out, head = formats.read_fits((tmp_path / "out" / "mosaic.fits").read_bytes())
    assert out.shape[0] == 3 and head["NPANELS"] == "4" and head["PANEL003"] == "p3.fits" and head["OBJECT"] == "field" and (tmp_path / "out" / "mosaic.jpg").exists()
    assert np.allclose(out[0][out[1] != 0] / out[1][out[1] != 0], 0.5, atol=0.1) or np.corrcoef(out[0].ravel(), out[1].ravel())[0, 1] > 0.999
    again = panels.solution(plans.load_panels(spark, f"{tmp_path}/out/mosaic.fits").drop("wcs")).first()["wcs"]
    assert abs(again["ra"] - 150) < 0.05 and again["c22"] == pytest.approx(SCALE)
    (tmp_path / "in" / "bad.fits").write_bytes(formats.write_fits(np.ones((5, 5)), {}))
    with pytest.raises(ValueError, match="bad.fits"):
        plans.load_panels(spark, f"{tmp_path}/in")


def test_folders_become_a_mosaic(spark, tmp_path):
    rng = np.random.default_rng(8)
    shape, scale = (64, 80), 0.001
    (tmp_path / "in").mkdir()
    for i, dx in enumerate((0, 40)):  # the second panel lies 40 pixels west
        folder = tmp_path / "in" / f"panel_{i}"
        folder.mkdir()
        stars = star_field(np.random.default_rng(3), 40, (64, 140), 8)
        for k in range(3):
            a = draw(shape, stars - [0, dx, 0]) + 40 * i + rng.normal(0, 3, shape)
            solution = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": 20.0, "CRVAL2": 0.0, "CRPIX1": 40.5 - dx, "CRPIX2": 32.5, "CDELT1": -scale, "CDELT2": scale}
            (folder / f"img_{k}.fits").write_bytes(formats.write_fits(a.astype("f4"), {"EXPTIME": 30.0, "DATE-OBS": f"2024-01-0{k + 1}"} | solution))
    plan = run.StackPlan(clean=(), combine="mean", weighted=False, outlier_sigma=50.0, shift_sigma=50.0, quality_threshold=0.0)
    shifts = {r["panel"].rsplit("/", 2)[1]: r["sky_offset"] for r in plans.mosaic_run(spark, f"{tmp_path}/in", f"{tmp_path}/out", plan).collect()}
    assert set(shifts) == {"000", "001"}
    stack, head = formats.read_fits((tmp_path / "out" / "panels" / "001" / "stack.fits").read_bytes())
    assert float(head["CRPIX1"]) == 0.5 and float(head["TOTEXP"]) == 90 and (head["DATEFRST"], head["DATELAST"]) == ("2024-01-01", "2024-01-03")
    out, head = formats.read_fits((tmp_path / "out" / "mosaic.fits").read_bytes())
    assert abs(out.shape[0] - 64) <= 2 and abs(out.shape[1] - 120) <= 2
    # where the mosaic's own solution puts the stars
    at = {k: float(head[k]) for k in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2")}
    move = [at["CRPIX2"] - 1 - 31.5 - at["CRVAL2"] / scale, at["CRPIX1"] - 1 - 39.5 + (at["CRVAL1"] - 20) / scale, 0]
    truth = draw(out.shape, stars + move)
    assert np.corrcoef(out[4:58, 4:114].ravel(), truth[4:58, 4:114].ravel())[0, 1] > 0.97


def write_stack(path, a, frames, **more):
    path.write_bytes(formats.write_fits(a, {"RAWSTACK": "T", "NFRAMES": frames, "TOTEXP": 10.0 * frames} | more))


def test_merged_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    shape = (120, 140)
    stars = star_field(rng, 30, shape, 26)
    truth = draw(shape, stars)
    noisy = lambda a, s: a + rng.normal(0, s, a.shape)
    (tmp_path / "new").mkdir()
    (tmp_path / "old").mkdir()
    write_stack(tmp_path / "new" / "now.fits", noisy(truth, 6), 10, DATEFRST="2024-02-01", DATELAST="2024-02-02")
    write_stack(tmp_path / "old" / "a.fits", noisy(draw(shape, turned(stars, shape, 3.5, -2.25, 20.0)), 3), 40, DATEFRST="2024-01-01", DATELAST="2024-01-02")
    wide = noisy(np.pad(truth, ((0, 10), (0, 6)), mode="edge"), 3)
    write_stack(tmp_path / "old" / "b.fits", wide, 0)
    placed = {r["stack"].rsplit("/", 1)[1]: r for r in plans.merge_directory(spark, f"{tmp_path}/new", f"{tmp_path}/old", f"{tmp_path}/out").collect()}
    a, b = placed["a.fits"], placed["b.fits"]
    assert np.allclose((a["dy"], a["dx"], np.degrees(a["angle"])), (3.5, -2.25, 20), atol=0.15) and a["allowed"] and a["overlap"] > 0.6 and a["correlation"] > 0.7
    assert max(abs(b["dy"]), abs(b["dx"])) < 0.3 and b["overlap"] > 0.95
    out, head = formats.read_fits((tmp_path / "out" / "merged.fits").read_bytes())
    assert out.shape == shape and head["NFRAMES"] == "50" and head["MERGED"] == "2" and float(head["TOTEXP"]) == 500 and (head["DATEFRST"], head["DATELAST"]) == ("2024-01-01", "2024-02-02") and head["MRGSRC1"] == "a.fits"
    inner = (slice(40, 80), slice(45, 95))
    quiet = truth[inner] < 1001
    assert np.std((out - truth)[inner][quiet]) < 4.5 < 5 < np.std(noisy(truth, 6)[inner][quiet] - truth[inner][quiet])
    assert abs(np.median((out - truth)[inner])) < 1  # borders of the footprint dilute nothing


def test_wrong_targets_are_refused(spark, tmp_path):
    rng = np.random.default_rng(7)
    shape = (100, 110)
    for name in ("new", "old", "raw"):
        (tmp_path / name).mkdir()
    field = draw(shape, star_field(rng, 22, shape, 15))
    write_stack(tmp_path / "new" / "now.fits", field + rng.normal(0, 4, shape), 5)
    write_stack(tmp_path / "old" / "other.fits", rng.normal(1000, 5, shape), 5)
    with pytest.raises(ValueError, match="other.fits"):
        plans.merge_directory(spark, f"{tmp_path}/new", f"{tmp_path}/old", f"{tmp_path}/out")
    placed = plans.merge_directory(spark, f"{tmp_path}/new", f"{tmp_path}/old", f"{tmp_path}/out", strict=False)
    assert placed.filter("allowed").count() == 0
    out, head = formats.read_fits((tmp_path / "out" / "merged.fits").read_bytes())
    now, _ = formats.read_fits((tmp_path / "new" / "now.fits").read_bytes())
    assert np.allclose(out, now) and head["NFRAMES"] == "5" and head["MERGED"] == "0"
    (tmp_path / "raw" / "x.fits").write_bytes(formats.write_fits(field, {"RAWSTACK": "F"}))
    with pytest.raises(ValueError, match="x.fits"):
        plans.load_stacks(spark, f"{tmp_path}/raw")


def test_laid_and_likeness():
    a = np.arange(30.0).reshape(5, 6)
    assert np.array_equal(merging.laid(a, (5, 6), 0.01, 0.0, 0.0), a)
    moved = merging.laid(a, (7, 6), 1.0, 0.0, 0.0)
    assert np.allclose(moved[1:6], a) and np.isnan(moved[[0, 6]]).all()
    big = np.random.default_rng(0).normal(size=(60, 60))
    assert merging.likeness(big, big) == (1.0, pytest.approx(1.0)) and merging.likeness(big, np.ones_like(big))[1] == 0.0
    assert merging.likeness(a, a) == (1.0, None)
