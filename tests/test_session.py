"""A live session from arriving frames; elastic placement; vignette maps, configuration files and exports of the batch run."""

from __future__ import annotations

import os

import numpy as np
import pytest

from skyfold.operators import image_ops as I
from skyfold.plans import run
from skyfold.sources import formats
from skyfold.sources import frames as files
from skyfold.streaming import session as L

SHAPE = (72, 80)


def field(rng, dy: float = 0.0, dx: float = 0.0, bend: float = 0.0) -> np.ndarray:
    stars = np.random.default_rng(9)
    y, x = np.indices(SHAPE)
    a = np.full(SHAPE, 1000.0)
    for sy, sx, flux in np.column_stack([stars.uniform(12, 60, 40), stars.uniform(12, 68, 40), stars.uniform(1500, 4000, 40)]):
        a += flux * np.exp(-((y - sy - dy - bend * np.sin(sx / 15)) ** 2 + (x - sx - dx) ** 2) / (2 * 1.5**2))
    return a + rng.normal(0, 4, SHAPE)


def rows(n: int, start: int = 0) -> list[tuple]:
    rng = np.random.default_rng(start + 1)
    shifts = [(0, 0) if start + i == 0 else tuple(int(v) for v in rng.integers(-3, 4, 2)) for i in range(n)]
    return [(start + i, start + i, 0, *SHAPE, 30.0, [float(v) for v in field(rng, *s).ravel()]) for i, s in enumerate(shifts)]


def test_session_grows_with_its_frames(spark, tmp_path):
    plan = run.StackPlan(clean=(), quality_threshold=1.0)
    arrive = lambda r: spark.createDataFrame(r, L.FRAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go = lambda: L.stream_stack(spark, spark.readStream.schema(L.FRAME).parquet(f"{tmp_path}/in"), L.Masters(), plan, f"{tmp_path}/live", f"{tmp_path}/out")
    empty = (99, 2, 0, *SHAPE, 30.0, [1000.0] * (SHAPE[0] * SHAPE[1]))
    arrive([*rows(2), empty])
    first = go()
    assert {r.frame_id: r.accepted for r in first["metrics"].collect()} == {0: True, 1: True, 99: False}
    arrive(rows(3, 3))
    second = go()
    assert [r.frames for r in second["history"].orderBy("frames").collect()] == [1, 2, 3, 4, 5]
    assert max(r.total_exposure for r in second["history"].collect()) == 150.0
    image, header = formats.read_fits(open(f"{tmp_path}/out/live.fits", "rb").read())
    assert (header["NFRAMES"], header["TOTEXP"].strip()) == ("5", "150.0") and os.path.exists(f"{tmp_path}/out/live.png")
    truth = field(np.random.default_rng(0))
    moves = [np.corrcoef(image[12:60, 12:68].ravel(), np.roll(truth, (dy, dx), (0, 1))[12:60, 12:68].ravel())[0, 1] for dy in range(-3, 4) for dx in range(-3, 4)]
    assert max(moves) > 0.97


def test_masters_and_empty_sessions(spark, tmp_path):
    level = [(i, 0, kind, 4, 4, [v] * 16) for i, (kind, v) in enumerate([("bias", 10.0), ("bias", 12.0), ("flat", 500.0)])]
    cal = spark.createDataFrame(level, "frame_id long, channel int, frame_type string, height int, width int, data array<double>")
    m = L.session_masters(spark, cal, str(tmp_path))
    assert {r.value for r in m.dark.collect()} == {11.0} and {r.value for r in m.flat.collect()} == {1.0}
    assert L.session_masters(spark, cal.filter("false"), str(tmp_path)) == L.Masters()
    none = spark.createDataFrame([], "frame_id long, seq long, score double, snr double, fwhm double, accepted boolean")
    with pytest.raises(ValueError):
        L.fold(spark, none, run.StackPlan(), str(tmp_path))


def test_elastic_placement_beats_the_rigid_one(spark):
    rng = np.random.default_rng(4)
    reference, bent = field(rng), field(rng, 1.0, -1.0, 1.2)
    f = spark.createDataFrame([(0, 0, *SHAPE, [float(v) for v in a.ravel()]) for a in (bent,)], "session int, frame_id int, height int, width int, data array<double>")
    r = spark.createDataFrame([(0, [float(v) for v in reference.ravel()])], "session int, r_data array<double>")
    miss = {}
    for cells in (0, 16):
        placed = I.register_to_reference(f, r, ["session"], "frame_id", cells=cells)
        row = I.align_frames(f.join(placed, ["session", "frame_id"]), ["frame_id"], (8, 64, 8, 72)).first()
        assert (row.height, row.width) == (56, 64)
        miss[cells] = np.abs(np.reshape(row.data, (56, 64)) - reference[8:64, 8:72]).mean()
    assert placed.first().field is not None
    assert miss[16] < 0.75 * miss[0]


def test_vignette_config_export_and_cleanup(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"img_{i}.fits").write_bytes(formats.write_fits(field(rng, i, -i).astype("f4"), {"EXPTIME": 30.0}))
    (tmp_path / "map.fits").write_bytes(formats.write_fits(np.full((9, 10), 100.0, "f4"), {}))
    vignette = run.load_vignette(spark, f"{tmp_path}/map.fits", *SHAPE)
    text = 'preset = "quick"\n[stacking]\nmethod = "median"\n[quality]\nthreshold = 1.0\n[other]\nthing = 3\n'
    plan = run.StackPlan.from_toml(text, formats=("fits",), weighted=False)
    assert (plan.combine, plan.quality_threshold, plan.clean, plan.weighted) == ("median", 1.0, (), False)
    out = f"{tmp_path}/out"
    result = run.stack_directory(spark, f"{tmp_path}/in", out, plan, vignette)
    image, _ = formats.read_fits(open(f"{out}/stack.fits", "rb").read())
    assert np.median(image) == pytest.approx(900, abs=3)
    cleaned = spark.read.parquet(f"{out}/phases-{plan.key()}/cleaned")
    names = sorted(r["name"] for r in run.export_frames(result, cleaned, f"{out}/blink", crop=(10, 60, 10, 70)).collect())
    assert names == [f"frame_0000{i}.fits" for i in range(3)]
    stack = [formats.read_fits(open(f"{out}/blink/{n}", "rb").read()) for n in names]
    assert all(a.shape == (50, 60) for a, _ in stack) and [h["FRAMEIDX"] for _, h in stack] == ["0", "1", "2"]
    assert np.corrcoef(stack[0][0].ravel(), stack[1][0].ravel())[0, 1] > 0.98
    assert run.export_frames(result, cleaned, f"{out}/png", "png").count() == 3
    assert run.stack_directory(spark, f"{tmp_path}/in", out, plan, vignette, keep_phases=False) == {}
    assert not os.path.exists(f"{out}/phases-{plan.key()}")


def test_any_layout_becomes_one_plane_or_three(spark, tmp_path):
    cube = np.stack([np.full((2, 4), v, "f4") for v in (100, 200, 50)])
    (tmp_path / "c.fits").write_bytes(formats.write_fits(cube, {}))
    (tmp_path / "m.fits").write_bytes(formats.write_fits(np.full((2, 4), 7, "f4"), {}))
    found = files.scan(spark, str(tmp_path))
    one = {r["path"][-6:]: r["data"] for r in files.luminance(found).collect()}
    assert one["c.fits"] == pytest.approx([0.299 * 100 + 0.587 * 200 + 0.114 * 50] * 8) and one["m.fits"] == [7] * 8
    assert [r["channels"] for r in files.rgb(found).collect()] == [3, 3]
    assert all(len(r["data"]) == 24 for r in files.rgb(found).collect())
