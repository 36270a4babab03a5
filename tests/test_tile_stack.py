"""The live tile stack: two batches equal one, work follows the new frames, restarts go on, gates refuse."""

from __future__ import annotations

import glob

import numpy as np
import pytest

from skyfold.operators import combine as C
from skyfold.plans import run
from skyfold.streaming import tile_stack as L
from skyfold.streaming.session import Masters

SHAPE = (72, 80)


def field(rng, dy: float = 0.0, dx: float = 0.0, sky: float = 1000.0) -> np.ndarray:
    stars = np.random.default_rng(9)
    y, x = np.indices(SHAPE)
    a = np.full(SHAPE, sky)
    for sy, sx, flux in np.column_stack([stars.uniform(14, 58, 40), stars.uniform(14, 66, 40), stars.uniform(1500, 4000, 40)]):
        a += flux * np.exp(-((y - sy - dy) ** 2 + (x - sx - dx) ** 2) / (2 * 1.5**2))
    return a + rng.normal(0, 4, SHAPE)


def arrivals(start: int, n: int, session: int = 1) -> list[tuple]:
    rng = np.random.default_rng(start + 1)
    shifts = [(0, 0) if start + i == 0 else tuple(int(v) for v in rng.integers(-3, 4, 2)) for i in range(n)]
    out = []
    for i, s in enumerate(shifts):
        a = field(rng, *s)
        a[30, 40] += 3e4 if start + i == 2 else 0  # a hit inside the burn-in
        out.append((session, 100 * session + start + i, start + i, 0, *SHAPE, 30.0, [float(v) for v in a.ravel()]))
    return out


class Session:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def arrive(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, L.FRAME).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def go(self, **options) -> dict[tuple, tuple]:
        plan = run.StackPlan(clean=())
        tiles = L.advance(self.spark, self.spark.readStream.schema(L.FRAME).parquet(f"{self.folder}/in"), Masters(), plan, f"{self.folder}/live", **options)
        return {(r["session"], r["y"], r["x"]): (r["value"], r["n_used"]) for r in L.to_pixels(tiles).collect()}

    def count(self, table: str, where: str = "true") -> int:
        return self.spark.read.parquet(f"{self.folder}/live/{table}").filter(where).count()


def test_two_batches_equal_one_and_work_follows_the_new_frames(spark, tmp_path):
    one, two = Session(spark, tmp_path / "one"), Session(spark, tmp_path / "two")
    dark = (1, 199, 6, 0, *SHAPE, 30.0, [1000.0] * (SHAPE[0] * SHAPE[1]))
    small = (1, 198, 7, 0, 40, 40, 30.0, [float(v) for v in field(np.random.default_rng(3))[:40, :40].ravel()])
    first, second = [*arrivals(0, 4), dark, small], [*arrivals(4, 3), *arrivals(0, 2, 2)]
    one.arrive(first + second)
    whole = one.go()
    two.arrive(first)
    part = two.go()
    assert set(part) < set(whole)
    two.arrive(second)
    both = two.go()
    assert set(both) == set(whole)
    assert all(both[k][0] == pytest.approx(whole[k][0], abs=1e-9) and both[k][1] == whole[k][1] for k in whole)
    # the second call measured, placed and cut its own frames only; the session's reference stayed
    assert two.count("measured", "batch = 1") == 5 and two.count("placements", "batch = 1") == 5
    assert two.count("references", "batch = 1 AND session = 1") == 0 and two.count("references") == 2
    blocks = spark.read.parquet(f"{two.folder}/live/blocks").groupBy("batch").agg({"frame_id": "count"}).collect()
    assert {r[0]: r[1] for r in blocks} == {0: 4 * 4, 1: 5 * 4}  # four tiles a frame
    refused = {r["frame_id"] for r in spark.read.parquet(f"{two.folder}/live/placements").filter("NOT accepted").collect()}
    assert refused == {198, 199}
    # nothing new: nothing is written
    before = sorted(glob.glob(f"{two.folder}/live/tiles/*"))
    assert two.go() == both and sorted(glob.glob(f"{two.folder}/live/tiles/*")) == before
    assert abs(both[1, 30, 40][0] - field(np.random.default_rng(0))[30, 40]) < 60  # the hit is rejected


def test_a_batch_that_broke_off_is_run_again(spark, tmp_path, monkeypatch):
    s = Session(spark, tmp_path)
    s.arrive(arrivals(0, 3))
    whole = L.I.warp_tiles
    monkeypatch.setattr(L.I, "warp_tiles", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        s.go()
    monkeypatch.setattr(L.I, "warp_tiles", whole)
    assert {n for _, n in s.go().values()} <= {1, 2, 3}
    assert s.count("measured") == 3 and s.count("references") == 1


def test_tiles_fold_like_rows(spark, tmp_path):
    """Without registration the stack is the online clip of the samples, across batches, burn-in and missing samples."""
    rng = np.random.default_rng(8)
    a = rng.normal(100, 3, (25, 6, 7))
    a[rng.random(a.shape) < 0.1] += 80
    a[rng.random(a.shape) < 0.2] = np.nan
    a[:, 0, 0] = np.nan
    a[9:, 0, 1] = np.nan
    rows = [(5, i, i, 0, 6, 7, 1.0, [float(v) for v in a[i].ravel()]) for i in range(25)]
    s = Session(spark, tmp_path)
    for part in (rows[:4], rows[4:13], rows[13:]):
        s.arrive(part)
        got = s.go(register=False, size=4)
    px = spark.createDataFrame([(int(y), int(x), i, float(a[i, y, x])) for i in range(25) for y in range(6) for x in range(7)], "y int, x int, seq int, v double")
    expected = {(5, r["y"], r["x"]): (r["value"], r["n_used"]) for r in C.online_clip(px, ["y", "x"]).collect() if r["n_used"]}
    assert set(got) == set(expected)
    assert all(got[k][0] == pytest.approx(expected[k][0], abs=1e-9) and got[k][1] == expected[k][1] for k in expected)
