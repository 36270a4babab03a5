"""The post-processing plan: shared masks, rules, stored steps, resuming and sidecars."""

from __future__ import annotations

import os

import numpy as np
import pytest

from skyfold.plans import post

SHAPE = (80, 96)


def image(stars: int = 25, nebula: bool = True, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.indices(SHAPE)
    a = 500 + 1.5 * x + rng.normal(0, 4, SHAPE)
    if nebula:
        a += 300 * np.exp(-((y - 40) ** 2 + (x - 50) ** 2) / (2 * 9.0**2))
    for _ in range(stars):
        a += rng.uniform(400, 4000) * np.exp(-((y - rng.uniform(10, 70)) ** 2 + (x - rng.uniform(10, 86)) ** 2) / (2 * 1.3**2))
    return a


def rows(**cubes: np.ndarray) -> list[tuple]:
    return [(k, len(c), *SHAPE, [float(v) for v in c.ravel()]) for k, c in cubes.items()]


IMAGE = "name string, channels int, height int, width int, data array<double>"


def test_masks_tell_stars_from_extended_light():
    found = post.survey(image()[None])
    assert found.facts["stars"] > 15 and 0.02 < found.facts["emission"] < 0.4
    assert found.emission_mask[40, 50] == 1 and found.emission_mask[:8].max() == 0
    assert post.survey(image(nebula=False)[None]).emission_mask[30:50, 40:60].mean() < 0.3
    empty = post.survey(np.full((1, 30, 30), 7.0))
    assert empty.facts["stars"] == 0 and empty.facts["emission"] == 0


def test_a_chain_skips_by_rule_and_writes_every_step(spark, tmp_path):
    colour = np.stack([image() * g for g in (0.8, 1.0, 0.6)])
    plain = np.random.default_rng(3).normal(100, 2, (1, *SHAPE))
    df = spark.createDataFrame(rows(colour=colour, plain=plain), IMAGE)
    steps = ["hot_pixels", "saturated", "flatten", "neutral_sky", "chroma", "cascade", "sharpen", "reduce_stars", "local_contrast"]
    out, done = post.run_chain(spark, df, ["name"], steps, f"{tmp_path}/work", sidecars=f"{tmp_path}/side")
    report = done.toDF("step", "what", "name", "skipped").collect()
    said = {(r["name"], r["what"]): r["skipped"] for r in report}
    assert said["plain", "chroma"] == "one plane" and said["plain", "sharpen"] == "too few stars" and said["colour", "chroma"] is None
    assert len(report) == 2 * len(steps)
    got = {r["name"]: np.reshape(r["data"], (r["channels"], *SHAPE)) for r in out.collect()}
    assert got["colour"].shape == colour.shape
    slope = lambda a: abs(np.median(a[:, :12]) - np.median(a[:, -12:]))
    assert slope(got["colour"][1]) < 0.4 * slope(colour[1])
    sky = [np.median(p[:12]) for p in got["colour"]]
    assert max(sky) - min(sky) < 0.1 * max(sky)
    names = os.listdir(tmp_path / "side")
    assert len([n for n in names if n.endswith(".png") and not n.startswith(".")]) == 2 * (len(steps) + 2)


def test_a_killed_chain_goes_on_after_its_last_step(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(rows(one=image()[None]), IMAGE)
    work, steps = str(tmp_path), ["hot_pixels", "flatten", "cascade", "local_contrast"]
    whole = post.apply_step
    monkeypatch.setattr(post, "apply_step", lambda i, k, keys, n: whole(i, k, keys, n) if n != "cascade" else (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        post.run_chain(spark, df, ["name"], steps, work)
    ran = []
    monkeypatch.setattr(post, "apply_step", lambda i, k, keys, n: ran.append(n) or whole(i, k, keys, n))
    first, _ = post.run_chain(spark, df, ["name"], steps, work)
    assert ran == ["cascade", "local_contrast"]
    assert first.count() == 1
    ran.clear()
    post.run_chain(spark, df, ["name"], steps, work)
    assert ran == []
    post.run_chain(spark, df, ["name"], steps, work, inputs="other")
    assert ran == steps
    with pytest.raises(ValueError):
        post.run_chain(spark, df, ["name"], ["nothing"], work)
