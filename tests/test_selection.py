"""The gate's stages and switches, reference choice and matching at their edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyfold.functions import scalars as S
from skyfold.operators import matching as J
from skyfold.operators import metrics as M
from skyfold.operators import selection as G

COLUMNS = "s int, f int, snr double, star_count int, contrast double, dynamic_range double, score double"


def gate(spark, rows, **options):
    return {r["f"]: r["reject_reason"] for r in G.quality_gate(spark.createDataFrame(rows, COLUMNS), ["s"], **options).collect()}


def test_hard_limits_come_first_and_in_order(spark):
    rows = [(0, 0, 9.0, 20, 50.0, 100.0, 90.0), (0, 1, 0.1, 0, 1.0, 1.0, 90.0), (0, 2, 0.1, 5, 50.0, 100.0, 90.0), (0, 3, 9.0, 5, 1.9, 100.0, 90.0), (0, 4, 9.0, 5, 2.0, 19.0, 90.0)]
    got = gate(spark, rows)
    assert got == {0: None, 1: "no stars detected", 2: "extremely low SNR", 3: "extremely low contrast", 4: "extremely low dynamic range"}
    assert gate(spark, rows, stages=()) == dict.fromkeys(range(5))


def test_statistics_need_more_than_three_frames_and_two_outliers(spark):
    same = [(0, i, 10.0, 20, 50.0, 100.0, 90.0) for i in range(12)]
    odd = (0, 99, 2.0, 2, 50.0, 100.0, 90.0)
    assert gate(spark, [*same, odd], stages=("statistical",))[99] == "statistical outlier"
    assert gate(spark, [*same, (0, 99, 2.0, 20, 50.0, 100.0, 90.0)], stages=("statistical",))[99] is None
    assert gate(spark, [*same[:2], odd], stages=("statistical",), sigma=0.1)[99] is None


def test_reference_score_is_the_maximum_below_ten_frames(spark):
    def scores(n):
        return [(0, i, 10.0, 20, 50.0, 100.0, 40.0 if i else 100.0) for i in range(n)]

    assert gate(spark, scores(9), stages=("percentile",))[1] == "score below reference"
    assert gate(spark, scores(12), stages=("percentile",))[1] is None


def test_reason_categories_by_order(spark):
    rows = spark.createDataFrame([("score 3 < 5",), ("statistical outlier: contrast",), ("extremely low contrast",), ("no stars detected",), ("load error",), ("odd",), (None,)], "r string")
    assert [r[0] for r in rows.select(G.reason_category(F.col("r"))).collect()] == ["Below quality threshold", "Statistical outlier", "Poor quality", "No stars detected", "Load/data errors", "Other", None]


def test_crop_dither_and_references(spark):
    shifts = spark.createDataFrame([(0, i, float(y), float(x), float(sc)) for i, (y, x, sc) in enumerate([(0, 0, 5), (3.2, -1.5, 9), (-2.1, 4.7, 9), (0.4, 0.2, 1)])], "s int, f long, dy double, dx double, score double")
    crop = G.common_crop(shifts, ["s"], 100, 80).first()
    assert (crop["top"], crop["bottom"], crop["left"], crop["right"]) == (6, 95, 7, 76)
    assert G.common_crop(shifts.withColumn("dy", F.col("dy") * 100), ["s"], 100, 80).first()["bottom"] == 100  # empty: the whole frame
    assert G.dither(shifts.filter("f < 2"), ["s"], "f").first()["pattern"] == "aligned"
    assert G.consensus_reference(shifts, ["s"], "f").first()["f"] in (0, 3)
    tie = shifts.withColumns({"dy": F.lit(0.0), "dx": F.lit(0.0), "score": F.lit(1.0)})
    assert G.reference_frame(tie, ["s"], "f").first()["f"] == 0
    assert G.shift_outliers(shifts.withColumn("dy", F.when(F.col("f") == 1, 500.0).otherwise(F.col("dy"))), ["s"]).filter("not shift_ok").collect()[0]["f"] == 1


def test_nearest_stars_and_bands(spark):
    stars = spark.createDataFrame([(0, 1.0, 1.0), (0, 5.0, 5.0), (0, 40.0, 40.0)], "s int, y double, x double")
    ref = spark.createDataFrame([(0, 1.5, 1.0), (0, 2.9, 1.0), (0, 5.0, 8.0), (1, 5.0, 5.0)], "s int, ry double, rx double")
    got = {(r["y"], r["ry"]): r["distance"] for r in J.nearest_stars(stars, ref, ["s"], 3.0).collect()}
    assert got == {(1.0, 1.5): 0.5, (5.0, 5.0): 3.0}
    pairs = spark.createDataFrame([(0, 1.0), (0, 2.0)], "s int, length double")
    lengths = spark.createDataFrame([(0, 1.2), (0, 1.3), (0, 2.25)], "s int, r_length double")
    assert sorted((r["length"], r["r_length"]) for r in J.equal_distance_pairs(pairs, lengths, ["s"], 0.25).collect()) == [(1.0, 1.2), (2.0, 2.25)]


def test_cone_search_crosses_the_pole_and_the_meridian(spark):
    sky = spark.createDataFrame([(1, 359.9, 0.0), (2, 10.0, 89.9), (3, 180.0, 0.0)], "id int, ra double, dec double")
    cones = spark.createDataFrame([(0, 0.1, 0.0), (1, 190.0, 89.9)], "cone int, ra0 double, dec0 double")
    assert sorted((r["cone"], r["id"]) for r in J.cone_search(sky, cones, 0.5).collect()) == [(0, 1), (1, 2)]


def test_merge_and_resume(spark):
    a = spark.createDataFrame([(0, 0, 10.0, 2), (0, 1, 20.0, 2)], "y int, x int, value double, frames long")
    b = spark.createDataFrame([(0, 1, 40.0, 6), (0, 2, 5.0, 6)], "y int, x int, value double, frames long")
    got = {r["x"]: (r["value"], r["frames"]) for r in J.merge_stacks(a, b, ["y", "x"]).collect()}
    assert got == {0: (10.0, 2), 1: (35.0, 8), 2: (5.0, 6)}
    paths = spark.createDataFrame([("a",), ("b",), ("b",)], "p string")
    assert J.same_paths(paths, paths.distinct(), "p").first()["can_resume"]
    assert J.same_paths(paths, paths.filter("p = 'a'"), "p").first()["differing"] == 1
    assert [r["p"] for r in J.unseen(paths, paths.filter("p = 'b'"), "p").collect()] == ["a"]


def test_scores_and_scalars(spark):
    one = spark.range(1)
    score = lambda *v: one.select(M.quality_score(*[F.lit(float(x)) for x in v])).first()[0]
    assert score(2, 50, 2) == 100 and abs(score(2, 50, 100) - 10) < 1e-9 and score(-1, 50, 2) == 0
    pick = lambda c: one.select(c).first()[0]
    assert pick(S.normalize_id(F.lit("ngc  0224"))) == "NGC 224" and pick(S.circular_difference(F.lit(350.0), F.lit(10.0))) == -20
    assert pick(S.hms(F.lit(3661.9))) == "01:01:01" and pick(S.slug(F.lit("  M 31: Core!"))) == "m-31-core"
    assert pick(S.compass(F.lit(-90.0))) == "W" and pick(S.strip_date(F.lit("M51_2026-07-01"))) == "M51"
    assert pick(S.hyperbolic_stretch(F.lit(0.5), 0.0, 1.0, 0.0, 0.2)) == 0.5
    assert pick(S.virtual_frame(F.lit("/a/b.ser::7"))[1]) == 7 and pick(S.virtual_frame(F.lit("/a/b.fits"))[1]) is None


def test_match_flats(spark):
    lights = spark.createDataFrame([("a", "R", "10x10"), ("a", "R", "10x10"), ("a", "G", "8x8"), ("b", None, "10x10")], "camera string, filter string, dims string")
    flats = spark.createDataFrame([(1, "a", "r", "10x10"), (2, "a", "R", None), (3, "a", "R", "8x8"), (4, "a", None, "10x10"), (5, "a", "G", "10x10"), (6, "b", "G", "10x10"), (7, "b", None, "8x8")], "id int, camera string, filter string, dims string")
    found = J.match_flats(lights, flats, ["camera"])
    assert sorted((r["id"], r["score"]) for r in found.collect()) == [(1, 50), (2, 50), (6, 0)]
    assert J.match_flats(lights, flats.limit(0), ["camera"]).count() == 0


def test_target_inference_takes_page_numbers_of_any_length(spark, tmp_path):
    import duckdb

    from skyfold.plans import targets as P

    urls = ["http://blog.tionble.example.com/en/9366/", "https://ththhe.example.com/es/98062?page=2", "https://blog.ththth.example.org/en/0224466#top", "http://m.therha.org/about", "http://tion.net/about"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r[c] for c in ("page_id", "source", "target", "confidence")) for r in P.target_inference(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(P.ORACLE_SQL["target_inference"]).fetchall())
    assert [t for _, _, t, _ in got] == ["NGC 9366", "NGC 98062", "NGC 224466", "NGC 7000"]
    # the default stays with the catalogues' own numbers
    assert spark.range(1).select(S.catalog_ids(F.lit("NGC 7000 M31 NGC 98062"))).first()[0] == ["NGC 7000", "M31"]
