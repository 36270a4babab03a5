"""Frame formats: exact round trips, damaged files, sidecars and discovery."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pytest

from skyfold.sources import formats
from skyfold.sources import frames as files


def test_fits_round_trip_and_scaling():
    a = np.random.default_rng(0).normal(1000, 30, (3, 5, 7))
    back, header = formats.read_fits(formats.write_fits(a, {"OBJECT": "M 31's", "EXPTIME": 30.0, "RAWSTACK": True, "NFRAMES": 7}))
    assert np.array_equal(back, a)
    assert (header["OBJECT"], float(header["EXPTIME"]), header["RAWSTACK"], header["NFRAMES"]) == ("M 31's", 30.0, "T", "7")
    whole, _ = formats.read_fits(formats.write_fits(np.rint(a[0])))
    assert np.array_equal(whole, np.rint(a[0]))
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    1", "NAXIS1  =                    3", "BZERO   =                32768", "BLANK   =               -32768", "END"]
    raw = "".join(c.ljust(80) for c in cards).encode().ljust(2880) + np.array([0, -32768, 5], ">i2").tobytes()
    values, _ = formats.read_fits(raw)
    assert values[0] == 32768 and np.isnan(values[1]) and values[2] == 32773
    with pytest.raises(ValueError):
        formats.read_fits(raw[:2881])
    with pytest.raises(ValueError):
        formats.fits_header(b"nothing")


@pytest.mark.parametrize("high", [200, 60_000])
def test_ser_round_trip(high):
    a = np.random.default_rng(1).integers(0, high, (4, 6, 5)).astype(float)
    data = formats.write_ser(a, 8, "me")
    assert formats.ser_header(data)["colour"] == "BAYER_RGGB" and formats.ser_header(data)["frames"] == 4
    assert all(np.array_equal(formats.read_ser(data, i), a[i]) for i in range(4))
    with pytest.raises(ValueError):
        formats.read_ser(data, 4)
    with pytest.raises(ValueError):
        formats.ser_header(data[:18] + (17).to_bytes(4, "little") + data[22:])


def test_xisf_and_tiff_round_trip():
    a = np.random.default_rng(2).random((3, 6, 5)).astype("f4").astype(float)
    back, words = formats.read_xisf(formats.write_xisf(a, {"OBJECT": "M 42"}))
    assert np.array_equal(back, a) and words["OBJECT"] == "M 42"
    for channels in (1, 3):
        t = formats.read_tiff(formats.write_tiff(a[:channels]))
        assert np.allclose(t if channels == 1 else t.transpose(2, 0, 1), (a[:channels] / a[:channels].max())[0 if channels == 1 else slice(None)], atol=1e-6)
    with pytest.raises(ValueError):
        formats.read_xisf(b"XISF0000")
    with pytest.raises(ValueError):
        formats.read_tiff(b"II\0\0")


def test_png_preview():
    a = np.random.default_rng(3).random((3, 6, 5))
    png = formats.write_png(formats.preview(a))
    at = png.index(b"IDAT")
    size = int.from_bytes(png[at - 4 : at])
    assert len(zlib.decompress(png[at + 4 : at + 4 + size])) == 6 * (1 + 15)
    assert formats.preview(a, "linear").shape == (6, 5, 3)


def test_scan_discover_and_sidecars(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4)
    (tmp_path / "dark_1.fits").write_bytes(formats.write_fits(a, {"EXPTIME": 10.0}))
    (tmp_path / "img_2.fits").write_bytes(formats.write_fits(a, {"EXPTIME": 30.0}))
    (tmp_path / "img_3.fits").write_bytes(formats.write_fits(a, {"EXPTIME": 0.0}))
    (tmp_path / "video.ser").write_bytes(formats.write_ser(np.stack([a, a + 1])))
    (tmp_path / "old.fits").write_bytes(formats.write_fits(a, {"COMBINED": True}))
    (tmp_path / "img_2.json").write_text(json.dumps({"iso": 800, "exposureTimeMS": 5000, "bayerPattern": "rggb"}))
    found = files.scan(spark, str(tmp_path)).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["frame_index"]) for r in found) == [("dark_1.fits", 0), ("img_2.fits", 0), ("img_3.fits", 0), ("old.fits", 0), ("video.ser", 0), ("video.ser", 1)]
    assert all(list(r["data"])[:12] == (a + r["frame_index"]).ravel().tolist() for r in found)
    kinds = {r["path"].rsplit("/", 1)[1]: r["frame_type"] for r in files.discover(spark, str(tmp_path)).collect()}
    assert kinds == {"dark_1.fits": "dark", "img_2.fits": "light", "img_3.fits": "bias", "video.ser": "light"}
    headers = {r["path"].rsplit("/", 1)[1]: r["header"] for r in files.with_sidecars(files.discover(spark, str(tmp_path)), files.sidecars(spark, str(tmp_path))).collect()}
    assert headers["img_2.fits"]["ISOSPEED"] == "800" and headers["img_2.fits"]["BAYERPAT"] == "RGGB" and float(headers["img_2.fits"]["EXPTIME"]) == 30.0


def test_session_info_and_config(spark, tmp_path):
    (tmp_path / "session.json").write_text(json.dumps({"objectName": "later"}))
    (tmp_path / "info.json").write_text(json.dumps({"StackedInfo": {"objectName": "M 31", "stackedDepth": "12", "fovX": "bad", "celestial": {"first": 0.1}}}))
    r = files.session_info(spark, str(tmp_path)).first()
    assert (r["object"], r["depth"], r["fov_x"], r["ra"]) == ("M 31", 12, None, 0.1)
    assert files.effective_config({"b": 1, "a": "x", "c": None}) == 'a = "x"\nb = 1\n'


def test_header_scan_reads_ranges(spark, tmp_path):
    a = np.random.default_rng(6).random((3, 200, 180)).astype("f4").astype(float)
    many = {f"KEY{i}": i for i in range(900)}  # a header longer than the first part
    (tmp_path / "a.fits").write_bytes(formats.write_fits(a, many))
    (tmp_path / "b.xisf").write_bytes(formats.write_xisf(a, {"OBJECT": "M 42"}))
    (tmp_path / "c.tif").write_bytes(formats.write_tiff(a))
    (tmp_path / "d d.ser").write_bytes(formats.write_ser(np.rint(a * 1000), 8))
    plain = lambda rows: sorted((r["path"], r["frame_index"], r["format"], tuple(sorted(r["header"].items()))) for r in rows)
    heads = files.scan(spark, str(tmp_path), samples=False)
    assert "content" not in heads._jdf.queryExecution().executedPlan().toString().split("FileScan")[1].split("ReadSchema")[1]
    found = heads.collect()
    assert len(found) == 6 and all(r["data"] is None for r in found)
    assert plain(found) == plain(files.scan(spark, str(tmp_path)).collect())
    assert dict(plain(found)[0][3])["KEY899"] == "899"
