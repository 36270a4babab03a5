"""TIFF codecs, predictors, tiles and pages; raw mosaics with lossless JPEG against an encoder written here."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from skyfold.sources import frames as files
from skyfold.sources import raw, tiff


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["u1", "u2", "i4", "f4", "f8"])
@pytest.mark.parametrize(("compression", "predictor"), [(tiff.NONE, 1), (tiff.LZW, 1), (tiff.LZW, 2), (tiff.PACKBITS, 1), (tiff.DEFLATE, 2), (tiff.DEFLATE, 3), (tiff.LZW, 3)])
def test_every_codec_gives_the_samples_back(order, kind, compression, predictor):
    if (predictor == 3) != (kind[0] == "f") and predictor != 1:
        pytest.skip("no such predictor for this kind")
    rng = np.random.default_rng(1)
    for channels, tile, planar in ((1, 0, False), (3, 16, False), (2, 0, True), (3, 32, True)):
        a = (rng.normal(0, 50, (37, 41, channels)) + np.arange(41)[None, :, None] * 3 + 300)
        a[5:12] = 7
        pages = [np.clip(a, 0, 255).astype(kind) if kind == "u1" else a.astype(kind), a[:20].astype("u1").astype(kind)]
        back = tiff.pages(tiff.write(pages, compression, predictor, tile, planar, order))
        assert len(back) == 2 and all(np.array_equal(x, y) for x, y in zip(pages, back, strict=True))


def test_lzw_tables_grow_and_clear():
    rng = np.random.default_rng(2)
    for body in (b"", b"a", b"ab" * 9000, rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes(), rng.integers(0, 3, 60_000, dtype=np.uint8).tobytes()):
        assert tiff.unpack_lzw(tiff.pack_lzw(body)) == body
        assert tiff.unpack_packbits(tiff.pack_packbits(body)) == body
    assert tiff.unpack_lzw(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])  # the published example's codes


def test_what_is_unknown_or_cut_is_refused():
    good = tiff.write([np.zeros((20, 20, 1), "u2")])
    with pytest.raises(ValueError):
        tiff.pages(good[:100])
    with pytest.raises(ValueError):
        tiff.pages(b"nothing of the kind")
    broken = bytearray(good)
    at = struct.unpack("<I", good[4:8])[0] + 2
    for i in range(20):
        if struct.unpack_from("<H", broken, at + 12 * i)[0] == 259:
            struct.pack_into("<H", broken, at + 12 * i + 8, 34712)
            break
    with pytest.raises(ValueError, match="34712"):
        tiff.pages(bytes(broken))


def predict(a: np.ndarray, y: int, x: int, predictor: int, first: int) -> int:
    if y == 0:
        return first if x == 0 else int(a[0, x - 1])
    if x == 0:
        return int(a[y - 1, 0])
    left, above, corner = int(a[y, x - 1]), int(a[y - 1, x]), int(a[y - 1, x - 1])
    return [0, left, above, corner, left + above - corner, left + ((above - corner) >> 1), above + ((left - corner) >> 1), (left + above) >> 1][predictor]


def encode_jpeg(a: np.ndarray, predictor: int, precision: int, restart_lines: int = 0) -> bytes:
    """Lossless JPEG of (lines, columns, parts): sixteen-and-one difference sizes in one table of 5-bit codes."""
    height, width, parts = a.shape
    out = bytearray(b"\xff\xd8")
    put = lambda marker, body: out.extend(bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body)
    put(0xC4, bytes([0, 0, 0, 0, 0, 17, *[0] * 11]) + bytes(range(17)))
    put(0xC3, struct.pack(">BHHB", precision, height, width, parts) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(parts)))
    if restart_lines:
        put(0xDD, struct.pack(">H", restart_lines * width))
    put(0xDA, bytes([parts]) + b"".join(bytes([k + 1, 0]) for k in range(parts)) + bytes([predictor, 0, 0]))
    bits: list[str] = []

    def flush() -> bytes:
        text = "".join(bits)
        bits.clear()
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")

    for y in range(height):
        if restart_lines and y and y % restart_lines == 0:
            out += flush() + bytes([0xFF, 0xD0 + (y // restart_lines - 1) % 8])
        for x in range(width):
            for k in range(parts):
                own = a[y - y % restart_lines :, :, k] if restart_lines else a[..., k]
                d = (int(a[y, x, k]) - predict(own, y % restart_lines if restart_lines else y, x, predictor, 1 << (precision - 1))) & 0xFFFF
                if d == 32768:
                    bits.append(f"{16:05b}")
                    continue
                d -= 65536 if d > 32768 else 0
                size = abs(d).bit_length()
                bits.append(f"{size:05b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else ""))
    return bytes(out) + flush() + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_jpeg_of_every_predictor(predictor):
    rng = np.random.default_rng(predictor)
    for parts, precision, restart in ((1, 16, 0), (2, 14, 0), (4, 12, 2)):
        a = rng.integers(0, 1 << precision, (6, 9, parts))
        assert np.array_equal(raw.lossless_jpeg(encode_jpeg(a, predictor, precision, restart)), a)
    wrap = np.array([[[0], [32768], [0], [65535]], [[65535], [0], [32768], [1]]])
    assert np.array_equal(raw.lossless_jpeg(encode_jpeg(wrap, predictor, 16)), wrap)


def test_broken_streams_are_refused():
    whole = encode_jpeg(np.arange(400).reshape(20, 20, 1) * 7, 1, 14)
    for bad in (b"", whole[:10], b"\xff\xd8\xff\xd9", whole.replace(b"\xff\xc3", b"\xff\xc0")):
        with pytest.raises(ValueError):
            raw.lossless_jpeg(bad)


def dng(mosaic: np.ndarray, filters: str, black: list[int], white: int, active: tuple[int, int, int, int], tile: int, predictor: int = 1) -> bytes:
    """A tiled file with a preview first, the mosaic in a sub-directory, two components a tile line, and an exposure directory."""
    out = bytearray(b"II*\0" + bytes(4))
    height, width = mosaic.shape
    at, counts = [], []
    for y in range(0, height, tile):
        for x in range(0, width, tile):
            part = np.pad(mosaic[y : y + tile, x : x + tile], ((0, max(0, y + tile - height)), (0, max(0, x + tile - width))))
            body = encode_jpeg(part.reshape(tile, tile // 2, 2), predictor, 14)
            at.append(len(out))
            counts.append(len(body))
            out += body + bytes(len(body) % 2)
    exif = tiff.write_directory(out, [(33434, 5, [(1, 4)]), (34855, 3, [800])], "<")
    cfa = [(254, 4, [0]), (256, 4, [width]), (257, 4, [height]), (258, 3, [14]), (259, 3, [7]), (262, 3, [32803]), (277, 3, [1]), (322, 4, [tile]), (323, 4, [tile]), (324, 4, at), (325, 4, counts), (33421, 3, [2, 2]), (33422, 1, ["RGB".index(c) for c in filters]), (50713, 3, [2, 2]), (50714, 3, black), (50717, 4, [white]), (50829, 4, list(active))]
    sub = tiff.write_directory(out, cfa, "<")
    small = len(out)
    out += bytes(12)
    main = tiff.write_directory(out, [(254, 4, [1]), (256, 4, [2]), (257, 4, [2]), (258, 3, [8, 8, 8]), (259, 3, [1]), (262, 3, [2]), (271, 2, b"Maker\0"), (272, 2, b"Model X\0"), (273, 4, [small]), (277, 3, [3]), (278, 4, [2]), (279, 4, [12]), (330, 4, [sub]), (34665, 4, [exif])], "<")
    out[4:8] = struct.pack("<I", main)
    return bytes(out)


@pytest.mark.parametrize("margin", [(0, 0), (1, 0), (2, 3)])
def test_mosaics_are_exact_and_patterns_follow_the_margins(spark, tmp_path, margin):
    rng = np.random.default_rng(5)
    top, left = margin
    mosaic = rng.integers(60, 4000, (37, 44))
    data = dng(mosaic, "RGGB", [50, 51, 52, 53], 4095, (top, left, 36, 43), 16, predictor=6)
    a, header = raw.read(data)
    visible = mosaic[top:36, left:43]
    level = np.tile([[50, 51], [52, 53]], (20, 24))[: visible.shape[0], : visible.shape[1]]
    assert np.allclose(a * (4095 - 53), np.maximum(visible - level, 0))
    cells = np.array([["R", "G"], ["G", "B"]])
    assert header["BAYERPAT"] == "".join(cells[(top + y) % 2, (left + x) % 2] for y in (0, 1) for x in (0, 1))
    assert (header["EXPTIME"], header["ISO"], header["INSTRUME"], header["TELESCOP"], header["NAXIS1"]) == ("0.25", "800", "Model X", "Maker", str(43 - left))
    (tmp_path / "img.dng").write_bytes(data)
    (tmp_path / "other.nef").write_bytes(b"II*\0" + bytes(40))
    rows = {r["path"][-3:]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert np.allclose(rows["dng"]["data"], a.ravel()) and rows["nef"]["data"] is None and "UNREAD" in rows["nef"]["header"]
    scanned = {r["path"][-3:]: r["header"] for r in files.scan(spark, str(tmp_path), samples=False).collect()}
    assert scanned["dng"] == header


def test_pages_and_channels_of_a_scan(spark, tmp_path):
    two, three = np.arange(40).reshape(4, 5, 2), np.arange(60).reshape(4, 5, 3)
    (tmp_path / "a.tif").write_bytes(tiff.write([two.astype("u2"), two[::-1].astype("u2"), three.astype("u2")], tiff.LZW, 2, 16))
    (tmp_path / "narrow.tif").write_bytes(tiff.write([np.arange(12).reshape(4, 3, 1).astype("f4")]))
    rows = {(r["path"].split("/")[-1], r["frame_index"]): r for r in files.scan(spark, str(tmp_path)).collect()}
    assert [(rows["a.tif", i]["channels"], rows["a.tif", i]["height"], rows["a.tif", i]["width"]) for i in range(3)] == [(2, 4, 5), (2, 4, 5), (3, 4, 5)]
    assert rows["a.tif", 1]["data"] == two[::-1].transpose(2, 0, 1).ravel().tolist()
    assert (rows["narrow.tif", 0]["channels"], rows["narrow.tif", 0]["width"]) == (1, 3)
    assert raw.read(raw.write_dng(np.full((4, 6), 1200), "GBRG", 200, 1200, 2.5, 400))[1]["EXPTIME"] == "2.5"
