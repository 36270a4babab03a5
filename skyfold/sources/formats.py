"""Encoders and decoders of the frame formats: FITS, SER and XISF, as pure functions over bytes."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
from typing import Any

import numpy as np

from skyfold.sources import tiff

#: Fixed values of the formats.
_FITS_BLOCK = 2880
_FITS_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}
_SER_HEADER = 178
_SER_COLOURS = {0: "MONO", 8: "BAYER_RGGB", 9: "BAYER_GRBG", 10: "BAYER_GBRG", 11: "BAYER_BGGR", 100: "RGB", 101: "BGR"}
_XISF_TYPES = {"UInt8": "<u1", "UInt16": "<u2", "UInt32": "<u4", "Float32": "<f4", "Float64": "<f8"}


def fits_header(data: bytes) -> tuple[dict[str, str], int]:
    """Keywords of the primary header as text, and where the data begin."""
    header: dict[str, str] = {}
    at = 0
    while True:
        if at + _FITS_BLOCK > len(data):
            raise ValueError("FITS header without END")
        block = data[at : at + _FITS_BLOCK].decode("ascii", "replace")
        at += _FITS_BLOCK
        for i in range(0, _FITS_BLOCK, 80):
            card = block[i : i + 80]
            key = card[:8].strip()
            if key == "END":
                return header, at
            if card[8:10] == "= ":
                text = card[10:]
                quoted = re.match(r"\s*'((?:[^']|'')*)'", text)
                header.setdefault(key, quoted[1].replace("''", "'").rstrip() if quoted else text.split("/")[0].strip())


def read_fits(data: bytes) -> tuple[np.ndarray | None, dict[str, str]]:
    """Samples of the primary unit as float64, scaled; (…, height, width)."""
    header, at = fits_header(data)
    n = int(header.get("NAXIS", "0"))
    if not n:
        return None, header
    shape = [int(header[f"NAXIS{i}"]) for i in range(n, 0, -1)]
    kind = np.dtype(_FITS_TYPES[int(header["BITPIX"])])
    count = int(np.prod(shape))
    if at + count * kind.itemsize > len(data):
        raise ValueError("FITS data are cut off")
    raw = np.frombuffer(data, kind, count, at)
    out = raw.astype(np.float64) * float(header.get("BSCALE", "1")) + float(header.get("BZERO", "0"))
    if "BLANK" in header and kind.kind in "iu":
        out[raw == int(header["BLANK"])] = np.nan
    return out.reshape(shape), header


def write_fits(a: np.ndarray, keywords: dict[str, Any] | None = None) -> bytes:
    """A primary unit of 32-bit floats (64-bit where the samples need it)."""
    small = a.astype(">f4")
    a = small if np.array_equal(small.astype(np.float64), a.astype(np.float64), equal_nan=True) else a.astype(">f8")

    def card(key: str, value: Any) -> str:
        if isinstance(value, bool):
            text = f"{'T' if value else 'F':>20}"
        elif isinstance(value, (int, np.integer)):
            text = f"{value:>20d}"
        elif isinstance(value, float):
            text = f"{value!r:>20}".upper()
        else:
            text = "'" + str(value).replace("'", "''").ljust(8) + "'"
        return f"{key[:8].upper():<8}= {text}"[:80].ljust(80)

    cards = [card("SIMPLE", True), card("BITPIX", -32 if a.dtype.itemsize == 4 else -64), card("NAXIS", a.ndim), *(card(f"NAXIS{i + 1}", n) for i, n in enumerate(reversed(a.shape)))]
    cards += [card(k, v) for k, v in (keywords or {}).items()] + ["END".ljust(80)]
    head, body = "".join(cards).encode("ascii"), a.tobytes()
    return head + b" " * (-len(head) % _FITS_BLOCK) + body + b"\0" * (-len(body) % _FITS_BLOCK)


def ser_header(data: bytes) -> dict[str, Any]:
    if data[:14] != b"LUCAM-RECORDER":
        raise ValueError("no SER file")
    colour, little, width, height, bits, frames = struct.unpack("<6i", data[18:42])
    if colour not in _SER_COLOURS:
        raise ValueError(f"SER colour {colour} is not read")
    return {"colour": _SER_COLOURS[colour], "little_endian": bool(little), "width": width, "height": height, "bits": bits, "frames": frames, "observer": data[42:82].decode("latin1").strip("\0 ")}


def read_ser(data: bytes, index: int) -> np.ndarray:
    """One frame: (height, width) or (height, width, 3)."""
    h = ser_header(data)
    planes = 3 if h["colour"] in ("RGB", "BGR") else 1
    kind = np.dtype("u1" if h["bits"] <= 8 else "<u2" if h["little_endian"] else ">u2")
    count = h["width"] * h["height"] * planes
    if not 0 <= index < h["frames"] or _SER_HEADER + (index + 1) * count * kind.itemsize > len(data):
        raise ValueError("no such SER frame")
    a = np.frombuffer(data, kind, count, _SER_HEADER + index * count * kind.itemsize).astype(np.float64)
    a = a.reshape(h["height"], h["width"], planes) if planes == 3 else a.reshape(h["height"], h["width"])
    return a[..., ::-1] if h["colour"] == "BGR" else a


def write_ser(frames: np.ndarray, colour: int = 0, observer: str = "") -> bytes:
    """(n, height, width) samples of 8 or 16 bits."""
    n, h, w = frames.shape[:3]
    bits = 8 if frames.max(initial=0) < 256 else 16
    head = b"LUCAM-RECORDER" + struct.pack("<7i", 0, colour, 1, w, h, bits, n) + observer.encode("latin1")[:40].ljust(40) + b" " * 80 + bytes(16)
    return head + frames.astype("u1" if bits == 8 else "<u2").tobytes()


def xisf_header(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """Attributes of a monolithic file's first image, and its keywords."""
    if data[:8] != b"XISF0100":
        raise ValueError("no XISF file")
    size = struct.unpack("<I", data[8:12])[0]
    root = ET.fromstring(data[16 : 16 + size].rstrip(b"\0"))
    space = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    image = root.find(f"{space}Image")
    if image is None:
        raise ValueError("no image")
    return dict(image.attrib), {k.get("name", ""): k.get("value", "").strip("'").strip() for k in image.findall(f"{space}FITSKeyword")}


def read_xisf(data: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """First image of a monolithic file with an uncompressed attachment: (channels, height, width)."""
    image, words = xisf_header(data)
    if image.get("compression"):
        raise ValueError("no uncompressed image")
    width, height, channels = map(int, image.get("geometry", "").split(":"))
    where = image.get("location", "").split(":")
    if where[0] != "attachment":
        raise ValueError("only attached blocks are read")
    a = np.frombuffer(data, _XISF_TYPES[image.get("sampleFormat", "Float32")], width * height * channels, int(where[1])).astype(np.float64)
    a = a.reshape(height, width, channels).transpose(2, 0, 1) if image.get("pixelStorage", "Planar") == "Normal" else a.reshape(channels, height, width)
    return a, words


def write_xisf(a: np.ndarray, keywords: dict[str, Any] | None = None) -> bytes:
    """(channels, height, width) as planar 32-bit floats."""
    channels, height, width = a.shape
    body = a.astype("<f4").tobytes()
    start = 4096
    root = ET.Element("xisf", {"version": "1.0", "xmlns": "http://www.pixinsight.com/xisf"})
    image = ET.SubElement(root, "Image", {"geometry": f"{width}:{height}:{channels}", "sampleFormat": "Float32", "bounds": "0:1", "colorSpace": "RGB" if channels == 3 else "Gray", "location": f"attachment:{start}:{len(body)}"})
    for k, v in (keywords or {}).items():
        ET.SubElement(image, "FITSKeyword", {"name": k, "value": str(v), "comment": ""})
    xml = b'<?xml version="1.0" encoding="UTF-8"?>' + ET.tostring(root)
    if 16 + len(xml) > start:
        raise ValueError("too many keywords")
    return b"XISF0100" + struct.pack("<II", len(xml), 0) + xml + bytes(start - 16 - len(xml)) + body


def read_tiff(data: bytes) -> np.ndarray:
    """First page of a TIFF as float64: (height, width) or (height, width, channels); of more than three channels the first three."""
    order, found = tiff.directories(data)
    a = tiff.page_array(data, order, found[0])
    return a[..., 0] if a.shape[2] == 1 else a[..., :3]


def write_tiff(a: np.ndarray) -> bytes:
    """(channels, height, width) as planar 32-bit floats scaled to a peak of one."""
    channels, height, width = a.shape
    top = float(np.nanmax(a, initial=0)) or 1.0
    body = (a / top).astype("<f4").tobytes()
    plane = len(body) // channels
    many = channels > 1
    start = 8 + len(body)
    extra = start + 2 + 12 * 11 + 4
    rows = [
        (256, 4, 1, width), (257, 4, 1, height), (258, 3, channels, extra if channels > 2 else 32 | (32 << 16 if channels == 2 else 0)), (259, 3, 1, 1), (262, 3, 1, 2 if channels == 3 else 1),
        (273, 4, channels, extra + 16 if many else 8), (277, 3, 1, channels), (278, 4, 1, height), (279, 4, channels, extra + 48 if many else plane), (284, 3, 1, 2 if many else 1), (339, 3, channels, extra + 80 if channels > 2 else 3 | (3 << 16 if channels == 2 else 0)),
    ]
    tail = struct.pack("<8H", *[32] * 8) + struct.pack("<8I", *[8 + plane * i for i in range(8)]) + struct.pack("<8I", *[plane] * 8) + struct.pack("<8H", *[3] * 8)
    directory = struct.pack("<H", len(rows)) + b"".join(struct.pack("<HHII", *r) for r in rows) + bytes(4)
    return b"II" + struct.pack("<HI", 42, start) + body + directory + tail


def write_png(a: np.ndarray) -> bytes:
    """8-bit samples (height, width) or (height, width, 3) as PNG."""
    import zlib

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = a.shape[:2]
    rows = b"".join(b"\0" + a[y].astype("u1").tobytes() for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def preview(a: np.ndarray, stretch: str = "arcsinh", black_sigma: float = 1.0) -> np.ndarray:
    """8-bit preview of (channels, height, width): one black point and one white point for all channels, unless linear."""
    if stretch == "linear":
        low, high = np.maximum(np.percentile(a, 1, axis=(1, 2)), 0)[:, None, None], np.percentile(a, 99, axis=(1, 2))[:, None, None]
        v = np.clip((a - low) / np.maximum(high - low, 1e-12), 0, 1)
    else:
        middle = float(np.median(a))
        black = middle + black_sigma * 1.4826 * float(np.median(np.abs(a - middle)))
        v = np.clip((a - black) / max(float(np.percentile(a, 99.5)) - black, 1e-12), 0, 1)
        v = np.arcsinh(10 * v) / np.arcsinh(10)
    out = np.rint(v * 255).astype("u1")
    return out[0] if len(out) == 1 else out.transpose(1, 2, 0)
