"""Camera raw files of the TIFF/EP family (DNG and its relatives): header scan and mosaic.

The directory walk goes through the chain, its sub-directories and the exposure directory; the mosaic is the largest image with a
colour filter layout. Its strips or tiles are uncompressed, deflated or lossless JPEG (Huffman codes of differences, predictors
1 to 7, one to four components, restarts). The active area is cut out, the filter pattern moved by odd margins, black levels
taken off each filter phase and the rest divided by the range up to the white level. Other raw families are refused.
"""

from __future__ import annotations

import numpy as np

from skyfold.sources import tiff
from skyfold.sources.tiff import Directory

# fixed values: tags
_SUB, _EXIF, _CFA_SIZE, _CFA, _BLACK_SIZE, _BLACK, _WHITE, _ACTIVE, _LINEAR = 330, 34665, 33421, 33422, 50713, 50714, 50717, 50829, 50712
_EXPOSURE, _ISO, _ISO_LONG = 33434, 34855, 34867
_COLOURS = "RGBCMYW"


def walk(data: bytes) -> tuple[str, list[Directory]]:
    """All directories: the chain, its sub-directories and the exposure directory, each one once."""
    order, todo = tiff.directories(data)
    out, seen = [], set()
    while todo:
        d = todo.pop(0)
        if d.at in seen:
            continue
        seen.add(d.at)
        out.append(d)
        for tag in (_SUB, _EXIF):
            for at in d.tags.get(tag, []):
                if isinstance(at, int) and at not in seen and 8 <= at < len(data) - 2:
                    todo.append(tiff.read_directory(data, at, order)[0])
    return order, out


def _mosaic(found: list[Directory]) -> Directory:
    images = [d for d in found if _CFA in d.tags and d.number(256) and d.number(277, 1) == 1]
    if not images:
        raise ValueError("no colour filter mosaic in this file")
    return max(images, key=lambda d: d.number(256) * d.number(257))


def _area(page: Directory) -> tuple[int, int, int, int]:
    """Top, left, bottom and right of the visible samples."""
    whole = (0, 0, page.number(257), page.number(256))
    found = page.tags.get(_ACTIVE)
    return tuple(int(v) for v in found) if isinstance(found, list) and len(found) == 4 else whole


def pattern(page: Directory) -> str:
    """Filters of the visible area's first 2 x 2 samples, by lines."""
    if page.tags.get(_CFA_SIZE, [2, 2]) != [2, 2]:
        raise ValueError("only 2 x 2 filter layouts are read")
    top, left, *_ = _area(page)
    cells = np.array(page.tags[_CFA][:4]).reshape(2, 2)
    return "".join(_COLOURS[c] for c in np.roll(cells, (-(top % 2), -(left % 2)), (0, 1)).ravel())


def header(data: bytes) -> dict[str, str]:
    """Keywords of a raw file, without its samples."""
    _, found = walk(data)
    page = _mosaic(found)
    top, left, bottom, right = _area(page)
    out = {"IMAGETYP": "Light Frame", "NAXIS": "2", "NAXIS1": str(right - left), "NAXIS2": str(bottom - top), "BAYERPAT": pattern(page)}
    out["COLORTYP"] = out["BAYERPAT"]
    for d in found:
        if d.tags.get(_EXPOSURE):
            out.setdefault("EXPTIME", repr(float(d.tags[_EXPOSURE][0])))
        for tag in (_ISO, _ISO_LONG):
            if d.tags.get(tag):
                out.setdefault("ISO", str(int(d.tags[tag][0])))
                out.setdefault("ISOSPEED", out["ISO"])
        for tag, name in ((272, "INSTRUME"), (271, "TELESCOP")):
            if isinstance(d.tags.get(tag), str) and d.tags[tag]:
                out.setdefault(name, d.tags[tag])
    return out


def read(data: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """Mosaic (height, width) from 0 to about 1, and the keywords."""
    order, found = walk(data)
    page = _mosaic(found)
    width, height = page.number(256), page.number(257)
    out = np.zeros((height, width))
    for _, y, x, lines, per_line, body in tiff.pieces(data, page):
        if page.number(259, 1) == tiff.JPEG:
            part = lossless_jpeg(body)
            part = part.reshape(part.shape[0], -1)  # components lie side by side in a line
            if part.size != lines * per_line and part.shape != (lines, per_line):
                raise ValueError("a tile's size differs from its directory's")
            part = part.reshape(lines, per_line)
        else:
            part = tiff.samples(body, order, page, lines, per_line, 1)[..., 0]
        out[y : y + lines, x : x + per_line] = part[: height - y, : width - x]
    if isinstance(page.tags.get(_LINEAR), list):  # a table from stored to linear values
        table = np.array(page.tags[_LINEAR], float)
        out = table[np.minimum(out.astype(int), len(table) - 1)]
    top, left, bottom, right = _area(page)
    out = out[top:bottom, left:right]
    rows, columns = (page.tags.get(_BLACK_SIZE) or [1, 1])[:2]
    black = np.array(page.tags.get(_BLACK) or [0.0], float)[: rows * columns].reshape(rows, columns)
    # levels repeat from the visible area's first sample
    level = np.tile(black, (-(-out.shape[0] // rows), -(-out.shape[1] // columns)))[: out.shape[0], : out.shape[1]]
    white = float((page.tags.get(_WHITE) or [(1 << page.number(258, 16)) - 1])[0])
    scale = white - float(black.max())
    return np.maximum(out - level, 0) / (scale if scale > 0 else 1.0), header(data)


def write_dng(mosaic: np.ndarray, filters: str = "RGGB", black: float = 0.0, white: int = 65535, exposure: float | None = None, iso: int | None = None) -> bytes:
    """A mosaic (height, width) of 16-bit samples as an uncompressed file."""
    out = bytearray(b"II*\0" + bytes(4))
    height, width = mosaic.shape
    body = np.ascontiguousarray(mosaic, "<u2").tobytes()
    at = len(out)
    out += body
    exif = [(_EXPOSURE, 5, [(round(exposure * 1_000_000), 1_000_000)])] if exposure is not None else []
    exif += [(_ISO, 3, [iso])] if iso is not None else []
    where = tiff.write_directory(out, exif, "<") if exif else 0
    rows = [
        (254, 4, [0]), (256, 4, [width]), (257, 4, [height]), (258, 3, [16]), (259, 3, [tiff.NONE]), (262, 3, [32803]), (273, 4, [at]), (277, 3, [1]), (278, 4, [height]), (279, 4, [len(body)]),
        (_CFA_SIZE, 3, [2, 2]), (_CFA, 1, [_COLOURS.index(c) for c in filters]), *([(_EXIF, 4, [where])] if where else []), (50706, 1, [1, 4, 0, 0]), (_BLACK, 5, [(round(black * 1000), 1000)]), (_WHITE, 4, [white]),
    ]
    here = tiff.write_directory(out, rows, "<")
    out[4:8] = here.to_bytes(4, "little")
    return bytes(out)


class _Bits:
    """Bits of entropy-coded data, high bit first, without stuffed zero bytes."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self, least: int) -> None:
        while self.n < least:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.held = (self.held << 8 | byte) & 0xFFFFFFFFFF
            self.n += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.fill(n)
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)


def _table(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits."""
    out: list[tuple[int, int]] = []
    k = 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out += [(length, symbols[k])] * (1 << (16 - length))
            k += 1
    if len(out) > 1 << 16:
        raise ValueError("broken Huffman table")
    return out + [(0, 0)] * ((1 << 16) - len(out))


def lossless_jpeg(data: bytes) -> np.ndarray:
    """(lines, columns, components) of a lossless JPEG stream."""
    if bytes(data[:2]) != b"\xff\xd8":
        raise ValueError("no JPEG stream")
    tables: dict[int, list] = {}
    at, restart, frame = 2, 0, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = bytes(data[at + 4 : at + 2 + size])
        if marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xC3:
            frame = (body[0], int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5], [body[6 + 3 * k] for k in range(body[5])])
        elif marker in (0xC0, 0xC1, 0xC2):
            raise ValueError("a JPEG stream that loses data is no mosaic")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            break
        at += 2 + size
    else:
        raise ValueError("no scan in the JPEG stream")
    if frame is None:
        raise ValueError("no lossless frame in the JPEG stream")
    precision, height, width, parts, ids = frame
    which = {body[1 + 2 * k]: tables[body[2 + 2 * k] >> 4] for k in range(body[0])}
    codes = [which[i] for i in ids]
    predictor, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
    segments = _segments(bytes(data[at + 2 + size :]))
    first = 1 << (precision - shift - 1)
    out = np.zeros((height, width, parts), np.int64)
    differences = _differences(segments, codes, height * width, restart, parts)
    step = restart if restart else height * width
    lines = step // width if restart else height
    if restart and restart % width:
        raise ValueError("restarts inside a line are not read")
    for top in range(0, height, max(lines, 1)):
        _predicted(out[top : top + lines], differences[top * width : (top + lines) * width].reshape(-1, width, parts), predictor, first)
    return (out & 0xFFFF) << shift


def _segments(data: bytes) -> list[bytes]:
    """Entropy-coded data between restarts, up to the first other marker."""
    out, start, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[start:])
            break
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            at += 2
            start = at
        else:
            out.append(data[start:at])
            break
    return [s.replace(b"\xff\x00", b"\xff") for s in out]


def _differences(segments: list[bytes], codes: list[list], n: int, restart: int, parts: int) -> np.ndarray:
    out = []
    left = n
    for segment in segments:
        bits, count = _Bits(segment), min(left, restart or left)
        left -= count
        for _ in range(count):
            for table in codes:
                bits.fill(16)
                length, size = table[bits.held >> (bits.n - 16) & 0xFFFF]
                if not length:
                    raise ValueError("broken Huffman data")
                bits.n -= length
                if size == 16:
                    out.append(32768)
                    continue
                v = bits.take(size)
                out.append(v if not size or v >> (size - 1) else v - (1 << size) + 1)
    if left or len(out) != n * parts:
        raise ValueError("the JPEG stream ends early")
    return np.array(out, np.int64).reshape(n, parts)


def _predicted(out: np.ndarray, d: np.ndarray, predictor: int, first: int) -> None:
    """Samples of differences: the first line by its left neighbour, first samples of lines by the one above, others by the rule."""
    height, width, _ = out.shape
    out[0] = (np.cumsum(d[0], axis=0) + first) & 0xFFFF
    for y in range(1, height):
        above = out[y - 1]
        out[y, 0] = (above[0] + d[y, 0]) & 0xFFFF
        if predictor == 1:
            out[y, 1:] = (out[y, 0] + np.cumsum(d[y, 1:], axis=0)) & 0xFFFF
        elif predictor == 2:
            out[y, 1:] = (above[1:] + d[y, 1:]) & 0xFFFF
        elif predictor == 3:
            out[y, 1:] = (above[:-1] + d[y, 1:]) & 0xFFFF
        elif predictor == 4:  # left + above - corner: a running sum of what the line above adds
            out[y, 1:] = (out[y, 0] + np.cumsum(d[y, 1:] + above[1:] - above[:-1], axis=0)) & 0xFFFF
        else:
            for x in range(1, width):
                a, b, c = out[y, x - 1], above[x], above[x - 1]
                rule = a + ((b - c) >> 1) if predictor == 5 else b + ((a - c) >> 1) if predictor == 6 else (a + b) >> 1
                out[y, x] = (rule + d[y, x]) & 0xFFFF
