"""Tagged image files: directories of every kind, strips and tiles, and the codecs that they are written with.

Reads 8, 16, 32 and 64 bit samples of whole, signed or floating kind (and packed 1 to 16 bit ones), chunky or planar, all pages;
uncompressed, LZW, PackBits and deflate, with the horizontal and the floating-point predictor. What it does not know it refuses.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# fixed values of the format: bytes and struct codes of the field types, and names of compressions
_KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4)}
NONE, LZW, JPEG, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 7, 8, 32773, 32946
_CLEAR, _END = 256, 257


@dataclass
class Directory:
    """Tags of one image: numbers as lists, text as str, fractions as floats; `at` is where it begins."""

    at: int
    tags: dict[int, object] = field(default_factory=dict)

    def number(self, tag: int, default: int = 0) -> int:
        found = self.tags.get(tag)
        return int(found[0]) if isinstance(found, list) and found else default


def byte_order(data: bytes) -> str:
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    return order


def read_directory(data: bytes, at: int, order: str) -> tuple[Directory, int]:
    """The directory at an offset, and the offset of the next one (0: none)."""
    out = Directory(at)
    if not 8 <= at <= len(data) - 2:
        raise ValueError("a directory lies outside the file")
    n = struct.unpack(order + "H", data[at : at + 2])[0]
    for i in range(n):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) < 12:
            raise ValueError("a directory is cut off")
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in _KINDS:
            continue
        code, width = _KINDS[kind]
        where = 0
        raw = entry[8:12]
        if count * width > 4:
            where = struct.unpack(order + "I", entry[8:12])[0]
            raw = data[where : where + count * width]
        if len(raw) < count * width:
            continue
        if kind == 2:
            out.tags[tag] = bytes(raw[:count]).split(b"\0")[0].decode("latin1").strip()
        elif kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * count}{code[0]}", raw[: 8 * count])
            out.tags[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        else:
            out.tags[tag] = list(struct.unpack(f"{order}{count}{code}", raw[: width * count]))
    end = at + 2 + 12 * n
    following = data[end : end + 4]
    return out, struct.unpack(order + "I", following)[0] if len(following) == 4 else 0


def directories(data: bytes, most: int = 65_536) -> tuple[str, list[Directory]]:
    """Byte order and the chain of directories; a chain that comes back to itself ends there."""
    order = byte_order(data)
    at, out, seen = struct.unpack(order + "I", data[4:8])[0], [], set()
    while at and at not in seen and len(out) < most:
        seen.add(at)
        found, following = read_directory(data, at, order)
        out.append(found)
        at = following
    return order, out


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes from the high bit, 9 to 12 bits wide, one code early."""
    out, table, width = bytearray(), [], 9
    held, bits, last = 0, 0, None
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == _END:
            break
        if code == _CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            last = table[code]
            out += last
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        table.append(last + word[:1])
        out += word
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """The inverse; tables are cleared when they are full."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    following = 258
    put(_CLEAR, width)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = following
        following += 1
        if following == (1 << width) and width < 12:
            width += 1
        if following >= 4095:
            put(_CLEAR, width)
            table, width, following = {bytes([k]): k for k in range(256)}, 9, 258
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        following += 1
        if following == (1 << width) and width < 12:
            width += 1
    put(_END, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack_packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    """Runs of three or more as runs, the rest as literals."""
    out, i, start = bytearray(), 0, 0

    def literals(end: int) -> None:
        for k in range(start, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    while i < len(data):
        n = 1
        while i + n < len(data) and n < 128 and data[i + n] == data[i]:
            n += 1
        if n >= 3:
            literals(i)
            out += bytes([257 - n, data[i]])
            start = i + n
        i += n
    literals(len(data))
    return bytes(out)


def _decompressed(body: bytes, compression: int) -> bytes:
    if compression == NONE:
        return body
    if compression == LZW:
        return unpack_lzw(body)
    if compression == PACKBITS:
        return unpack_packbits(body)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(body)
    raise ValueError(f"TIFF compression {compression} is not read")


def _kind(order: str, bits: int, form: int) -> np.dtype:
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{bits} bit samples are not read")
    return np.dtype(f"{order}{'f' if form == 3 else 'i' if form == 2 else 'u'}{bits // 8}")


def unpack_bits(body: bytes, bits: int, lines: int, per_line: int) -> np.ndarray:
    """Packed samples of up to 16 bits, high bit first; every line begins at a byte."""
    width = (per_line * bits + 7) // 8
    raw = np.unpackbits(np.frombuffer(body, np.uint8)[: lines * width].reshape(lines, width), axis=1)[:, : per_line * bits]
    return raw.reshape(lines, per_line, bits).astype(np.uint32) @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint32)


def samples(body: bytes, order: str, page: Directory, lines: int, per_line: int, parts: int) -> np.ndarray:
    """(lines, per_line, parts) of one strip or tile."""
    bits, form, predictor = page.number(258, 1), page.number(339, 1), page.number(317, 1)
    body = _decompressed(body, page.number(259, 1))
    n = lines * per_line * parts
    if bits < 16 and bits != 8:
        return unpack_bits(body, bits, lines, per_line * parts).reshape(lines, per_line, parts)
    kind = _kind(order, bits, form)
    if len(body) < n * kind.itemsize:
        raise ValueError("a strip or tile is cut off")
    if predictor == 3:  # bytes of a line by significance, differences of bytes
        if form != 3:
            raise ValueError("the floating-point predictor needs floating samples")
        raw = np.frombuffer(body, np.uint8)[: n * kind.itemsize].reshape(lines, -1)
        whole = np.cumsum(raw.reshape(lines, -1, parts), axis=1, dtype=np.uint8).reshape(lines, kind.itemsize, per_line * parts)
        return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(lines, per_line, parts)
    a = np.frombuffer(body, kind, n).reshape(lines, per_line, parts)
    if predictor == 2:
        native = kind.newbyteorder("=")
        unsigned = np.dtype(f"u{kind.itemsize}")
        a = np.cumsum(a.astype(native).view(unsigned), axis=1, dtype=unsigned).view(native)
    elif predictor != 1:
        raise ValueError(f"TIFF predictor {predictor} is not read")
    return a


def pieces(data: bytes, page: Directory) -> list[tuple[int, int, int, int, int, bytes]]:
    """(plane, y, x, lines, per_line, body) of the strips or tiles of a page."""
    width, height = page.number(256), page.number(257)
    planes = page.number(277, 1) if page.number(284, 1) == 2 else 1
    if 322 in page.tags:
        size_x, size_y = page.number(322), page.number(323)
        at, counts = page.tags[324], page.tags[325]
        places = [(y, x) for y in range(0, height, size_y) for x in range(0, width, size_x)]
        lines = lambda y: size_y
    else:
        size_x, size_y = width, page.number(278, height) or height
        at, counts = page.tags[273], page.tags.get(279) or [len(data)]
        places = [(y, 0) for y in range(0, height, size_y)]
        lines = lambda y: min(size_y, height - y)
    if len(at) < planes * len(places):
        raise ValueError("strips or tiles are missing")
    return [(k // len(places), y, x, lines(y), size_x, data[at[k] : at[k] + counts[k]]) for k, (y, x) in enumerate(places * planes)]


def page_array(data: bytes, order: str, page: Directory) -> np.ndarray:
    """(height, width, channels) of a page as float64."""
    width, height, channels = page.number(256), page.number(257), page.number(277, 1)
    planar = page.number(284, 1) == 2
    out = np.zeros((height, width, channels))
    for plane, y, x, lines, per_line, body in pieces(data, page):
        a = samples(body, order, page, lines, per_line, 1 if planar else channels)
        cut = a[: height - y, : width - x]
        if planar:
            out[y : y + lines, x : x + per_line, plane] = cut[..., 0]
        else:
            out[y : y + lines, x : x + per_line] = cut
    return out


def pages(data: bytes) -> list[np.ndarray]:
    """All full images of a file; reduced ones (previews, masks) are left out."""
    order, found = directories(data)
    return [page_array(data, order, p) for p in found if p.number(254) & 5 == 0]


def write(arrays: list[np.ndarray], compression: int = NONE, predictor: int = 1, tile: int = 0, planar: bool = False, order: str = "<") -> bytes:
    """Pages (height, width, channels) of one sample kind each, in strips of 16 lines or square tiles."""
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    pack = {NONE: bytes, LZW: pack_lzw, PACKBITS: pack_packbits, DEFLATE: zlib.compress}[compression]
    for a in arrays:
        height, width, channels = a.shape
        kind = a.dtype.newbyteorder(order)
        size_y, size_x = (tile, tile) if tile else (16, width)
        at, counts = [], []
        for plane in range(channels if planar else 1):
            own = a[..., plane : plane + 1] if planar else a
            for y in range(0, height, size_y):
                for x in range(0, width, size_x):
                    part = own[y : y + size_y, x : x + size_x]
                    if tile:
                        part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        unsigned = part.view(np.dtype(f"u{part.dtype.itemsize}")) if part.dtype.isnative else part
                        part = np.diff(unsigned, axis=1, prepend=np.zeros_like(unsigned[:, :1])).view(part.dtype)
                    if predictor == 3:
                        big = np.ascontiguousarray(part, part.dtype.newbyteorder(">"))
                        raw = big.view(np.uint8).reshape(len(part), -1, part.dtype.itemsize).transpose(0, 2, 1).reshape(len(part), -1, part.shape[2])
                        body = np.diff(raw, axis=1, prepend=np.zeros_like(raw[:, :1])).tobytes()
                    else:
                        body = part.astype(kind).tobytes()
                    at.append(len(out))
                    body = pack(body)
                    counts.append(len(body))
                    out += body + bytes(len(body) % 2)
        form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        rows = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8 * a.dtype.itemsize] * channels), (259, 3, [compression]), (262, 3, [2 if channels >= 3 else 1])]
        rows += [] if tile else [(273, 4, at)]
        rows += [(277, 3, [channels])] + ([] if tile else [(278, 4, [size_y]), (279, 4, counts)])
        rows += [(284, 3, [2 if planar else 1]), (317, 3, [predictor])] + ([(322, 4, [tile]), (323, 4, [tile]), (324, 4, at), (325, 4, counts)] if tile else []) + [(339, 3, [form] * channels)]
        here = write_directory(out, rows, order)
        struct.pack_into(order + "I", out, link, here)
        link = len(out) - 4
    return bytes(out)


def write_directory(out: bytearray, rows: list[tuple[int, int, list]], order: str) -> int:
    """Appends values that do not fit and then a directory without a follower; gives its offset."""
    entries = []
    for tag, kind, values in rows:
        code, width = _KINDS[kind]
        body = values if isinstance(values, bytes) else struct.pack(f"{order}{len(values) * len(code)}{code[0]}", *(values if len(code) == 1 else [v for pair in values for v in pair]))
        count = len(body) // width
        if len(body) > 4:
            where = len(out)
            out += body + bytes(len(body) % 2)
            body = struct.pack(order + "I", where)
        entries.append(struct.pack(order + "HHI", tag, kind, count) + body.ljust(4, b"\0"))
    here = len(out)
    out += struct.pack(order + "H", len(entries)) + b"".join(entries) + bytes(4)
    return here
