"""Baseline JPEG of 8-bit previews: one or three components, Huffman codes made from the image's own symbols."""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

from skyfold.functions.collaborative import dct_matrix

# fixed values of the format: quantisers at quality 50 (lines of frequencies), for luminance and for colour
LUMINANCE = np.array(
    "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 "
    "18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99".split(), int
).reshape(8, 8)
COLOUR = np.array(
    "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99 "
    "99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99".split(), int
).reshape(8, 8)


def zigzag() -> np.ndarray:
    """Places of the 64 frequencies, diagonal by diagonal, in turning directions."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


def quantiser(base: np.ndarray, quality: int) -> np.ndarray:
    """The table at a quality of 1 to 100, by the customary scale."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def code_lengths(counts: Counter) -> list[tuple[int, int]]:
    """(length, symbol) of a Huffman code of at most 16 bits that leaves the code of ones alone unused."""
    heap = [(n, s, [s]) for s, n in sorted(counts.items())] + [(0, 256, [256])]
    lengths = Counter()
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            lengths[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    sizes = Counter(lengths.values())
    for i in range(max(sizes, default=1), 16, -1):  # longer codes give way: a pair moves up, its place is split lower down
        while sizes[i] > 0:
            j = next(k for k in range(i - 2, 0, -1) if sizes[k])
            sizes[i] -= 2
            sizes[i - 1] += 1
            sizes[j + 1] += 2
            sizes[j] -= 1
    last = max(k for k in sizes if sizes[k])
    sizes[last] -= 1  # the reserved one
    order = sorted((s for s in lengths if s != 256), key=lambda s: (lengths[s], s))
    ends = [k for k in range(1, 17) for _ in range(max(sizes[k], 0))]
    return list(zip(ends, order, strict=True))


def _codes(table: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), in the order of the table."""
    out, code, before = {}, 0, 0
    for length, symbol in table:
        code <<= length - before
        out[symbol] = (code, length)
        code, before = code + 1, length
    return out


def _symbols(blocks: np.ndarray) -> tuple[list[tuple[int, int, int]], list[list[tuple[int, int, int]]]]:
    """Per block the DC triple and the AC triples (symbol, bits, length) of zigzag coefficients (block, 64)."""
    size = lambda v: int(abs(v)).bit_length()
    bits = lambda v, n: v if v > 0 else v + (1 << n) - 1
    direct, other = [], []
    for d in np.diff(blocks[:, 0], prepend=0).tolist():
        n = size(d)
        direct.append((n, bits(d, n) if n else 0, n))
    for row in blocks[:, 1:]:
        own, last = [], -1
        for k in np.flatnonzero(row).tolist():
            run = k - last - 1
            last = k
            own += [(0xF0, 0, 0)] * (run // 16)
            n = size(v := int(row[k]))
            own.append((run % 16 << 4 | n, bits(v, n), n))
        if last < 62:
            own.append((0, 0, 0))
        other.append(own)
    return direct, other


def write_jpeg(a: np.ndarray, quality: int = 90) -> bytes:
    """8-bit samples (height, width) or (height, width, 3)."""
    height, width = a.shape[:2]
    planes = a.reshape(height, width, -1).astype(float)
    if planes.shape[2] == 3:
        r, g, b = planes.transpose(2, 0, 1)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = np.stack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402], -1)
    parts, order, d = planes.shape[2], zigzag(), dct_matrix(8)
    tables = [quantiser(LUMINANCE, quality), quantiser(COLOUR, quality)][: 1 if parts == 1 else 2]
    padded = np.pad(planes, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge") - 128
    rows, columns = padded.shape[0] // 8, padded.shape[1] // 8
    found = []
    for c in range(parts):
        blocks = padded[..., c].reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        levels = np.rint(d @ blocks @ d.T / tables[min(c, 1)]).astype(int)
        found.append(_symbols(levels.reshape(-1, 64)[:, order]))
    codes, out = {}, bytearray(b"\xff\xd8")
    put = lambda marker, body: out.extend(bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body)
    put(0xE0, b"JFIF\0\1\1\0" + struct.pack(">HH", 1, 1) + b"\0\0")
    for i, t in enumerate(tables):
        put(0xDB, bytes([i]) + bytes(t.ravel()[order].tolist()))
    put(0xC0, struct.pack(">BHHB", 8, height, width, parts) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(parts)))
    for i in range(len(tables)):
        own = found[:1] if i == 0 else found[1:]
        for kind, counts in ((0, Counter(s[0] for f in own for s in f[0])), (1, Counter(s[0] for f in own for b in f[1] for s in b))):
            table = code_lengths(counts or Counter([0]))
            codes[kind, i] = _codes(table)
            sizes = Counter(n for n, _ in table)
            put(0xC4, bytes([kind << 4 | i]) + bytes(sizes[k] for k in range(1, 17)) + bytes(s for _, s in table))
    put(0xDA, bytes([parts]) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(parts)) + bytes([0, 63, 0]))
    held, n, body = 0, 0, bytearray()
    for k in range(rows * columns):
        for c in range(parts):
            t = min(c, 1)
            for kind, triples in ((0, [found[c][0][k]]), (1, found[c][1][k])):
                for symbol, bits, length in triples:
                    code, size = codes[kind, t][symbol]
                    held, n = (held << size | code) << length | bits, n + size + length
                    while n >= 8:
                        n -= 8
                        body.append(held >> n & 255)
                    held &= (1 << n) - 1
    if n:
        body.append((held << (8 - n) | (1 << (8 - n)) - 1) & 255)
    return bytes(out) + bytes(body).replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
