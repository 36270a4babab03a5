"""JPEG previews against a small decoder: every sample within what the quantisers may take."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from skyfold.functions.collaborative import dct_matrix
from skyfold.sources import jpeg


def decode(data: bytes) -> np.ndarray:
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    at, tables, huffman = 2, {}, {}
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            tables[body[0]] = np.frombuffer(body[1:], np.uint8).astype(int)
        elif marker == 0xC4:
            codes, code, k = {}, 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[f"{code:0{length}b}"] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            assert "1" * 16 not in codes and all(set(c) != {"1"} for c in codes)
            huffman[body[0]] = codes
        elif marker == 0xC0:
            height, width, parts = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
        elif marker == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\x00", b"\xff"))
    place = 0

    def symbol(codes: dict) -> int:
        nonlocal place
        for n in range(1, 17):
            if (s := codes.get(bits[place : place + n])) is not None:
                place += n
                return s
        raise AssertionError("no such code")

    def number(n: int) -> int:
        nonlocal place
        if not n:
            return 0
        v = int(bits[place : place + n], 2)
        place += n
        return v if v >> (n - 1) else v - (1 << n) + 1

    rows, columns = -(-height // 8), -(-width // 8)
    out, last, d, order = np.zeros((8 * rows, 8 * columns, parts)), [0] * parts, dct_matrix(8), jpeg.zigzag()
    for k in range(rows * columns):
        for c in range(parts):
            t = min(c, 1)
            z = np.zeros(64, int)
            last[c] += number(symbol(huffman[t]))
            z[0], i = last[c], 1
            while i < 64:
                s = symbol(huffman[0x10 | t])
                if s == 0:
                    break
                i += s >> 4
                if s & 15:
                    z[i] = number(s & 15)
                i += 1
            block = np.zeros(64)
            block[order] = z * tables[t]
            y, x = divmod(k, columns)
            out[8 * y : 8 * y + 8, 8 * x : 8 * x + 8, c] = d.T @ block.reshape(8, 8) @ d + 128
    out = out[:height, :width]
    if parts == 3:
        y, b, r = out.transpose(2, 0, 1)
        red, blue = y + 1.402 * (r - 128), y + 1.772 * (b - 128)
        out = np.stack([red, (y - 0.299 * red - 0.114 * blue) / 0.587, blue], -1)
    return out if parts == 3 else out[..., 0]


@pytest.mark.parametrize("shape", [(8, 8), (1, 1), (37, 50), (24, 31, 3), (9, 8, 3)])
@pytest.mark.parametrize("quality", [30, 90, 100])
def test_a_decoder_gives_the_preview_back(shape, quality):
    rng = np.random.default_rng(1)
    smooth = 120 + 80 * np.sin(np.add.outer(np.arange(shape[0]), np.arange(shape[1])) / 9)
    for a in (np.broadcast_to(smooth[..., None] if len(shape) == 3 else smooth, shape), rng.integers(0, 256, shape), np.full(shape, 200), np.zeros(shape)):
        a = np.ascontiguousarray(a).astype("u1")
        back = decode(jpeg.write_jpeg(a, quality))
        assert back.shape == a.shape
        # by Parseval a block's error is bounded by half a step a frequency
        bound = np.sqrt((jpeg.quantiser(jpeg.LUMINANCE, quality) ** 2).sum()) / 2 * (1 if len(shape) == 2 else 4)
        assert np.abs(back - a).max() <= bound + 1
        if quality == 100:
            assert np.abs(back - a).mean() < 1.5
    assert len(jpeg.write_jpeg(np.full(shape, 9, "u1"), quality)) < 900


def test_orders_and_codes():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    for counts in (Counter({3: 1}), Counter({k: 2**k for k in range(30)}), Counter({k: 1 for k in range(200)})):
        table = jpeg.code_lengths(counts)
        assert {s for _, s in table} == set(counts) and max(n for n, _ in table) <= 16
        assert sum(2.0**-n for n, _ in table) < 1
