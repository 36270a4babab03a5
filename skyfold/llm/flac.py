"""FLAC media columns: texts or other bytes as 8-bit mono streams, encoded and decoded with numpy over many frames at once.

The encoder chooses for each frame of `BLOCK` samples the cheapest of a constant, a fixed predictor (orders 0 to 2), a fourth-order
linear predictor with quantized coefficients, and plain samples; residuals are Rice-coded. The decoder takes constant, plain,
fixed (0 to 4) and linear (1 to 32) subframes with any partition order and escaped partitions; frames of one kind are decoded
side by side, one sample of every frame a step. Header CRC-8, frame CRC-16 and the stream's MD5 are verified. A stream has a
seek table (one point in SEEK_EVERY frames); `pcm_column` gives decoded blocks with their sample offsets, from which
`describe_column` derives digests and features, so that each of the two can be stored and read again.

Edge cases: null bytes or texts are empty; payloads are padded with byte 255 to a positive multiple of the block; equal
payloads give equal streams; a long payload is many frames of one stream; repeated rows and null keys pass through; an empty
table gives no rows; columns other than key and data are ignored; any damage raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm import store

#: Samples of a frame, frames from one seek point to the next, and payload bytes worked on at once.
BLOCK, SEEK_EVERY, STEP_BYTES = 576, 16, 2_000_000
_ORDER, _PRECISION, _SHIFT = 4, 12, 10
#: Fixed values of the format: 576 samples are block size code 2, 8 kHz rate code 4, 8 bits sample size code 1.
_SYNC, _RATE = b"\xff\xf8\x24\x02", 8000


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    value = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        value = np.where(value >> (bits - 1) & 1, value << 1 ^ polynomial, value << 1) & ((1 << bits) - 1)
    return value


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of many byte ranges: right-aligned, as leading zeros leave a checksum that begins at zero as it is."""
    longest = int(sizes.max(initial=0))
    crc = np.zeros(len(starts), np.int64)
    ends = starts + sizes
    for t in range(longest, 0, -1):
        byte = np.where(sizes >= t, data[np.maximum(ends - t, 0)], 0)
        crc = (crc << 8 & ((1 << bits) - 1)) ^ table[crc >> (bits - 8) ^ byte]
    return crc


def _numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8 manner: an (n, 7) byte matrix and how many bytes count."""
    size = 1 + sum((n >= 1 << k).astype(np.int64) for k in (7, 11, 16, 21, 26, 31))
    out = np.zeros((len(n), 7), np.uint8)
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE])
    for s in range(1, 8):
        rows = size == s
        out[rows, 0] = lead[s] | n[rows] >> 6 * (s - 1)
        for j in range(1, s):
            out[rows, j] = 0x80 | n[rows] >> 6 * (s - 1 - j) & 0x3F
    return out, size


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _predicted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized coefficients by Levinson's recursion, and the residuals from sample _ORDER on."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, : BLOCK - k], f[:, k:]).astype(np.float64) for k in range(_ORDER + 1)])
    error, a = r[0] * (1 + 1e-9) + 1e-9, np.zeros((_ORDER, len(x)))
    for i in range(_ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error = error * np.maximum(1e-12, 1 - k * k)
    limit = 1 << (_PRECISION - 1)
    q = np.clip(np.rint(a * (1 << _SHIFT)), -limit, limit - 1).astype(np.int32)
    total = np.zeros((len(x), BLOCK - _ORDER), np.int32)
    for j in range(_ORDER):
        total += q[j][:, None] * x[:, _ORDER - 1 - j : BLOCK - 1 - j]
    return q.T, x[:, _ORDER:] - (total >> _SHIFT)


def _frames(payload: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Encoded frames of an (n, BLOCK) byte matrix."""
    n = len(payload)
    x = payload.astype(np.int32) - 128
    q, linear = _predicted(x)
    residuals = [x, x[:, 1:] - x[:, :-1], x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2], linear]
    heads = np.array([8 + 6 + 4, 8 + 8 + 6 + 4, 8 + 16 + 6 + 4, 8 + 8 * _ORDER + 9 + _PRECISION * _ORDER + 6 + 4])
    folded = [_zigzag(r) for r in residuals]
    cost = np.stack([h + f.shape[1] * (1.5 + np.log2(f.mean(1) + 1)) for h, f in zip(heads, folded, strict=True)])
    kind = cost.argmin(0)
    warm = np.array([0, 1, 2, _ORDER])[kind]
    bits = np.zeros(n, np.int64)
    k = np.zeros(n, np.int64)
    parts = []
    for c, f in enumerate(folded):
        rows = np.flatnonzero(kind == c)
        if not len(rows):
            continue
        u = f[rows]
        guess = np.clip(np.floor(np.log2(u.mean(1) + 1e-9)).astype(np.int64), 0, 13)
        sizes = np.stack([(u >> (guess + d)[:, None]).sum(1) + u.shape[1] * (guess + d + 1) for d in (0, 1)])
        k[rows] = guess + sizes.argmin(0)
        bits[rows] = heads[c] + sizes.min(0)
        parts.append((rows, u))
    constant = (payload == payload[:, :1]).all(1)
    plain = ~constant & (bits >= 8 + 8 * BLOCK)
    bits = np.where(constant, 16, np.where(plain, 8 + 8 * BLOCK, bits))
    coded = ~constant & ~plain
    sizes = (bits + 7) // 8
    starts = np.cumsum(sizes) - sizes
    stream = np.zeros(int(sizes.sum()) * 8, np.uint8)
    at = starts * 8

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            stream[where + (width - 1 - j)] = value >> j & 1

    put(at, np.where(constant, 0, np.where(plain, 2, np.where(kind == 3, (32 | _ORDER - 1) << 1, (8 | kind) << 1))), 8)
    at = at + 8
    put(at[constant], payload[constant, 0].astype(np.int64) ^ 128, 8)
    if plain.any():
        put(at[plain][:, None] + 8 * np.arange(BLOCK), payload[plain].astype(np.int64) ^ 128, 8)
    for w in range(_ORDER):
        rows = coded & (warm > w)
        put(at[rows] + 8 * w, payload[rows, w].astype(np.int64) ^ 128, 8)
    at = at + 8 * warm
    rows = coded & (kind == 3)
    put(at[rows], np.full(int(rows.sum()), (_PRECISION - 1) << 5 | _SHIFT), 9)
    for j in range(_ORDER):
        put(at[rows] + 9 + _PRECISION * j, q[rows, j].astype(np.int64), _PRECISION)
    at = at + np.where(kind == 3, 9 + _PRECISION * _ORDER, 0) + 6  # coding method 0, partition order 0
    put(at[coded], k[coded], 4)
    at = at + 4
    for rows, u in parts:
        keep = coded[rows]
        rows, u = rows[keep], u[keep]
        if not len(rows):
            continue
        own = k[rows][:, None]
        ends = at[rows][:, None] + np.cumsum((u >> own) + 1 + own, axis=1)
        for j in range(int(own.max()) + 1):
            take = own[:, 0] >= j
            stream[(ends[take] - 1 - j).ravel()] = np.where(own[take] == j, 1, u[take] >> j & 1).ravel()
    body = np.packbits(stream)
    digits, width = _numbers(number)
    head = np.concatenate([np.tile(np.frombuffer(_SYNC, np.uint8), (n, 1)), digits, np.zeros((n, 1), np.uint8)], axis=1)
    flat = head.ravel()
    head[np.arange(n), 4 + width] = _crc(flat, np.arange(n) * head.shape[1], 4 + width, _CRC8, 8)
    raw = [h[: 5 + w].tobytes() + body[s : s + z].tobytes() for h, w, s, z in zip(head, width.tolist(), starts.tolist(), sizes.tolist(), strict=True)]
    lengths = np.array([len(r) for r in raw], np.int64)
    crc = _crc(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths, lengths, _CRC16, 16)
    return [r + struct.pack(">H", c) for r, c in zip(raw, crc.tolist(), strict=True)]


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose size is a positive multiple of the block."""
    out: list[list[bytes]] = [[] for _ in payloads]
    matrix = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    counts = np.array([len(p) // BLOCK for p in payloads])
    owner = np.repeat(np.arange(len(payloads)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    for k in range(0, len(matrix), STEP_BYTES // BLOCK):
        for o, frame in zip(owner[k:].tolist(), _frames(matrix[k : k + STEP_BYTES // BLOCK], number[k : k + STEP_BYTES // BLOCK]), strict=False):
            out[o].append(frame)
    return [_stream(p, frames) for p, frames in zip(payloads, out, strict=True)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    signed = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
    packed = _RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3) + max(sizes).to_bytes(3) + packed.to_bytes(8) + hashlib.md5(signed).digest()
    offsets = np.cumsum(sizes) - sizes
    points = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), BLOCK) for i in range(0, len(frames), SEEK_EVERY))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(points).to_bytes(3) + points + b"".join(frames)


def metadata(stream: bytes) -> dict:
    """Where the frames begin, the stream information and the seek points (sample, byte offset in the frames, samples)."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, found = 4, {"points": []}
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4])
        block = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed = int.from_bytes(block[10:18])
            found |= {"block": int.from_bytes(block[:2]), "bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "samples": packed & ((1 << 36) - 1), "md5": block[18:34]}
        elif kind & 127 == 3:
            found["points"] = [struct.unpack(">QQH", block[i : i + 18]) for i in range(0, size, 18)]
        at += 4 + size
        if kind & 128:
            break
    if (found.get("block"), found.get("bits"), found.get("channels")) != (BLOCK, 8, 1):
        raise ValueError(f"only mono streams of 8 bits in blocks of {BLOCK} are read")
    return found | {"frames": at}


def _find_frames(data: np.ndarray, raw: bytes, begin: int, end: int, count: int) -> list[tuple[int, int]]:
    """(start, header size) of the frames: sync code, checked header and the next number; a frame's checksum settles ties."""
    out: list[tuple[int, int]] = []
    at = begin
    while len(out) < count:
        at = raw.find(_SYNC, at, end)
        if at < 0:
            raise ValueError("a frame is missing")
        digits, width = _numbers(np.array([len(out)]))
        size = 5 + int(width[0])
        head = raw[at : at + size]
        if head[4:-1] == digits[0, : size - 5].tobytes() and _crc(data, np.array([at]), np.array([size - 1]), _CRC8, 8)[0] == head[-1] and (not out or _whole(data, out[-1][0], at)):
            out.append((at, size))
            at += size
        else:
            at += 1
    return out


def _whole(data: np.ndarray, start: int, end: int) -> bool:
    if end - start < 8:
        return False
    return _crc(data, np.array([start]), np.array([end - start - 2]), _CRC16, 16)[0] == int(data[end - 2]) << 8 | int(data[end - 1])


def _starts(data: np.ndarray, raw: bytes, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, header size and end of all frames of the streams (begin, end, frames) in the buffer, headers and checksums verified."""
    hits, at = [], raw.find(_SYNC)
    while at >= 0:
        hits.append(at)
        at = raw.find(_SYNC, at + 1)
    hits = np.array(hits, np.int64)
    starts, heads, ends = [], [], []
    for begin, end, count in spans:
        own = hits[np.searchsorted(hits, begin) : np.searchsorted(hits, end)]
        if len(own) == count:
            size = 5 + _numbers(np.arange(count))[1]
        else:  # the sync code also stands inside a frame
            own, size = (np.array(c, np.int64) for c in zip(*_find_frames(data, raw, begin, end, count), strict=True))
        starts.append(own)
        heads.append(size)
        ends.append(np.append(own[1:], end))
    start, head, end = np.concatenate(starts), np.concatenate(heads), np.concatenate(ends)
    number = np.concatenate([np.arange(c) for _, _, c in spans])
    digits, width = _numbers(number)
    for j in range(7):
        rows = width > j
        if (data[start[rows] + 4 + j] != digits[rows, j]).any():
            raise ValueError("a frame's number is wrong")
    if (_crc(data, start, head - 1, _CRC8, 8) != data[start + head - 1]).any():
        raise ValueError("a frame header's checksum is wrong")
    if (_crc(data, start, end - start - 2, _CRC16, 16) != (data[end - 2].astype(np.int64) << 8 | data[end - 1])).any():
        raise ValueError("a frame's checksum is wrong")
    return start, head, end


class _Bits:
    """Reads from many bit positions at once."""

    def __init__(self, raw: bytes):
        self._words = np.ndarray(len(raw) + 1, ">u8", raw + bytes(16), strides=(1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits at least, from the top."""
        return self._words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of up to 32 bits."""
        width = np.broadcast_to(np.asarray(width, np.uint64), at.shape)
        return (self.window(at) >> np.uint64(1) >> (np.uint64(63) - width)).astype(np.int64)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value = self.take(at, width)
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        return value - ((value >> np.maximum(width - 1, 0) & (width > 0)) << width)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rice-coded signed numbers and the positions behind them."""
        zeros = np.zeros(len(at), np.int64)
        window = self.window(at)
        top = (window >> np.uint64(32)).astype(np.float64)
        empty = top == 0
        while empty.any():  # a run of 32 zeros or more
            at = at + 32 * empty
            zeros += 32 * empty
            window = self.window(at)
            top = (window >> np.uint64(32)).astype(np.float64)
            empty = top == 0
        lead = 32 - np.frexp(top)[1].astype(np.int64)
        at = at + lead + 1
        rest = window << (lead + 1).astype(np.uint64)
        far = lead + 1 + k > 57
        if far.any():
            rest = np.where(far, self.window(at), rest)
        low = (rest >> np.uint64(1) >> (np.uint64(63) - k.astype(np.uint64))).astype(np.int64)
        value = (zeros + lead) << k | low
        return value >> 1 ^ -(value & 1), at + k


def _residuals(bits: _Bits, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(BLOCK - order, frames) residuals and the positions behind them."""
    method, parts = bits.take(at, 2), bits.take(at + 2, 4)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    out = np.zeros((BLOCK - order, len(at)), np.int64)
    after = at + 6
    for code in np.unique(method * 16 + parts):  # frames cut alike go together
        rows = np.flatnonzero(method * 16 + parts == code)
        wide, pieces = (4, 5)[code // 16], 1 << int(code) % 16
        if BLOCK % pieces:
            raise ValueError("partitions do not divide the block")
        pos, t = after[rows], 0
        for piece in range(pieces):
            k = bits.take(pos, wide)
            pos = pos + wide
            escaped = k == (1 << wide) - 1
            raw = np.where(escaped, bits.take(pos, 5), 0)
            pos = pos + 5 * escaped
            for _ in range(BLOCK // pieces - (order if not piece else 0)):
                if escaped.any():
                    value, then = bits.rice(pos[~escaped], k[~escaped])
                    out[t, rows[~escaped]] = value
                    out[t, rows[escaped]] = bits.signed(pos[escaped], raw[escaped])
                    pos[~escaped], pos[escaped] = then, pos[escaped] + raw[escaped]
                else:
                    out[t, rows], pos = bits.rice(pos, k)
                t += 1
        after[rows] = pos
    return out, after


def _samples(raw: bytes, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(frames, BLOCK) samples of frames whose subframes begin at the byte positions `at`; they must end at `ends`."""
    bits, kind = _Bits(raw), data[at].astype(np.int64)
    if (kind & 0x81).any():
        raise ValueError("padding or wasted bits")
    kind >>= 1
    out = np.zeros((len(at), BLOCK), np.int64)
    behind = np.zeros(len(at), np.int64)
    for code in np.unique(kind):
        rows = np.flatnonzero(kind == code)
        pos = (at[rows] + 1) * 8
        if code == 0:
            out[rows] = bits.signed(pos, 8)[:, None]
            behind[rows] = pos + 8
        elif code == 1:
            out[rows] = data[(at[rows] + 1)[:, None] + np.arange(BLOCK)].view(np.int8)
            behind[rows] = pos + 8 * BLOCK
        elif 8 <= code <= 12 or code >= 32:
            order = int(code - 8 if code < 32 else code - 31)
            warm = np.stack([bits.signed(pos + 8 * j, 8) for j in range(order)]) if order else np.zeros((0, len(rows)), np.int64)
            pos = pos + 8 * order
            if code >= 32:
                width, shift = bits.take(pos, 4) + 1, bits.signed(pos + 4, 5)
                if (width == 16).any() or (shift < 0).any():
                    raise ValueError("bad predictor")
                weights = np.stack([bits.signed(pos + 9 + width * j, width) for j in range(order)])
                pos = pos + 9 + width * order
            rest, behind[rows] = _residuals(bits, pos, order)
            if code < 32:
                for level in range(order, 0, -1):  # sums undo differences, from the highest down
                    rest = np.diff(warm, n=level - 1, axis=0)[-1] + np.cumsum(rest, axis=0)
                out[rows] = np.concatenate([warm, rest]).T
            else:
                x = np.concatenate([warm, rest])
                for t in range(order, BLOCK):
                    x[t] += (weights * x[t - order : t][::-1]).sum(0) >> shift
                out[rows] = x.T
        else:
            raise ValueError("unknown subframe")
    if ((behind + 7) // 8 != ends).any():
        raise ValueError("a frame does not end where the next begins")
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; frame checksums and the stream's MD5 are verified."""
    raw, spans, heads, at = b"".join(streams), [], [], 0
    for s in streams:
        head = metadata(s)
        if head["samples"] % BLOCK:
            raise ValueError("a stream of part blocks")
        heads.append(head)
        spans.append((at + head["frames"], at + len(s), head["samples"] // BLOCK))
        at += len(s)
    data = np.frombuffer(raw, np.uint8)
    start, size, end = _starts(data, raw, spans)
    first = 0
    for head, (begin, _, count) in zip(heads, spans, strict=True):
        if any(sample % BLOCK or sample >= head["samples"] or start[first + sample // BLOCK] != begin + offset for sample, offset, _ in head["points"]):
            raise ValueError("a seek point is wrong")
        first += count
    step, parts = STEP_BYTES // BLOCK, []
    for k in range(0, len(start), step):
        a, b = int(start[k]), int(end[min(k + step, len(end)) - 1])
        parts.append(_samples(raw[a:b], data[a:b], (start + size)[k : k + step] - a, end[k : k + step] - 2 - a).astype(np.int8))
    signed = np.concatenate(parts).view(np.uint8).reshape(-1).tobytes()
    out, at = [], 0
    for head in heads:
        pcm = signed[at : at + head["samples"]]
        if hashlib.md5(pcm).digest() != head["md5"]:
            raise ValueError("the stream's MD5 is wrong")
        out.append((np.frombuffer(pcm, np.uint8) ^ 128).tobytes())
        at += len(pcm)
    return out


def read_block(stream: bytes, sample: int) -> tuple[int, bytes]:
    """First sample and payload of the block that holds a sample, decoded from the nearest seek point on."""
    head = metadata(stream)
    if not 0 <= sample < head["samples"]:
        raise ValueError("no such sample")
    first, offset, _ = max((p for p in head["points"] if p[0] <= sample), default=(0, 0, BLOCK))
    raw = stream[head["frames"] + offset :]
    data, number, at = np.frombuffer(raw, np.uint8), first // BLOCK, 0
    while True:
        size = 5 + int(_numbers(np.array([number]))[1][0])
        nxt = raw.find(_SYNC, at + size)
        while nxt >= 0 and not _whole(data, at, nxt):
            nxt = raw.find(_SYNC, nxt + 1)
        end = len(raw) if nxt < 0 else nxt
        if number == sample // BLOCK:
            if not _whole(data, at, end):
                raise ValueError("a frame's checksum is wrong")
            return number * BLOCK, (_samples(raw[at:end], data[at:end], np.array([size]), np.array([end - 2 - at]))[0].astype(np.int8).view(np.uint8) ^ 128).tobytes()
        number, at = number + 1, end


def features(payload: bytes) -> str:
    """Sign changes, peak and energy of the samples, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};peak={int(np.abs(x).max())};energy={int((x * x).sum())}"


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    begin = 0
    while begin < len(column):
        end, size, held = begin, 0, []
        while end < len(column) and (end == begin or size < STEP_BYTES):
            held.append(column[end].as_py() or b"")
            size += len(held[-1])
            end += 1
        yield begin, held
        begin = end


def encode_column(rows: DataFrame, key: str, data: str) -> DataFrame:
    """(key, n_bytes, media) for a string or binary column."""

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, held in _slices(batch.column("data")):
                yield pa.record_batch([batch.column(key).slice(begin, len(held)), pa.array([len(h) for h in held], pa.int64()), pa.array(encode([padded(h) for h in held]), pa.binary())], names=[key, "n_bytes", "media"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(data).cast("binary").alias("data")).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def pcm_column(media: DataFrame, key: str) -> DataFrame:
    """Decoded streams: (key, n_bytes, media_bytes, media_sha256, blocks), the blocks with their sample offsets in order."""
    block = pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())])

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, held in _slices(batch.column("media")):
                payloads = decode(held)
                counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
                ends = np.cumsum(counts)
                offset = (np.arange(int(counts.sum())) - np.repeat(ends - counts, counts)) * BLOCK
                pcm = pa.Array.from_buffers(pa.binary(), len(offset), [None, pa.py_buffer(np.arange(len(offset) + 1, dtype=np.int32) * BLOCK), pa.py_buffer(b"".join(payloads))])
                blocks = pa.StructArray.from_arrays([pa.array(offset), pa.array(np.full(len(offset), BLOCK, np.int32)), pcm], fields=list(block))
                yield pa.record_batch(
                    [
                        batch.column(key).slice(begin, len(held)),
                        batch.column("n_bytes").slice(begin, len(held)),
                        pa.array([len(h) for h in held], pa.int64()),
                        pa.array([hashlib.sha256(h).hexdigest() for h in held]),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), blocks),
                    ],
                    names=[key, "n_bytes", "media_bytes", "media_sha256", "blocks"],
                )

    kind = media.schema[key].dataType.simpleString()
    return media.mapInArrow(run, f"`{key}` {kind}, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset:bigint,n_samples:int,pcm:binary>>")


def describe_column(decoded: DataFrame, key: str) -> DataFrame:
    """Of decoded streams: digests of payload and stream, the payload's tail and its features."""

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("blocks")
            edges = blocks.offsets.to_numpy() - blocks.offsets[0].as_py()
            pcm = blocks.flatten().field("pcm").to_pylist()
            payloads = (b"".join(pcm[a:b]) for a, b in zip(edges, edges[1:], strict=False))
            found = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), features(p)) for p in payloads]
            size, digest, tail, feature = (pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string())))
            columns = {key: batch.column(key), "n_bytes": batch.column("n_bytes"), "payload_bytes": size, "payload_sha256": digest, "tail_crc32": tail, "media_bytes": batch.column("media_bytes"), "media_sha256": batch.column("media_sha256"), "feature": feature}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = decoded.schema[key].dataType.simpleString()
    return decoded.mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_blocks(media: DataFrame, key: str) -> DataFrame:
    """Decoded blocks: (key, block, sample_offset, n_samples, pcm), pcm as unsigned 8-bit samples."""
    return pcm_column(media, key).select(key, F.posexplode("blocks").alias("block", "b")).select(key, F.col("block").cast("long").alias("block"), "b.sample_offset", "b.n_samples", "b.pcm")
