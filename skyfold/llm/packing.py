"""Best-fit packing of token sequences by exact-complement hashing over length counts.

Only the counts of the 1 to `capacity` piece lengths reach the driver (a table of bounded size, whatever the input). The plan
is made on them: from the longest length down, the gap it leaves is looked up among single lengths, sums of two and sums of
three, and the combination is consumed as often as its scarcest length allows; lengths that no combination completes are placed
best-fit, longest first, into the smallest gap that takes them. The plan says, for each length, which ranks among the pieces
of that length go to which sequence; Spark ranks the pieces within salted groups of a length, so that one very common length
is spread over many tasks.

Edge cases: a null or empty text is one piece holding the end id alone; a longer document is cut so that its first piece may be
shorter and all others are full; repeated rows are packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm import bpe, store

#: Pieces of one length that share a salt, about.
RANKED_ROWS = 200_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, times) that use up the counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(lengths: tuple[int, ...]) -> None:
        used = {n: lengths.count(n) for n in lengths}
        times = int(min(left[n] // k for n, k in used.items()))
        for n, k in used.items():
            left[n] -= k * times
        out.append((lengths, times))

    for first in range(capacity, 0, -1):
        while left[first]:
            lengths = _complement(left, first, capacity - first)
            if lengths is None:
                break
            consume((first, *lengths))
    return out + _best_fit(left, capacity)


def _complement(left: np.ndarray, first: int, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that add up to the gap, longest ones first."""
    if not gap:
        return ()

    def free(lengths: tuple[int, ...]) -> bool:
        taken = (first, *lengths)
        return all(left[n] >= taken.count(n) for n in lengths)

    if free((gap,)):
        return (gap,)
    have = np.flatnonzero(left[: gap + 1])
    for a in have[::-1]:
        if a <= gap // 2 - 1:
            break
        if a < gap and left[gap - a] and free((int(a), int(gap - a))):
            return int(a), int(gap - a)
    for a in have[::-1]:
        rest = gap - int(a)
        if rest > 2 * a:
            break
        if rest < 2:
            continue
        b = np.arange(max(1, (rest + 1) // 2), min(int(a), rest - 1) + 1)
        for k in b[(left[b] > 0) & (left[rest - b] > 0)][::-1].tolist():
            if free((int(a), k, rest - k)):
                return int(a), k, rest - k
    return None


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the smallest gap that takes it; open sequences with the same contents are kept as one entry."""
    gaps: dict[int, list[list]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                held, open_now, gap = (), n, capacity
            else:
                held, open_now = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            fit = min(gap // length, n)
            times = min(open_now, n // fit)
            gaps.setdefault(gap - fit * length, []).append([(*held, *[length] * fit), times])
            if held and times < open_now:
                gaps.setdefault(gap, []).append([held, open_now - times])
            n -= fit * times
    return [(tuple(held), times) for entries in gaps.values() for held, times in entries]


def _intervals(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length its ranks from `low` on that go to sequences from `sequence` on at `offset`, sorted by length and rank."""
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, taken[n], sequence, offset))
            taken[n] += times
            offset += n
        sequence += times
    table = np.array(rows or [(0, 0, 0, 0)], np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"length": table[:, 0], "low": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def token_pieces(docs: DataFrame, path: str, capacity: int, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, cache: int = bpe.CACHE) -> DataFrame:
    """Per piece: doc_id, piece, start, length and the CRC-32 of its ids as little-endian 32-bit numbers."""
    kind = docs.schema[doc_id].dataType.simpleString()

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, end = bpe.vocabulary(path, cache), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for begin, texts in bpe.slices(batch.column(text), min(bpe.BATCH_BYTES, 35 * cache)):
                row, piece, start, length, crc = [], [], [], [], []
                flat, offsets = vocab.encode(texts)
                for k, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    raw = flat[low:high].tobytes() + end
                    n = len(raw) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(begin + k)
                        piece.append(j)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                yield pa.record_batch([batch.column(doc_id).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset; `length` says how long each is. Rows are read twice: give it a stored table."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _intervals(plan(counts, capacity), capacity)
    salts = max(64, max(counts.values(), default=0) // RANKED_ROWS)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "length"]), F.lit(salts)))
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*[c for c in pieces.columns if c != "length"]))
    ranked = salted.withColumn("_rank", rank).join(before, ["length", "_salt"]).select(*pieces.columns, (F.col("_rank") + F.col("_before") - 1).alias("_rank"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields]
    names = list(pieces.columns)

    @store.trimmed
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.int64(1) << 48
        keys = table["length"] * width + table["low"]
        for batch in batches:
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, batch.column("length").to_numpy(zero_copy_only=False) * width + rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["low"][at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(table["offset"][at])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, cache: int = bpe.CACHE) -> DataFrame:
    """Tokenizes, cuts and packs whole documents. `cache` trades a worker's memory against encoding rare words again."""
    return pack(store.materialize(token_pieces(docs, path, capacity, doc_id, text, end_id, cache), "pieces"), capacity)
