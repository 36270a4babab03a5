"""SimHash near-duplicates by deletion-variant signatures.

64-bit fingerprints that differ in at most three bits, cut into two halves, have a half that differs in at most one bit. So
each distinct fingerprint is indexed under the variants of its halves with one bit left out (64 keys), fingerprints with equal
keys are verified by their distance, and the links feed connected components. Copies share a fingerprint and count once.

A key that more than LIGHT_KEY fingerprints share is split again: its members agree on one half but for one bit, so they are
re-indexed under the variants of the two quarters of the other half; a key then leaves at most 18 bits free, which bounds its
group at 2^18 fingerprints. Inside a group, a search from each fingerprint over those not yet reached gives a forest that
links exactly what the group's pairs link, without listing the pairs.

Edge cases: null or wordless texts have fingerprint zero and are linked like any other; with fewer words than a shingle the
whole sequence is the one shingle; repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm import store
from skyfold.llm.components import connected_components

#: Fingerprints under one key from which the key is split.
LIGHT_KEY = 64
#: Shingles whose bits are counted at once.
STEP = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _hashes(text: bytes, size: int, seed: int) -> list[int]:
    found = text.translate(_LOWER).split()
    if not found:
        return []
    shingles = list(map(b" ".join, zip(*(found[k:] for k in range(size)), strict=False))) or [b" ".join(found)]
    return list(map(xxhash.xxh64_intdigest, shingles, repeat(seed)))


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes follow each other: a bit is set if it is in over half of them."""
    counts = np.zeros((len(sizes), 64), np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for k in range(0, len(hashes), STEP):
        part, own = hashes[k : k + STEP], doc[k : k + STEP]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    set_bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Per row: doc_id and its fingerprint as a signed 64-bit number."""

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, held, sizes = batch.column(text).to_pylist(), [], [], []

            def flush(out=out, held=held, sizes=sizes) -> None:
                out.append(majority(np.array(held, np.uint64), np.array(sizes, np.int64)))
                held.clear()
                sizes.clear()

            for t in texts:
                found = _hashes((t or "").encode(), shingle, seed)
                held.extend(found)
                sizes.append(len(found))
                if len(held) > STEP:
                    flush()
            if sizes:
                flush()
            values = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.record_batch([batch.column(doc_id), pa.array(values.view(np.int64))], names=["doc_id", "fingerprint"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, fingerprint long")


def forest(values: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs within `most` bits connect."""
    values = values.view(np.uint64)
    out, left, reached = [], values, values[:0]
    while len(left) or len(reached):
        if not len(reached):
            reached, left = left[:1], left[1:]
        if not len(left):
            break
        at, reached = reached[0], reached[1:]
        near = np.bitwise_count(left ^ at) <= most
        if near.any():
            out += [(int(at.view(np.int64)), x) for x in left[near].view(np.int64).tolist()]
            reached, left = np.concatenate([reached, left[near]]), left[~near]
    return out


def _variants(value: str, parts: int, width: int) -> object:
    """Explodable keys: for each of `parts` parts of `width` bits of the expression, the part with one bit left out."""
    return F.expr(
        f"transform(sequence(0, {parts * width - 1}), i -> shiftleft(cast(i as bigint), {width}) | "
        f"((shiftrightunsigned({value}, {width} * cast(i div {width} as int)) & {(1 << width) - 1}L) & ~shiftleft(1L, i % {width})))"
    )


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints at `most` (up to 3) differing bits or fewer, enough to connect them."""
    if most > 3:
        raise ValueError("two halves with one free bit find at most three differing bits")
    keyed = distinct.select("fingerprint", F.explode(_variants("fingerprint", 2, 32)).alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")  # partial sums, so a hot key meets no task
    # sized by its input, the exploded side would be taken for a table small enough to broadcast
    keyed = store.materialize(keyed.hint("merge").join(counts, "key"), "keys")
    light = keyed.filter(F.col("n") <= LIGHT_KEY).groupBy("key").agg(F.collect_list("fingerprint").alias("members")).select("members")
    # the half that the key does not fix
    other = F.expr("CASE WHEN key < shiftleft(32L, 32) THEN shiftrightunsigned(fingerprint, 32) ELSE fingerprint & 4294967295L END")
    heavy = keyed.filter(F.col("n") > LIGHT_KEY).withColumn("other", other).select("fingerprint", "key", F.explode(_variants("other", 2, 16)).alias("part"))
    heavy = heavy.groupBy("key", "part").agg(F.collect_list("fingerprint").alias("members")).filter(F.size("members") > 1).select("members")

    @store.trimmed
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {e for group in batch.column("members") for e in forest(group.values.to_numpy(), most)}
            yield pa.record_batch([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])

    return light.unionByName(heavy).mapInArrow(verify, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42, most: int = 3) -> DataFrame:
    """Per row: doc_id, its fingerprint (signed) and component_id, the smallest doc_id reachable over links."""
    marked = store.materialize(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    distinct = store.materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    found = links(distinct.select("fingerprint"), most)
    # these tables have a row a fingerprint or document: none is collected for a broadcast, however well its file is compressed
    name = distinct.select(F.col("fingerprint").alias("f"), "first").hint("merge")
    edges = found.join(name, F.col("a") == F.col("f")).select("b", F.col("first").alias("x")).join(name, F.col("b") == F.col("f")).select(F.col("x").alias("a"), F.col("first").alias("b"))
    joined = connected_components(edges)
    groups = distinct.join(joined.hint("merge"), F.col("first") == F.col("node"), "left").select(F.col("fingerprint").alias("f"), F.coalesce("component", "first").alias("component_id"))
    return marked.join(groups.hint("merge"), F.col("fingerprint") == F.col("f")).select("doc_id", "fingerprint", "component_id")
