"""Quality by compression: which labelled texts make a document short.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A document is cut into pieces of
`PIECE` bytes, so that a dictionary counts for the whole of a long text, and every piece is compressed with each; the feature is
(size with the bad dictionary - size with the good one) / (their sum), and a logistic curve over it, weighted to the classes'
true frequencies, is the score.

The fit reads a bounded sample: of each class at most `SAMPLE_ROWS` labelled rows by hash, of each of these at most
`ROW_PIECES` pieces by hash, equal pieces once, at most `CLASS_PIECES` pieces together. Two thirds of the sampled rows build
the dictionaries, whole texts of the other third fit the curve. Neither labels nor lang, source or doc_id are inputs of a score.

Edge cases: null and empty texts compress alike and get the curve's value at zero; texts of any length are compressed whole;
labels with a null mark or doc_id are left out, repeated ones count by their maximum; repeated rows and equal texts score alike;
where labelled rows of both kinds are missing every score is 0; where too little text is there to train a dictionary the pieces
themselves are the dictionary; an empty table gives no rows; an added column whose name is taken gets underscores before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm import store

#: Labelled rows of a class, pieces of a row and pieces of a class that the model is fitted on, at most.
SAMPLE_ROWS, ROW_PIECES, CLASS_PIECES = 4_000, 8, 6_000
#: Bytes of a piece and of a dictionary, and the level of compression.
PIECE, DICTIONARY, LEVEL = 1_000, 110_000, 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the curve; an empty dictionary says that nothing could be learned."""

    good: bytes
    bad: bytes
    slope: float
    base: float

    def score(self, difference: np.ndarray) -> np.ndarray:
        if not self.good or not self.bad:
            return np.zeros(len(difference))
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * difference, -30, 30)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _pieces(text: bytes) -> Iterator[bytes]:
    for k in range(0, max(1, len(text)), PIECE):
        yield text[k : k + PIECE]


class Sizes:
    """Compressed sizes of whole texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for content in (good, bad):
            words = zstandard.ZstdCompressionDict(content)  # by its magic number a trained one, else raw content
            words.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: str | None) -> float:
        data = (text or "").encode()
        good, bad = (sum(len(c.compress(p)) for p in _pieces(data)) for c in self.compressors)
        return (bad - good) / (bad + good)


def _sample(docs: DataFrame, labels: DataFrame, text: str) -> tuple[DataFrame, dict[int, int]]:
    """(text, quality, fold) of the sampled rows, whose identifiers are few enough to broadcast, and all labels' counts."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in marks.filter("quality IN (0, 1)").groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    by = F.xxhash64("doc_id", F.lit(17))
    chosen = marks.filter("quality = 1").orderBy(by).limit(SAMPLE_ROWS).unionByName(marks.filter("quality = 0").orderBy(by).limit(SAMPLE_ROWS))
    chosen = chosen.select(F.col("doc_id").alias("of"), "quality")
    named = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    return named.select("text", "quality", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(3)).alias("fold")), counts


@store.trimmed
def _rows_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quality, pieces, keys = [], [], []
        for q, t in zip(batch.column("quality").to_pylist(), batch.column("text"), strict=True):
            found = {xxhash.xxh64_intdigest(p) >> 1: p for p in _pieces((t.as_py() or "").encode()) if p}
            for key in sorted(found)[:ROW_PIECES]:
                quality.append(q)
                keys.append(key)
                pieces.append(found[key])
        yield pa.record_batch([pa.array(quality, pa.int32()), pa.array(keys, pa.int64()), pa.array(pieces, pa.binary())], names=["quality", "key", "piece"])


def _dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b"\n".join(pieces)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and base of a weighted ridge logistic curve, by Newton's steps; the feature is brought to unit scale first."""
    scale = float(np.sqrt(np.average(x * x, weights=weight))) or 1.0
    design, w = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 0.05 * w
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + 0.05 * np.eye(2), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """The model of the labelled rows that are not held out."""
    sample, counts = _sample(docs, labels, text)
    sample = store.materialize(sample, "quality-sample")
    pieces = sample.filter("fold > 0").select("quality", "text").mapInArrow(_rows_pieces, "quality int, key long, piece binary").dropDuplicates(["quality", "key"])
    content = []
    for q in (1, 0):
        found = [bytes(r["piece"]) for r in pieces.filter(F.col("quality") == q).orderBy("key").limit(CLASS_PIECES).collect()]
        content.append(_dictionary(found) if found else b"")
    if not all(content):
        return Model(b"", b"", 0.0, 0.0)
    good, bad = content

    @store.trimmed
    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            yield pa.record_batch([batch.column("quality"), pa.array([sizes.difference(t.as_py()) for t in batch.column("text")], pa.float64())], names=["quality", "x"])

    rows = sorted(map(tuple, sample.filter("fold = 0").select("quality", "text").mapInArrow(differences, "quality int, x double").collect()))  # a third of the sample
    y, x = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return Model(good, bad, 60.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return Model(good, bad, *logistic(x, y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model: Model, text: str = "text", added: tuple[str, str, str] = ("score", "predicted", "size_difference")) -> DataFrame:
    """The documents with score, predicted and size_difference, under the names `added`, with underscores before taken ones."""
    added = tuple(store.free_name(docs, name) for name in added)
    names = docs.columns

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model.good and model.bad else None
        for batch in batches:
            x = np.array([sizes.difference(t.as_py()) if sizes else 0.0 for t in batch.column(names.index(text))], float)
            value = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32)), pa.array(x)], names=[*names, *added])

    fields = [T.StructField(n, t) for n, t in zip(added, (T.DoubleType(), T.IntegerType(), T.DoubleType()), strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted and size_difference."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = fit(named, labels)
    return score(named, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "size_difference")
