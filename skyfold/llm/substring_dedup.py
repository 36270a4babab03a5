"""Substring deduplication with prefix-partitioned suffix trees.

A suffix is a word position; a repeat is a run of `window` consecutive words that also starts earlier (smaller doc_id, or
the same document and an earlier word). The job runs in four distributed steps over *chunks*, bounded groups of whole
documents that are written once to the shared folder:

1. prefix census: of every window the half-window prefix with the least hash is its anchor, so equal windows have equal
   anchors, and neighbouring windows mostly share one. Every chunk sends the distinct hashes of its anchors to hash buckets.
   An anchor that occurs once in the corpus can have no internal tree node of full depth, so its suffixes are never shipped.
2. partition: the suffixes that remain go, with their words, to groups cut by variable-length prefixes: the cuts are the
   shortest word prefixes that separate quantiles of the anchors of sampled chunks, so that a group fits in memory. Runs of
   suffixes with one anchor travel as one piece of text. Each chunk ships a window's sequence once: its later copies inside
   the chunk are known to be repeats, so a passage that stands in a third of all documents puts one row per chunk into its
   group.
3. subtrees: each group numbers its words in their order, sorts its suffixes by their words (names of runs of three, nine
   and more words, as in building a suffix array) and counts the words that each suffix shares with its neighbour; the
   internal nodes of full depth are the repeats. Of the leaves below such a node all but the first are marked.
4. the marks return to their chunks, which merge marked windows into spans and drop the covered words.

Hashes only choose anchors and candidates; what counts as equal is decided by the words themselves.

Edge cases: a null or empty text has no words; texts shorter than the window keep everything; repeated rows with the same
doc_id count as one document read again, later rows being the later copies; a null doc_id comes last; an empty table gives no
rows; extra columns of any name pass through, and an added column whose name is taken gets underscores before it. The
identifier is an integer.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm import store, words

#: Text bytes of a chunk, census entries of a bucket, and suffixes of a group that one task holds in memory.
CHUNK_BYTES, BUCKET_ENTRIES, GROUP_SUFFIXES = 3_000_000, 600_000, 500_000
#: Chunks, about, and suffixes per chunk that the sample for the prefix cuts takes.
SAMPLE_CHUNKS, SAMPLE_SUFFIXES = 48, 2_000

def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(blob)))


def _planes(values: np.ndarray) -> bytes:
    """Integers as byte planes of their differences: what changes slowly takes little room."""
    step = np.diff(values, prepend=values[:1] * 0)
    return zstandard.ZstdCompressor(level=1).compress(step.view(np.uint8).reshape(len(values), -1).T.tobytes())


def _from_planes(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel(), dtype=kind)


def _chunks(text: str) -> object:
    @store.trimmed
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, ordinal = TaskContext.get(), 0
        base = (context.partitionId() if context else 0) << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            batch = table.to_batches()[0]
            data, offsets = words.text_buffer(batch.column(text))
            n = len(words.find_words(data, offsets)[0])
            return pa.record_batch({"chunk": pa.array([base + ordinal]), "n_words": pa.array([n]), "docs": pa.array([_packed(batch)], pa.binary())})

        for batch in batches:
            for begin, end in words.pieces(batch.column(text), CHUNK_BYTES // 4):
                piece = batch.slice(begin, end - begin)
                more = int(words.text_buffer(piece.column(text))[1][-1])
                if held and size + more > CHUNK_BYTES:
                    yield flush()
                    held, size, ordinal = [], 0, ordinal + 1
                held.append(piece)
                size += more
        if held:
            yield flush()

    return pack


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the words at these places of a buffer: equal for equal words, and in the words' order."""
    edges = np.stack([starts, ends], axis=1).ravel()
    kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
    # every other element is what stands between two words
    coded = pa.Array.from_buffers(kind, len(edges) - 1, [None, pa.py_buffer(edges.astype(width)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
    return place[coded.indices.to_numpy()[::2]]


class _Suffixes:
    """The suffixes of one chunk: validity, and the anchor of every window."""

    def __init__(self, batch: pa.RecordBatch, text: str, window: int):
        self.data, self.offsets = words.text_buffer(batch.column(text))
        self.starts, self.ends, self.docs = words.find_words(self.data, self.offsets)
        self.window, self.half = window, max(1, window // 2)
        n = len(self.starts)
        self.n_windows = max(0, n - window + 1)
        if not self.n_windows:
            self.valid, self.anchor, self.sampled = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        self.hashes = words.hash_words(self.data, self.starts, self.ends)
        end_of_doc = np.repeat(self.docs[1:], np.diff(self.docs))
        self.valid = np.arange(self.n_windows) + window <= end_of_doc[: self.n_windows]
        # prefixes that would cross a document's end never belong to a valid window
        self.prefix, width = self.labels(self.half), window - self.half + 1
        self.sampled = _sliding(self.prefix, width, np.minimum)[: self.n_windows]
        self.anchor = np.full(self.n_windows, -1)
        for k in range(width):
            found = np.flatnonzero((self.anchor < 0) & (self.prefix[k : k + self.n_windows] == self.sampled))
            self.anchor[found] = found + k

    def labels(self, length: int) -> np.ndarray:
        """A hash of the `length` words from every word on."""
        n = len(self.hashes) - length + 1
        sums = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j, c in enumerate(words.constants(length, 71)):
                sums += self.hashes[j : j + n] * c
        return words.mix(sums)

    def census(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors' hashes, and whether each stands at two or more places of the chunk."""
        if not self.n_windows:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        found, counts = np.unique(self.prefix[np.unique(self.anchor[self.valid])], return_counts=True)
        return found, counts > 1

    def known(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which of these windows also start earlier among them: equal hashes propose, the words decide."""
        label = self.labels(self.window)[at]
        order = np.lexsort((at, doc, label))
        first = np.flatnonzero(np.diff(label[order], prepend=~label[order[:1]]))
        head = np.repeat(at[order[first]], np.diff(np.append(first, len(at))))
        same = head != at[order]
        rows = np.flatnonzero(same)
        numbers = word_numbers(self.data, self.starts, self.ends)
        for k in range(self.window):
            rows = rows[numbers[head[rows] + k] == numbers[at[order[rows]] + k]]
        again = np.zeros(len(at), bool)
        again[order[rows]] = True
        return again

    def words_from(self, first: int, n: int, raw: bytes) -> bytes:
        """n words from the given one on, joined by one space."""
        return b" ".join(raw[self.starts[first] : self.ends[first + n - 1]].split())


def _sliding(values: np.ndarray, width: int, fold: np.ufunc) -> np.ndarray:
    """fold over every `width` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = fold(out[:-have], out[have:]), have * 2
    return fold(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _names(parts: list[np.ndarray]) -> np.ndarray:
    """One number for each tuple that stands at a place of all parts; numbers are in the order of the tuples."""
    key, size = parts[0], int(parts[0].max(initial=0)) + 1
    for part in parts[1:]:
        more = int(part.max(initial=0)) + 1
        if size.bit_length() + more.bit_length() > 62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max(initial=0)) + 1
        key, size = key * more + part, size * more
    return np.unique(key, return_inverse=True)[1]


def suffix_order(numbers: np.ndarray, at: np.ndarray, ties: tuple[np.ndarray, ...], window: int) -> np.ndarray:
    """Order of the suffixes that start at `at` of a word sequence, by their first `window` words and then by the ties."""
    named, length = numbers, 1
    while length * 3 <= window:
        n = len(named) - 2 * length
        named, length = _names([named[k * length : k * length + n] for k in range(3)]), length * 3
    steps = [*range(0, window - length, length), window - length]
    return np.lexsort((*ties[::-1], _names([named[at + k] for k in steps])))


def common_prefixes(numbers: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Words, up to `window`, that each suffix shares with the one before it."""
    depth = np.zeros(len(at), np.int64)
    rows = np.arange(1, len(at))
    for k in range(window):
        rows = rows[numbers[at[rows] + k] == numbers[at[rows - 1] + k]]
        depth[rows] += 1
    return depth


_CENSUS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("prefixes", T.BinaryType()), T.StructField("many", T.BinaryType())])
_KNOWN = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("prefixes", T.BinaryType())])
_SUFFIXES = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "chunk")] + [T.StructField(n, T.BinaryType()) for n in ("text", "doc", "at", "n")])
_MARKS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("at", T.BinaryType())])


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> tuple[DataFrame, DataFrame]:
    """Chunks (chunk, n_words, docs) of the documents, and per chunk the marked windows (chunk, marks)."""
    spark = docs.sparkSession
    chunks = store.materialize(docs.mapInArrow(_chunks(text), "chunk long, n_words long, docs binary"), "chunks")
    n_chunks, n_words = chunks.agg(F.count("chunk"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    least = store.shuffle_partitions(spark)
    n_buckets = max(least, n_words // 5 // BUCKET_ENTRIES + 1)
    n_groups = max(least, n_words // 3 // GROUP_SUFFIXES + 1)

    @store.trimmed
    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("docs"), strict=True):
                found, many = _Suffixes(_unpacked(blob.as_buffer()), text, window).census()
                bucket = (found >> np.uint64(32)).astype(np.int64) * n_buckets >> 32
                cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
                used = np.flatnonzero(np.diff(cuts))
                yield pa.record_batch([pa.array(used), pa.array(np.full(len(used), chunk)), pa.array([found[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()), pa.array([np.packbits(many[cuts[b] : cuts[b + 1]]).tobytes() for b in used], pa.binary())], names=["bucket", "chunk", "prefixes", "many"])

    def known(group: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["prefixes"]]
        many = np.concatenate([np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8), count=len(v)) for b, v in zip(group["many"], lists, strict=True)]).astype(bool)
        values = np.concatenate(lists)
        found, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
        again = (counts > 1)[inverse] | (np.bincount(inverse, many) > 0)[inverse]
        ends = np.cumsum([len(x) for x in lists])
        kept = [values[e - len(x) : e][again[e - len(x) : e]].tobytes() for e, x in zip(ends, lists, strict=True)]
        return pa.table({"chunk": group["chunk"], "prefixes": pa.array(kept, pa.binary())}).filter(pa.array([bool(x) for x in kept]))

    repeated = chunks.select("chunk", "docs").mapInArrow(census, _CENSUS).groupBy("bucket").applyInArrow(known, _KNOWN)
    repeated = repeated.groupBy(F.col("chunk").alias("of")).agg(F.collect_list("prefixes").alias("prefixes"))
    cuts = _cuts(chunks.filter(F.pmod(F.xxhash64("chunk"), F.lit(n_chunks // SAMPLE_CHUNKS + 1)) == 0), text, window, n_groups)

    @store.trimmed
    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, prefixes in zip(batch.column("chunk").to_pylist(), batch.column("docs"), batch.column("prefixes"), strict=True):
                if not prefixes.is_valid:
                    continue
                lists = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in prefixes.values]))
                docs = _unpacked(blob.as_buffer())
                own = _Suffixes(docs, text, window)
                place = np.minimum(np.searchsorted(lists, own.sampled), len(lists) - 1)
                at = np.flatnonzero(own.valid & (lists[place] == own.sampled))
                if not len(at):
                    continue
                ids = _ids(docs.column(doc_id))
                doc = ids[np.searchsorted(own.docs, at, "right") - 1]
                again = own.known(at, doc)
                rows = [(-1 - chunk, b"", b"", at[again].astype(np.uint32).tobytes(), b"")] if again.any() else []
                at, doc = at[~again], doc[~again]
                # a run: suffixes at neighbouring words, with one anchor and so in one document
                first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(own.anchor[at], prepend=-1) != 0))
                n = np.diff(np.append(first, len(at)))
                raw = own.data.tobytes()
                part = np.array([bisect_right(cuts, own.words_from(a, own.half, raw)) for a in own.anchor[at[first]].tolist()], np.int64)
                listed = [own.words_from(a, k + window - 1, raw) for a, k in zip(at[first].tolist(), n.tolist(), strict=True)]
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(n_groups + 1))
                for p in np.flatnonzero(np.diff(ends)).tolist():
                    runs = order[ends[p] : ends[p + 1]]
                    packed = zstandard.ZstdCompressor(level=1).compress(b"\n".join([listed[r] for r in runs.tolist()]))
                    rows.append((p, packed, _planes(doc[first[runs]]), at[first[runs]].astype(np.uint32).tobytes(), n[runs].astype(np.uint16).tobytes()))
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3, 4))], names=_SUFFIXES.names)

    def marks(group: pa.Table) -> pa.Table:
        if group["part"][0].as_py() < 0:  # known inside their chunk
            return group.select(["chunk", "at"])
        unpack = zstandard.ZstdDecompressor().decompress
        data = np.frombuffer(b"\n".join(unpack(x.as_buffer(), max_output_size=1 << 31) for x in group["text"]), np.uint8)
        numbers = word_numbers(data, *words.find_words(data, np.array([0, len(data)]))[:2])
        places, n = ([np.frombuffer(x.as_buffer(), kind).astype(np.int64) for x in group[name]] for name, kind in (("at", np.uint32), ("n", np.uint16)))
        row = np.repeat(np.arange(len(n)), [int(x.sum()) for x in n])
        n = np.concatenate(n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        size = n + window - 1
        at = np.repeat(np.cumsum(size) - size, n) + inside
        place = np.repeat(np.concatenate(places), n) + inside
        doc = np.repeat(np.concatenate([_from_planes(x.as_py(), np.int64) for x in group["doc"]]), n)
        chunk_of = np.array(group["chunk"].to_pylist(), np.int64)
        order = suffix_order(numbers, at, (doc, chunk_of[row], place), window)
        deep = common_prefixes(numbers, at[order], window) >= window
        hit = np.sort(order[deep])
        ends = np.searchsorted(row[hit], np.arange(len(chunk_of) + 1))
        used = np.flatnonzero(np.diff(ends))
        return pa.table({"chunk": pa.array(chunk_of[used]), "at": pa.array([place[hit[ends[r] : ends[r + 1]]].astype(np.uint32).tobytes() for r in used], pa.binary())})

    shipped = chunks.select("chunk", "docs").join(repeated, F.col("chunk") == F.col("of"), "left").select("chunk", "docs", "prefixes").mapInArrow(ship, _SUFFIXES)
    found = shipped.groupBy("part").applyInArrow(marks, _MARKS)
    return chunks, found.groupBy(F.col("chunk").alias("of")).agg(F.collect_list("at").alias("marks"))


def _ids(column: pa.Array) -> np.ndarray:
    """Document numbers; a null comes last."""
    return np.array(column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_pylist(), np.int64)


def _cuts(chunks: DataFrame, text: str, window: int, n_groups: int) -> list[bytes]:
    """Shortest word prefixes that separate the n_groups quantiles of the anchors of a few sampled chunks."""

    @store.trimmed
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("docs"):
                own = _Suffixes(_unpacked(blob.as_buffer()), text, window)
                at = np.unique(own.anchor[own.valid])
                at = at[:: max(1, len(at) // SAMPLE_SUFFIXES)][:SAMPLE_SUFFIXES]
                raw = own.data.tobytes()
                yield pa.record_batch({"prefix": pa.array([own.words_from(a, own.half, raw) for a in at.tolist()], pa.binary())})

    few = sorted({bytes(r["prefix"]) for r in chunks.select("docs").mapInArrow(sample, "prefix binary").collect()})
    cuts = set()
    for k in range(1, n_groups) if len(few) > 1 else ():
        place = min(max(1, k * len(few) // n_groups), len(few) - 1)
        before, after = few[place - 1].split(), few[place].split()
        same = next((i for i, (x, y) in enumerate(zip(before, after, strict=False)) if x != y), min(len(before), len(after)))
        cuts.add(b" ".join(after[: same + 1]))
    return sorted(cuts)


#: Columns that remove_repeats adds.
ADDED = ("n_words", "n_removed", "kept_sha256", "spans")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, added: tuple[str, str, str, str] = ADDED) -> DataFrame:
    """The documents with the words of repeated windows removed.

    All columns return; a text that lost words becomes its kept words joined by one space, any other stays as it was. Added:
    n_words, n_removed, kept_sha256 (of the kept words joined by one space) and spans, the removed word ranges, under the names
    `added`, with underscores before those that docs already has.
    """
    chunks, marked = find_repeats(docs, doc_id, text, window)
    added = tuple(store.free_name(docs, name) for name in added)
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, added, (T.LongType(), T.LongType(), T.StringType(), T.ArrayType(T.ArrayType(T.LongType()))))])

    @store.trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, found in zip(batch.column("docs"), batch.column("marks"), strict=True):
                own = _unpacked(blob.as_buffer())
                data, offsets = words.text_buffer(own.column(text))
                at = words.find_words(data, offsets)[2]
                cover = np.zeros(int(at[-1]) + 1, np.int32)
                if found.is_valid:
                    starts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in found.values]).astype(np.int64)
                    cover += np.bincount(starts, minlength=len(cover)).astype(np.int32)
                    cover -= np.bincount(starts + window, minlength=len(cover)).astype(np.int32)[: len(cover)]
                gone = np.cumsum(cover)[:-1] > 0
                texts, digests, n_words, n_removed, spans = own.column(text).to_pylist(), [], [], [], []
                raw = data.tobytes()
                for k, old in enumerate(texts):
                    listed = raw[offsets[k] : offsets[k + 1]].split()
                    mask = gone[at[k] : at[k + 1]]
                    lost = int(np.count_nonzero(mask))
                    if lost:
                        listed = list(compress(listed, (~mask).tolist()))
                        edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                        spans.append(edges.reshape(-1, 2).tolist())
                    else:
                        spans.append([])
                    kept = b" ".join(listed)
                    texts[k] = kept.decode() if lost else old
                    n_words.append(len(mask))
                    n_removed.append(lost)
                    digests.append(hashlib.sha256(kept).hexdigest())
                columns = [pa.array(texts, f.type) if f.name == text else own.column(i) for i, f in enumerate(own.schema)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=schema.names)

    joined = chunks.select("chunk", "docs").join(marked, F.col("chunk") == F.col("of"), "left").select("docs", "marks")
    return joined.mapInArrow(cut, schema)
