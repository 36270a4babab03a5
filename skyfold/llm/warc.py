"""WARC records in seekable Zstandard bundles.

A bundle is one archive: records are grouped into frames that decompress on their own, a skippable frame at the end holds the
seek table of the frames' compressed and plain sizes, and the bundle's index maps each record identifier to its frame and the
offset inside it. Bundles are rows of a Parquet table (archive bytes and index), which any file system that Spark writes to can
hold and which a failed task writes anew without leaving half a file.

Payloads with equal bytes are stored once: the row with the largest identifier is the response, the others are revisit records
that refer to it and carry the full payload's digest and length. Only digests and identifiers are shuffled to find them, a
digest's rows are reduced to their maximum before the shuffle, and only digests that occur more than once come back to the
pages, by broadcast if they are small and else by a join salted against a very common payload.

Edge cases: null html is an empty payload; payloads below `least_bytes` are always responses; pages of one identifier and
payload that stand there twice are both responses; null urls give an empty target, and control characters and spaces at a
url's ends are percent-encoded in the header; extra columns are ignored; an empty table gives no bundles. A page
with a null identifier is never referred to: its record has an identifier of its own (hashed from its place), is a revisit
without a reference (as in the query's SQL) unless it is below `least_bytes`, and keeps its payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm import store

#: Plain bytes of a frame and of a bundle.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 16 << 20
#: Rows of repeated digests up to which they are broadcast (32 bytes each).
BROADCAST_ROWS = 200_000
SALTS = 32

# fixed values of the seekable Zstandard format and of WARC
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_VERSION = b"WARC/1.1\r\n"


def record_id(page_id: int) -> str:
    """A version 8 UUID that carries the 64-bit identifier."""
    n = page_id & 0xFFFFFFFFFFFFFFFF
    return f"<urn:uuid:{n >> 32:08x}-{n >> 16 & 0xFFFF:04x}-8000-8000-00000000{n & 0xFFFF:04x}>"


def nameless_id(place: str) -> str:
    """A version 5 UUID for a page without an identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"


def page_of(record: str) -> int | None:
    a, b, kind, _, e = record.removeprefix("<urn:uuid:").removesuffix(">").split("-")
    if kind[0] == "5":
        return None
    n = int(a, 16) << 32 | int(b, 16) << 16 | int(e, 16)
    return n - (1 << 64) if n >> 63 else n


def target(url: str) -> str:
    """The url as a header value: what could end or trim a header line is percent-encoded."""
    ends = len(url) - len(url.lstrip()), len(url.rstrip())
    return "".join(quote(c) if not c.isprintable() and not c.isalpha() or c.isspace() and not ends[0] <= k < ends[1] else c for k, c in enumerate(url))


def write_record(page_id: int, url: str, date: str, payload: bytes, digest: bytes, refers_to: int | None, nameless: str | None = None, again: bool = False) -> bytes:
    """The record's bytes; a page without an identifier takes the record identifier `nameless` and is a revisit if `again`."""
    name = base64.b32encode(digest).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        f"WARC-Type: {'response' if refers_to is None and not again else 'revisit'}",
        f"WARC-Record-ID: {nameless or record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{name}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        block += payload
        if again:
            lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    else:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return _VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record that starts at an offset."""
    end = data.index(b"\r\n\r\n", at)
    if not data.startswith(_VERSION, at):
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at + len(_VERSION) : end].decode().split("\r\n"))
    return fields, data[end + 4 : end + 4 + int(fields["Content-Length"])]


class Bundle:
    """Records written one after the other into frames."""

    def __init__(self) -> None:
        self._zstd = zstandard.ZstdCompressor(level=3)
        self._open, self._frames, self._sizes, self.index = bytearray(), [], [], []
        self.size = 0

    def add(self, identifier: int | None, record: bytes) -> None:
        self.index.append((identifier, len(self._frames), len(self._open)))
        self._open += record
        self.size += len(record)
        if len(self._open) >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self._open:
            frame = self._zstd.compress(bytes(self._open))
            self._frames.append(frame)
            self._sizes.append((len(frame), len(self._open)))
            self._open = bytearray()

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *s) for s in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, _SEEKABLE)
        return b"".join(self._frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(archive: bytes) -> np.ndarray:
    """(start, compressed size, plain size) of each frame, from the archive's end."""
    n, descriptor, magic = struct.unpack("<IBI", archive[-9:])
    if magic != _SEEKABLE:
        raise ValueError("the archive has no seek table")
    width = 12 if descriptor & 0x80 else 8
    sizes = np.frombuffer(archive[-9 - width * n : -9], "<u4").reshape(n, width // 4).astype(np.int64)
    return np.column_stack([np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes[:, :2]])


def read_frame(archive: bytes, table: np.ndarray, frame: int) -> bytes:
    start, packed, plain = table[frame].tolist()
    return zstandard.ZstdDecompressor().decompress(archive[start : start + packed], max_output_size=plain)


def _repeated(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, last) of the payloads that occur more than once."""
    keys = pages.select("digest", "page_id").filter(F.col("size") >= least_bytes)
    return keys.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "last")


def write_bundles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Stores the pages as bundles: (bundle string, archive binary, index array of (page_id, frame, offset)), one row a bundle.

    `bundle` names the writing partition and the bundle's place there, so that lookups need not read archives to tell them apart.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    named = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"), F.unhex(F.sha1(body)).alias("digest"), F.octet_length(body).alias("size"))
    again = store.materialize(_repeated(named, least_bytes), "digests")
    joined = named.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = joined.join(F.broadcast(again.withColumnRenamed("digest", "of")), F.col("digest") == F.col("of"), "left")
    else:
        salted = again.select(F.col("digest").alias("of"), "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
        joined = joined.join(salted, (F.col("digest") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    refers = F.when((F.col("size") >= least_bytes) & (F.col("last") != F.col("page_id")), F.col("last"))

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, part, nameless, written = Bundle(), TaskContext.get().partitionId(), 0, 0

        def out() -> pa.RecordBatch:
            ids, frames, offsets = zip(*bundle.index, strict=True)
            index = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int32())], ["page_id", "frame", "offset"])
            return pa.record_batch({"bundle": [f"{part:06d}-{written:06d}"], "archive": pa.array([bundle.finish()], pa.binary()), "index": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), index)})

        for batch in batches:
            for p, u, b, d, r in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                p, name, payload = p.as_py(), None, b.as_py()
                if p is None:
                    name, nameless = nameless_id(f"{d.as_py().hex()}-{part}-{nameless}"), nameless + 1
                bundle.add(p, write_record(p, u.as_py(), date, payload, d.as_py(), r.as_py(), name, p is None and len(payload) >= least_bytes))
                if bundle.size >= BUNDLE_BYTES:
                    yield out()
                    bundle, written = Bundle(), written + 1
        if bundle.index:
            yield out()

    shaped = joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return store.materialize(shaped.mapInArrow(run, "bundle string, archive binary, index array<struct<page_id:long,frame:int,offset:int>>"), "bundles")


def record_index(bundles: DataFrame) -> DataFrame:
    """(page_id, bundle, frame, offset) of every record that has an identifier, for equality joins; written as a table and sorted by page_id,
    it answers lookups alone."""
    return bundles.select("bundle", F.explode("index").alias("e")).filter("e.page_id IS NOT NULL").select("e.page_id", "bundle", "e.frame", "e.offset")


def read_by_id(bundles: DataFrame, wanted: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(page_id, record) of the wanted identifiers: only the frames that hold them are decompressed.

    Identifiers that no record has give no row; one that several records have gives each.
    """
    # only the index column is read to cut it down to the wanted records; Spark broadcasts what is left where its size is small
    entries = record_index(bundles).join(wanted.select(F.col(page_id).alias("page_id")).distinct(), "page_id", "left_semi")
    entries = entries.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "page_id"))).alias("entries"))
    held = bundles.select("bundle", "archive").join(entries, "bundle").select("archive", "entries")

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, entries in zip(batch.column("archive"), batch.column("entries").to_pylist(), strict=True):
                archive = blob.as_py()
                table, held, data = seek_table(archive), -1, b""
                for e in entries:
                    if e["frame"] != held:
                        held, data = e["frame"], read_frame(archive, table, e["frame"])
                    fields, block = read_record(data, e["offset"])
                    if page_of(fields["WARC-Record-ID"]) != e["page_id"]:
                        raise ValueError("the index points at another record")
                    yield pa.record_batch([pa.array([e["page_id"]], pa.int64()), pa.array([block], pa.binary())], names=["page_id", "record"])

    return held.mapInArrow(run, "page_id long, record binary")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Reads every record through the index and the seek table; a payload whose digest differs from its header fails."""

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, entries in zip(batch.column("archive"), batch.column("index").to_pylist(), strict=True):
                archive = blob.as_py()
                table, held, data = seek_table(archive), -1, b""
                rows = []
                for e in entries:
                    if e["frame"] != held:
                        held, data = e["frame"], read_frame(archive, table, e["frame"])
                    fields, block = read_record(data, e["offset"])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    kind = fields["WARC-Type"]
                    if page_of(fields["WARC-Record-ID"]) != e["page_id"]:
                        raise ValueError("the index points at another record")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"page {e['page_id']}: its payload does not match its digest")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((e["page_id"], len(payload) if kind == "response" else int(fields["X-Payload-Length"]), digest, kind, page_of(refers) if refers else None))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
