"""Near copies by SimHash: documents whose sets of word shingles reach a Jaccard similarity.

A document's fingerprint is a SimHash of its distinct words, as edits that break several shingles each change few words: 32 bits
a segment, by default four segments. Copies whose fingerprints differ in at most seven of the 128 bits have a segment that
differs in at most one, so each segment is indexed under its 32 variants with one bit left out; equal keys make candidates, and
candidates whose fingerprints are not far apart are verified on the whole shingle sets. Equal sets count once, and under each
key all members are compared with the smallest, so that a large group of copies costs a link a member. Where edits are
scattered, this finds most pairs; where a fifth of a text is new in one block, the fingerprints lie farther apart.

An exact way finishes the job (`exact`), and all of it works on those sets alone that can have a partner. Similar sets share at
least `least` of each one's shingles, so a census of all shingles comes first: slices of documents send their hashes, cut to 40
bits and packed, to buckets, which count for every document how many stand in another one too. Sets with too few are settled;
equal cut hashes only let a set through that need not be. Of the others the shingles are listed, those that no second one of
them has are dropped, and the rest are ordered by the number of sets they stand in: in any common order, two similar sets share
one of the first n - o + 1 shingles of each, o being the overlap that their sizes ask for.

Sets that share such a shingle are first compared with one set a shingle, in rounds with other pivots while shingles stand in
more than `HEAVY` groups and links are found, so that a large group of near copies costs a link a member. What then still lies
in different groups is compared pair by pair, unless the places of the shared shingle rule it out, or the numbers of repeated
shingles in each of `PARTS` parts of the hash range, whose minima bound the overlap from above.

Members of one key stream through a task in sorted order, and nothing of them is held. Texts and shingle sets are shuffled only
where a bitmap of bounded size says that they may have a partner in a join; the others stay where they lie.

Edge cases: null or wordless texts equal each other and nothing else; with fewer words than a shingle the whole sequence is the
one shingle; ASCII case and white space don't count; rows with one identifier are one document, compared by each of its texts;
rows without an identifier must be left out; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm import store, words
from skyfold.llm.components import connected_components
from skyfold.llm.simhash import majority
from skyfold.llm.substring_dedup import _from_planes, _planes

#: Text bytes whose words are hashed at once.
SLICE_BYTES = 2_000_000
#: Groups a shingle and links found from which another round of pivots follows, and rounds at most.
HEAVY, SLACK_LEAST, ROUNDS = 64, 6, 3
#: Documents of a slice of the census, entries of a bucket, and parts of the hash range that bound an overlap.
SLICE_DOCS, BUCKET_ENTRIES, PARTS = 500, 3_000_000, 32
#: Share of differing bits up to which candidates of the fingerprints are verified; the exact search finds what lies beyond.
NEAR = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sets(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the sorted distinct hashes of its shingles and of its words."""
    for begin, end in words.pieces(column, SLICE_BYTES):
        data, offsets = words.text_buffer(column.slice(begin, end - begin))
        data = _LOWER[data]
        starts, ends, docs = words.find_words(data, offsets)
        h = words.hash_words(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        weights = words.constants(shingle, 53)
        with np.errstate(over="ignore"):
            sums = np.zeros(max(0, len(h) - shingle + 1), np.uint64)
            for k in range(shingle):
                sums += h[k : k + len(sums)] * weights[k]
            sums = words.mix(sums)
            for a, b in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True):
                if b - a >= shingle:
                    own = np.unique(sums[a : b - shingle + 1])
                elif b > a:
                    own = words.mix((h[a:b] * weights[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
                else:
                    own = h[:0]
                yield own, np.unique(h[a:b])


def _low(set_key: bytes) -> int:
    return int.from_bytes(set_key[:8], "little", signed=True)


def _prefix(size: int, least: float) -> int:
    """Shingles of a set of which similar sets share one."""
    return size - int(np.ceil(least * size - 1e-9)) + 1 if size else 0


def _marked(docs: DataFrame, doc_id: str, text: str, shingle: int, seed: int, segments: int) -> DataFrame:
    """Per row: doc_id, set_key (a digest of its shingle set), low (its first 64 bits), the set's size and the fingerprint, two segments a number."""
    seeds = words.constants(segments // 2, seed)

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, prints, held, sizes, total = [], [], [], [], [], 0

            def flush(prints=prints, held=held, sizes=sizes) -> None:
                every, n = np.concatenate(held), np.array(sizes, np.int64)
                with np.errstate(over="ignore"):
                    prints.append(np.stack([majority(words.mix(every * s), n) for s in seeds]).view(np.int64))
                held.clear()
                sizes.clear()

            for shingles, distinct in _sets(batch.column(text), shingle):
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                counts.append(len(shingles))
                held.append(distinct)
                sizes.append(len(distinct))
                total += len(distinct)
                if total > 400_000:
                    flush()
                    total = 0
            if held:
                flush()
            found = np.concatenate(prints, axis=1) if prints else np.zeros((len(seeds), 0), np.int64)
            yield pa.record_batch([batch.column(doc_id), pa.array(keys, pa.binary()), pa.array(map(_low, keys), pa.int64()), pa.array(counts, pa.int32()), *map(pa.array, found)], names=["doc_id", "set_key", "low", "size", *(f"p{k}" for k in range(len(seeds)))])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, set_key binary, low long, size int, " + ", ".join(f"p{k} long" for k in range(len(seeds))))


def _texts(docs: DataFrame, doc_id: str, text: str, sets: DataFrame, bitmap: DataFrame | None = None) -> DataFrame:
    """(node, set_key, text) of the documents that `sets` (node, set_key, id, ...) names; another text of that number may be among
    them. Texts that no number in `bitmap` can have, by default a bitmap of the sets' numbers, are not shuffled."""
    bitmap = store.key_bitmap(sets.select("id")) if bitmap is None else bitmap
    owners = sets.select(F.col("id").alias("_doc"), "set_key", "node")
    named = store.by_bitmap(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")), "_id", bitmap).join(owners, F.col("_id") == F.col("_doc"))
    return named.select("node", "set_key", "text")


def _one_of_each(docs: DataFrame, doc_id: str, text: str, marked: DataFrame, sets: DataFrame) -> DataFrame:
    """As `_texts`, with the first 64 bits of set_key for the node: of every set the texts under its number.

    Only texts whose number has another text or stands for a copy are looked up. The others, most of them, stay where they lie:
    set_key is null there, and the node only orders them.
    """
    copies = marked.select("doc_id", "set_key").join(sets.select(F.col("set_key").alias("_key"), "id"), F.col("set_key") == F.col("_key")).filter("doc_id != id")
    bitmap = store.key_bitmap(copies.select("doc_id"))
    rest = store.by_bitmap(docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("text")), "_id", bitmap, among=False)
    owners = store.by_bitmap(sets.select("id", "set_key", F.col("low").alias("node")), "id", bitmap)
    return rest.select(F.xxhash64("_id", "text").alias("node"), F.lit(None).cast("binary").alias("set_key"), "text").unionByName(_texts(docs, doc_id, text, owners, bitmap))


def _owned(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Nodes and shingle sets of every slice of a batch of `_texts`, without other texts of their numbers."""
    for begin in range(0, batch.num_rows, SLICE_DOCS):
        part = batch.slice(begin, SLICE_DOCS)
        wanted, node, nodes, found = part.column("set_key").to_pylist(), part.column("node").to_pylist(), [], []
        for i, (own, _) in enumerate(_sets(part.column("text"), shingle)):
            digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            if len(own) and wanted[i] in (None, digest):
                nodes.append(node[i] if wanted[i] else _low(digest))
                found.append(own)
        if nodes:
            yield np.array(nodes, np.int64), found


def _census(texts: DataFrame, shingle: int, n_buckets: int) -> DataFrame:
    """(node, repeated): of each set the number of shingles that stand in another one too, or that look so by 40 bits of their hashes."""

    @store.trimmed
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, found in _owned(batch, shingle):
                owner = np.repeat(np.arange(len(found), dtype=np.uint16), [len(x) for x in found])
                values = np.concatenate(found)
                order = np.argsort(values)
                values, owner = values[order], owner[order]
                bucket = ((values >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
                used = np.flatnonzero(np.diff(cuts)).tolist()
                chunk = int.from_bytes(hashlib.blake2b(nodes.tobytes(), digest_size=8).digest(), "little", signed=True)
                keys = [_planes((values[cuts[u] : cuts[u + 1]] >> np.uint64(24)).astype(np.int64)) for u in used]
                owners = [owner[cuts[u] : cuts[u + 1]].astype("<u2").tobytes() for u in used]
                # the nodes themselves travel once
                yield pa.record_batch([pa.array([*used, -1 - chunk % n_buckets], pa.int64()), pa.array([chunk] * (len(used) + 1), pa.int64()), pa.array([*keys, None], pa.binary()), pa.array([*map(zstandard.compress, owners), nodes.tobytes()], pa.binary())], names=["bucket", "chunk", "keys", "owners"])

    def counted(group: pa.Table) -> pa.Table:
        if group["bucket"][0].as_py() < 0:
            return pa.table({"chunk": group["chunk"], "nodes": group["owners"], "counts": pa.nulls(len(group), pa.binary())})
        lists = [_from_planes(x.as_py(), np.int64) for x in group["keys"]]
        values = np.concatenate(lists)
        order = np.argsort(values)
        same = np.diff(values[order]) == 0
        again = np.zeros(len(values), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        ends, counts = np.cumsum([len(x) for x in lists]), []
        for x, end, owners in zip(lists, ends, group["owners"], strict=True):
            owner = np.frombuffer(zstandard.decompress(owners.as_py()), "<u2")
            counts.append(zstandard.compress(np.bincount(owner[again[end - len(x) : end]]).astype("<u4").tobytes()))
        return pa.table({"chunk": group["chunk"], "nodes": pa.nulls(len(group), pa.binary()), "counts": pa.array(counts, pa.binary())})

    @store.trimmed
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, counts in zip(batch.column("nodes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                nodes = np.frombuffer(nodes, np.int64)
                total = np.zeros(len(nodes), np.int32)
                for blob in counts:
                    part = np.frombuffer(zstandard.decompress(blob), "<u4")
                    total[: len(part)] += part.astype(np.int32)
                yield pa.record_batch([pa.array(nodes), pa.array(total)], names=["node", "repeated"])

    # a slice's rows and their order are the same whenever a task runs again
    packed = texts.sortWithinPartitions("node").mapInArrow(listed, "bucket long, chunk long, keys binary, owners binary")
    found = packed.groupBy("bucket").applyInArrow(counted, "chunk long, nodes binary, counts binary")
    found = found.groupBy("chunk").agg(F.max("nodes").alias("nodes"), F.collect_list("counts").alias("counts"))
    return found.select("nodes", "counts").mapInArrow(summed, "node long, repeated int").groupBy("node").agg(F.max("repeated").alias("repeated"))


def _profiles(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the sets (node, size, ...) with enough shingles among `rows` (node, shingle) that another one has: held, these shingles as
    bytes, first, those of them that lie in the set's prefix, alone, the number of others, and parts, counts by part of the hash range."""

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = batch.column("found"), batch.column("size").to_numpy()
            ends = np.cumsum(np.diff(found.offsets.to_numpy()))
            flat = found.flatten().field("shingle").to_numpy()
            held, first, alone, parts = [], [], [], []
            for size, begin, end in zip(sizes.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                own = flat[begin:end]
                held.append(np.sort(own.view(np.uint64)).tobytes())
                alone.append(size - len(own))
                first.append(own[: max(0, _prefix(size, least) - alone[-1])])
                parts.append(np.bincount(own.view(np.uint64).astype(np.int64) & (PARTS - 1), minlength=PARTS).astype(np.int16) if size < 1 << 15 else None)
            yield pa.record_batch([batch.column("node"), pa.array(held, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(alone, pa.int32()), pa.array(parts, pa.list_(pa.int16()))], names=["node", "held", "first", "alone", "parts"])

    count = F.count(F.lit(1)).over(Window.partitionBy("shingle"))
    rows = rows.repartition("shingle").dropDuplicates(["shingle", "node"]).withColumn("n", count).filter("n > 1")
    rows = rows.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("found"))
    rows = rows.join(sets.select("node", "size"), "node").filter(F.size("found") >= F.ceil(F.col("size") * least - 1e-9))
    kind = "node long, held binary, first array<long>, alone int, parts array<short>"
    return rows.select("node", "size", "found").mapInArrow(run, kind).join(sets, "node")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, both_sizes in zip(batch.column("x"), batch.column("y"), batch.column("sizes").to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True))
                keep.append(both >= least * (both_sizes - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = store.by_bitmap(sets, "node", store.key_bitmap(pairs.select(F.explode(F.array("a", "b")))))
    side = lambda node, held, size: named.select(F.col("node").alias(node), F.col("held").alias(held), F.col("size").alias(size))
    named = pairs.join(side("b", "y", "m"), "b").join(side("a", "x", "s"), "a")
    return named.select("a", "b", "x", "y", (F.col("m") + F.col("s")).alias("sizes")).mapInArrow(run, "a long, b long")


def _possible(least: float) -> Column:
    """Whether sets of sizes `size` and `m` can be similar, by sizes and by what their parts have in common at most."""
    shared = F.expr(" + ".join(f"cast(least(parts[{k}], w[{k}]) as int)" for k in range(PARTS)))
    near = F.least("size", "m") >= least * F.greatest("size", "m") - 1e-9
    return near & F.coalesce(shared >= least / (1 + least) * (F.col("size") + F.col("m")) - 1e-9, F.lit(True))


def _pivoted(first: DataFrame, least: float, turn: int) -> DataFrame:
    """Pairs (a, b) of one set a shingle, another one each turn, with the shingle's sets of other groups."""
    low = first.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "group", "size", "parts")).alias("low"), F.min("group").alias("g0"), F.max("group").alias("g1")).filter("g0 != g1")
    low = low.select("shingle", F.col("low.node").alias("x"), F.col("low.group").alias("g"), F.col("low.size").alias("m"), F.col("low.parts").alias("w"))
    pairs = first.join(low, "shingle").filter((F.col("g") != F.col("group")) & _possible(least))
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _crossing(first: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different groups that share a prefix shingle and can be similar; one of the two lies outside the shingle's largest group."""
    largest = first.groupBy("shingle", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "group"))["group"].alias("largest"), F.count(F.lit(1)).alias("groups")).filter("groups > 1").drop("groups")
    shared = first.join(largest, "shingle")
    outside = shared.filter("group != largest").select("shingle", F.col("node").alias("x"), F.col("group").alias("g"), F.col("size").alias("m"), F.col("place").alias("at"), F.col("parts").alias("w"))
    once = (F.col("g") != F.col("group")) & ((F.col("group") == F.col("largest")) | (F.col("x") < F.col("node")))
    rest = F.ceil(least / (1 + least) * (F.col("size") + F.col("m")) - 1e-9) - 1  # shingles that may follow the first common one
    n = store.shuffle_partitions(first.sparkSession)  # few bytes, but much work: the join is not to be coalesced
    pairs = outside.repartition(n, "shingle").join(shared.repartition(n, "shingle"), "shingle").filter(once & (F.col("place") <= F.col("size") - rest) & (F.col("at") <= F.col("m") - rest) & _possible(least))
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _variants(segments: int) -> str:
    """Explodable keys: segment, place of the bit left out, and the segment without it."""
    numbers = ", ".join(f"shiftrightunsigned(p{k // 2}, {32 * (k % 2)}) & 4294967295L" for k in range(segments))
    return f"flatten(transform(array({numbers}), (v, k) -> transform(sequence(0, 31), i -> shiftleft(cast(32 * k + i as bigint), 32) | (v & ~shiftleft(1L, i)))))"


@store.trimmed
def _to_the_smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, size) sorted by key and node: the key's smallest node a, b and both sizes."""
    key, low, low_size = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k, n, s = (batch.column(c).to_numpy() for c in ("key", "node", "size"))
        fresh = np.ones(len(k), bool)
        fresh[1:] = k[1:] != k[:-1]
        fresh[0] = k[0] != key
        starts = np.where(fresh, np.arange(len(k)), -1)
        at = np.maximum.accumulate(starts)
        a, m = np.where(at < 0, low, n[at]), np.where(at < 0, low_size, s[at])
        key, low, low_size = k[-1], a[-1], m[-1]
        keep = a != n
        yield pa.record_batch([pa.array(a[keep]), pa.array(n[keep]), pa.array(m[keep].astype(np.int32)), pa.array(s[keep].astype(np.int32))], names=["a", "b", "m", "s"])


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, seed: int = 42, segments: int = 4, exact: bool = True) -> DataFrame:
    """Per row: doc_id, set_key (a digest of its shingle set), component_id, the smallest doc_id that links of similarity `least`
    or more reach, and kept_key, the smallest set_key of that doc_id's texts in the component. Rows are the input's, not fewer."""
    if segments % 2 or segments < 2:
        raise ValueError("segments come in pairs")
    marked = store.materialize(_marked(docs, doc_id, text, shingle, seed, segments), "shingle-sets")
    parts = [f"p{k}" for k in range(segments // 2)]
    # one word sequence or shingle set has one fingerprint, so any of its rows gives it
    sets = marked.groupBy("set_key").agg(F.min("doc_id").alias("id"), *(F.max(p).alias(p) for p in parts), F.max("low").alias("low"), F.max("size").alias("size"))
    sets = store.materialize(sets.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")

    # what no partner is possible for is settled
    n_shingles = sets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_buckets = max(store.shuffle_partitions(docs.sparkSession), n_shingles // BUCKET_ENTRIES + 1)
    # two sets with one low both get the larger count, which settles neither wrongly
    repeated = _census(_one_of_each(docs, doc_id, text, marked, sets), shingle, n_buckets).withColumnRenamed("node", "low")
    candidates = store.materialize(sets.join(repeated, "low").filter(F.col("repeated") >= F.ceil(F.col("size") * least - 1e-9)).drop("repeated", "low"), "candidate-sets")

    @store.trimmed
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, found in _owned(batch, shingle):
                node = np.repeat(nodes, [len(x) for x in found])
                yield pa.record_batch([pa.array(node), pa.array(np.concatenate(found).view(np.int64))], names=["node", "shingle"])

    rows = _texts(docs, doc_id, text, candidates).mapInArrow(listed, "node long, shingle long")
    members = store.materialize(_profiles(rows, candidates.drop("id", "set_key"), least), "members")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = store.materialize(pairs, f"{name}-pairs")
        found = store.materialize(_verified(pairs, members, least), f"{name}-links")
        store.discard(pairs)
        return found

    def grouped(of: DataFrame, links: DataFrame) -> DataFrame:
        joined = connected_components(links).withColumnRenamed("node", "of")
        return of.join(joined, F.col("node") == F.col("of"), "left").withColumn("group", F.coalesce("component", "node")).drop("of", "component")

    keyed = members.select(F.explode(F.expr(_variants(segments))).alias("key"), "node", "size").repartition("key").sortWithinPartitions("key", "node")
    stars = keyed.mapInArrow(_to_the_smallest, "a long, b long, m int, s int").filter(F.least("m", "s") >= least * F.greatest("m", "s") - 1e-9).select("a", "b").distinct()
    prints = lambda c, o: members.select(F.col("node").alias(c), *(F.col(p).alias(f"{o}{p}") for p in parts))
    far = sum((F.bit_count(F.col(f"x{p}").bitwiseXOR(F.col(f"y{p}"))) for p in parts), F.lit(0))
    stars = stars.join(prints("a", "x"), "a").join(prints("b", "y"), "b").filter(far <= int(NEAR * 32 * segments)).select("a", "b")
    links = verified(stars, "star")
    if exact:
        first = members.select("node", "size", "parts", "alone", F.posexplode("first").alias("at", "shingle"))
        first = store.materialize(first.select("node", "shingle", "size", "parts", (F.col("alone") + F.col("at") + 1).alias("place")), "prefix-shingles")
        for turn in range(ROUNDS + 1):
            now = store.materialize(grouped(members.select("node"), links), "node-groups")
            again = store.materialize(first.join(now, "node"), "regrouped")
            spread = again.groupBy("shingle", "group").agg(F.lit(1).alias("one")).groupBy("shingle").agg(F.count(F.lit(1)).alias("groups"))
            last = turn == ROUNDS or turn and (new.limit(SLACK_LEAST + 1).count() <= SLACK_LEAST or spread.filter(F.col("groups") > HEAVY).isEmpty())
            new = verified(_crossing(again, least) if last else _pivoted(again, least, turn), "cross" if last else "pivot")
            links = links.unionByName(new)
            store.discard(now, again)
            if last:
                break
        store.discard(first)

    final = store.materialize(grouped(sets, links).select("set_key", "id", "group"), "groups")
    store.discard(members, candidates)
    least_of = final.groupBy("group").agg(F.min(F.struct("id", "set_key")).alias("low")).select(F.col("group").alias("of"), F.col("low.id").alias("component_id"), F.col("low.set_key").alias("kept_key"))
    named = final.join(least_of, F.col("group") == F.col("of")).select(F.col("set_key").alias("_key"), "component_id", "kept_key")
    return marked.join(named, F.col("set_key") == F.col("_key")).select("doc_id", "set_key", "component_id", "kept_key")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The documents, one of each component: the smallest doc_id, and where it has several texts one of the text that links.

    A row stays away only if its shingle set is linked to that of a row that stays. Of rows with one doc_id and equal shingle
    sets the smallest text stays; of entirely equal ones any. Rows without an identifier must be left out.
    """
    found = near_copies(docs, doc_id, text, **options)
    found = store.materialize(found.select(F.col("doc_id").alias("_doc"), F.col("set_key").alias("_set"), ((F.col("doc_id") == F.col("component_id")) & (F.col("set_key") == F.col("kept_key"))).alias("_kept")), "decided")
    several = store.materialize(found.groupBy("_doc").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_doc"), "several")
    kept = found.filter("_kept").select("_doc", "_set")
    # a text is shuffled only where its number has several or may have none that stays
    bitmap = store.key_bitmap(found.filter("NOT _kept").select("_doc").unionByName(several))
    looked_up = store.by_bitmap(docs, doc_id, bitmap)
    out = store.by_bitmap(docs.filter(F.col(doc_id).isNotNull()), doc_id, bitmap, among=False)
    out = out.unionByName(looked_up.join(kept.join(several, "_doc", "left_anti"), looked_up[doc_id] == F.col("_doc"), "left_semi"))
    if several.isEmpty():
        return out
    names, shingle, key = docs.columns, int(options.get("shingle", 5)), store.free_name(docs, "set_key")

    @store.trimmed
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s, _ in _sets(batch.column(names.index(text)), shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=[*names, key])

    rows = looked_up.join(several, looked_up[doc_id] == F.col("_doc"), "left_semi").mapInArrow(keyed, T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())]))
    rows = store.materialize(rows.join(kept.distinct(), (F.col(doc_id) == F.col("_doc")) & (F.col(key) == F.col("_set")), "left_semi"), "several-kept")
    least_text = rows.groupBy(F.col(doc_id).alias("_doc"), F.col(key).alias("_set")).agg(F.min(text).alias("_text"))
    same = (F.col(doc_id) == F.col("_doc")) & (F.col(key) == F.col("_set")) & F.col(text).eqNullSafe(F.col("_text"))
    chosen = rows.join(least_text, same, "left_semi").dropDuplicates([doc_id, key])
    return out.unionByName(chosen.select(*names))
