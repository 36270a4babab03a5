"""Prefix trie of conversations by count-min screening of prefix digests.

A turn becomes a digest of role and text, so that texts never shuffle. The digest of a conversation's first d turns is the
exclusive or of 128-bit hashes of (d, turn), a running aggregate that can be cut anywhere. A count-min sketch of all prefix
digests, of bounded size, is broadcast: an estimate of one proves that a single conversation has the prefix, and all longer ones
of it, so the rest of its path is a tail of nodes of its own and is written where it stands. Only prefixes that may be shared are
grouped, exactly; a group whose members differ in their previous prefix or their length is an error, which by induction leaves
equality of every turn's 128 bits.

A node belongs to its smallest member, its owner. A conversation owns the nodes from some depth to its end, and hangs there on
a node of a smaller owner. So a subtree is a stretch of the owner's own nodes together with everything that hangs on it:
every conversation adds the totals of its own nodes to the deepest node that it shares with each owner on its path (fewer
rows than it has turns), and sums from below along each owner's nodes give the subtrees, without walking the tree.

Hot groups: turns are numbered by a sort over ranges of (conversation, turn) with offsets for the conversations that a range
cuts; running sums go by chunks of `CHUNK` turns with the chunks' totals added; owners come back to members by a join that is
salted by the sketch's estimate; members that end at one node are sorted over ranges, joined to strings of `ENDS` numbers there,
and only these strings are hashed one after the other, as the digest of a list asks.

Edge cases: rows without a conv_id take no part; null role or text is empty; null turns come first, equal turns are ordered by
role and by the SHA-256 of the text, and repeated rows are turns each; conversations that are left without turns are
members of the root alone; an empty table gives no nodes; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm import store, words

#: Turns of a conversation whose running values are computed by one task.
CHUNK = 4096
#: Members of a node that one salt of the owners' join takes.
SALT_ROWS = 512
#: Numbers in one string of the members that end at a node.
ENDS = 4096
#: Rows of the sketch, the most counters of a row (4 bytes each), and counters in a block that tasks send.
SKETCH_ROWS, SKETCH_MOST, BLOCK = 3, 1 << 22, 1 << 12

NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, pos from 0, key, bytes), stored, and conversations as (conv_id, n)."""
    spark = conversations.sparkSession
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), by.alias("role"), F.sha2(said, 256).alias("digest"), F.octet_length(said).cast("long").alias("bytes"))
    # equal rows are interchangeable, so chance may part them
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    rows = rows.repartitionByRange(store.shuffle_partitions(spark), *order, F.rand(3)).sortWithinPartitions(*order)
    rows = rows.select("conv_id", F.unhex(F.sha2(F.concat(F.sha2("role", 256), "digest"), 256)).alias("key"), "bytes")

    @store.trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            fresh = np.ones(len(ids), bool)
            fresh[1:] = ids[1:] != ids[:-1]
            starts = np.flatnonzero(fresh)
            place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if ids[0] == last:
                place[: starts[1] if len(starts) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(len(ids), part, np.int32))], names=["conv_id", "key", "bytes", "place", "part"])

    rows = store.materialize(rows.mapInArrow(count, "conv_id long, key binary, bytes long, place long, part int"), "turns")
    counts = store.materialize(rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")), "turn-counts")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a range has one conversation at most that began in an earlier one: no more rows than partitions
    cut = counts.withColumn("before", before).filter("before > 0").select("conv_id", "part", "before")
    rows = rows.join(F.broadcast(cut), ["conv_id", "part"], "left")
    return rows.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "bytes"), counts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def whole(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: (conv_id, depth from 1, key, bytes) and (conv_id, length)."""
    return turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "bytes"), convs.select("conv_id", F.col("n").alias("length"))


def rebuilt(turns: DataFrame, convs: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversation c begins with the first h turns of c - c % every and goes on with its own after its first h, h = crc32(c) % most."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = convs.select("conv_id", "n", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("donor"))
    lengths = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("given"))
    convs = convs.join(lengths, "donor", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    convs = store.materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "rebuilt")
    heads = turns.filter((F.col("pos") < most - 1) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("donor"), "pos", "key", "bytes")
    given = convs.filter("taken > 0").select("conv_id", "donor", "h").join(heads, "donor").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "bytes")
    shifts = convs.filter("n > h").select("conv_id", (F.col("taken") - F.col("h")).alias("shift"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))).alias("slot"))
    own = turns.filter(F.col("pos") >= head).withColumn("slot", F.floor(F.col("pos") / CHUNK)).join(shifts, ["conv_id", "slot"])
    return given.unionByName(own.select("conv_id", (F.col("pos") + F.col("shift") + 1).alias("depth"), "key", "bytes")), convs.select("conv_id", "length")


def _running(rows: DataFrame, key: str, at: str, fold: Callable[[str], Column], join: Callable[[Column, Column], Column], names: list[str], backwards: bool = False) -> DataFrame:
    """Replaces the named columns by their running fold along `at` within `key`, chunk by chunk."""
    rows = rows.withColumn("chunk", F.floor(F.col(at) / CHUNK))
    way = (lambda c: F.col(c).desc()) if backwards else F.col
    inner = Window.partitionBy(key, "chunk").orderBy(way(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(way("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "chunk").agg(*(fold(n).alias(f"of_{n}") for n in names))
    totals = totals.withColumns({f"of_{n}": fold(f"of_{n}").over(before) for n in names}).filter(f"of_{names[0]} IS NOT NULL")
    rows = rows.withColumns({n: fold(n).over(inner) for n in names}).join(totals, [key, "chunk"], "left")
    return rows.withColumns({n: F.when(F.col(f"of_{n}").isNull(), F.col(n)).otherwise(join(F.col(n), F.col(f"of_{n}"))) for n in names}).drop("chunk", *(f"of_{n}" for n in names))


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns with their prefix digest (a, b) and the previous one (pa, pb), and the conversation's length."""
    own = turns.withColumns({"g": F.xxhash64(F.lit(1), "key", "depth"), "k": F.xxhash64(F.lit(2), "key", "depth")}).withColumns({"a": F.col("g"), "b": F.col("k")})
    rows = _running(own.drop("key"), "conv_id", "depth", F.bit_xor, lambda x, y: x.bitwiseXOR(y), ["a", "b"])
    slots = convs.filter("length > 0").select("conv_id", "length", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / CHUNK))).alias("slot"))
    rows = rows.withColumn("slot", F.floor(F.col("depth") / CHUNK)).join(slots, ["conv_id", "slot"])
    return rows.select("conv_id", "depth", "length", "bytes", "a", "b", F.col("a").bitwiseXOR(F.col("g")).alias("pa"), F.col("b").bitwiseXOR(F.col("k")).alias("pb"))


def _cells(digests: np.ndarray, row: int, width: int) -> np.ndarray:
    """Counters of the digests in one row of the sketch; width is a power of two."""
    return (words.mix(digests.view(np.uint64) ^ words.constants(SKETCH_ROWS, 71)[row]) & np.uint64(width - 1)).astype(np.int64)


def sketch(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """The count-min sketch of a column of digests, SKETCH_ROWS x width counters; tasks send blocks that they touched."""

    @store.trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SKETCH_ROWS, width), np.uint32)
        for batch in batches:
            for r in range(SKETCH_ROWS):
                np.add.at(table[r], _cells(batch.column(0).to_numpy(), r, width), 1)
        blocks = table.reshape(-1, min(BLOCK, width))
        for k in np.flatnonzero(blocks.any(axis=1)).tolist():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([blocks[k].tobytes()], pa.binary())], names=["block", "counts"])

    @store.trimmed
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(c.as_buffer(), np.uint32)
                if k == now:
                    total = total + counts
                else:
                    if now is not None:
                        yield pa.record_batch([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])
                    now, total = k, counts
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    sent = rows.select(column).mapInArrow(count, schema).repartition("block").sortWithinPartitions("block").mapInArrow(merge, schema)
    table = np.zeros((SKETCH_ROWS * width // min(BLOCK, width), min(BLOCK, width)), np.uint32)
    for r in sent.collect():  # at most SKETCH_ROWS * SKETCH_MOST counters
        table[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    return table.reshape(SKETCH_ROWS, width)


def _screened(rows: DataFrame, width: int) -> DataFrame:
    """The prefixes with the sketch's estimates of how many conversations have them (`est`) and the previous one (`before`)."""
    table = rows.sparkSession.sparkContext.broadcast(sketch(rows, "a", width))
    names = [*rows.columns, "est", "before"]

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            found = []
            for name in ("a", "pa"):
                digests = batch.column(name).to_numpy()
                found.append(np.min([counts[r][_cells(digests, r, width)] for r in range(SKETCH_ROWS)], axis=0).astype(np.int64))
            found[1][batch.column("depth").to_numpy() == 1] = 2  # the root
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _owned(rows: DataFrame) -> DataFrame:
    """Of prefixes that may be shared: the exact number of members `n` and the smallest, the owner."""
    shared = rows.filter("est > 1 AND before > 1")
    salts = F.floor(F.col("est") / SALT_ROWS)
    same = (F.min("depth") == F.max("depth")) & (F.min("pa") == F.max("pa")) & (F.min("pb") == F.max("pb"))
    nodes = shared.groupBy("a", "b").agg(F.when(same, F.count(F.lit(1))).otherwise(F.raise_error(F.lit("prefix digests collide"))).alias("n"), F.min("conv_id").alias("owner"), F.max("est").alias("est"))
    nodes = nodes.select("a", "b", "n", "owner", F.explode(F.sequence(F.lit(0), salts)).alias("salt"))
    salted = shared.withColumn("salt", F.pmod(F.xxhash64("conv_id"), salts + 1))
    found = salted.join(nodes, ["a", "b", "salt"]).select("conv_id", "depth", "length", "bytes", "n", "owner")
    border = rows.filter("est = 1 AND before > 1")  # the first node of a tail hangs on a shared one
    return found.unionByName(border.select("conv_id", "depth", "length", "bytes", F.lit(1).cast("long").alias("n"), F.col("conv_id").alias("owner")))


def _with_neighbours(owned: DataFrame, root: int) -> DataFrame:
    """Adds the owners of the previous and the next node and the next one's members; a chunk's neighbours are sent along."""
    here = F.floor(F.col("depth") / CHUNK)
    chunks = F.when(F.col("depth") % CHUNK == 0, F.array(here, here - 1)).when(F.col("depth") % CHUNK == CHUNK - 1, F.array(here, here + 1)).otherwise(F.array(here))
    along = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    rows = owned.withColumn("chunk", F.explode(chunks))
    rows = rows.withColumns({"d0": F.lag("depth").over(along), "o0": F.lag("owner").over(along), "d2": F.lead("depth").over(along), "o2": F.lead("owner").over(along), "n2": F.lead("n").over(along)}).filter(F.col("chunk") == here)
    follows = F.col("d2") == F.col("depth") + 1
    more = F.col("depth") < F.col("length")
    # where the neighbour is none of these rows, it stands in the conversation's own tail
    parent = F.when(F.col("depth") == 1, F.lit(root)).when(F.col("d0") == F.col("depth") - 1, F.col("o0")).otherwise(F.col("conv_id"))
    return rows.select(
        "conv_id", "depth", "length", "bytes", "n", "owner", parent.alias("parent"),
        F.when(more, F.when(follows, F.col("o2")).otherwise(F.col("conv_id"))).alias("next_owner"),
        F.when(more, F.when(follows, F.col("n2")).otherwise(F.lit(1))).alias("next_n"),
    )


def ends_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of rows (owner, depth, conv_id)."""
    schema = "owner long, depth long, first long, ids string"

    @store.trimmed
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))], pa.string())], names=["owner", "depth", "first", "ids"])

        for batch in batches:
            for owner, depth, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and (now != (owner, depth) or len(held) >= ENDS):
                    yield flush()
                    held = []
                now = (owner, depth)
                held.append(conv)
        if held:
            yield flush()

    @store.trimmed
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["owner", "depth", "ends_sha256"])

        for batch in batches:
            for owner, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("owner", "depth", "ids")), strict=True):
                if now == (owner, depth):
                    state.update(b",")
                else:
                    if now is not None:
                        yield flush()
                    now, state = (owner, depth), hashlib.sha256()
                state.update(ids.encode())
        if now is not None:
            yield flush()

    parts = store.shuffle_partitions(ends.sparkSession)
    sent = ends.repartitionByRange(parts, "owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(strings, schema)
    return sent.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(digest, "owner long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, width: int | None = None) -> DataFrame:
    """The nodes of turns (conv_id, depth, key, bytes) and conversations (conv_id, length); `width` overrides the sketch's counters a row."""
    spark = turns.sparkSession
    convs = store.materialize(convs, "trie-convs")
    n_all, root = convs.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    rows = store.materialize(_prefixes(turns, convs), "prefixes")
    if width is None:
        width = min(SKETCH_MOST, 1 << max(10, (2 * rows.count()).bit_length()))
    rows = store.materialize(_screened(rows, width), "screened")

    of, none = F.sha2(F.col("conv_id").cast("string"), 256), F.sha2(F.lit(""), 256)
    more = (F.col("depth") < F.col("length")).cast("long")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = rows.filter("before = 1").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), more.alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(more == 0, of).otherwise(none).alias("ends_sha256"))
    if n_all == 0:
        return tails
    owned = store.materialize(_with_neighbours(_owned(rows), root), "owned")

    hung = owned.filter("owner = conv_id AND parent != conv_id AND depth > 1").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    nodes = owned.filter("owner = conv_id").join(hung, ["conv_id", "depth"], "left").withColumn("hung", F.coalesce("hung", zero))
    # the leaf that ends the owner's own path, at the deepest node that others share or at the first that is its own
    leaf = F.when(F.col("n") == 1, F.col("parent") != F.col("conv_id")).otherwise(F.when(F.col("next_n").isNull(), F.col("hung") == 0).otherwise(F.col("next_n") == 1))
    # a conversation's only node on the root's owner's path has itself as parent by name
    leaf = F.when((F.col("n") == 1) & (F.col("depth") == 1), F.lit(True)).otherwise(leaf).cast("long")
    nodes = store.materialize(nodes.select("conv_id", "depth", "parent", "n", (F.col("hung") + more).alias("n_children"), leaf.alias("leaf"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"), F.lit(True).alias("shown")), "owned-nodes")

    totals = nodes.filter("leaf > 0 OR saved > 0").groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    passed = owned.filter("owner != conv_id AND (next_owner IS NULL OR next_owner != owner)").select("conv_id", "owner", "depth").join(totals, "conv_id")
    passed = passed.groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum("leaf").alias("passed_leaf"), F.sum("saved").alias("passed_saved"))
    shared = nodes.filter("n > 1").join(passed, ["conv_id", "depth"], "left")
    shared = shared.select("conv_id", "depth", "parent", "n", "n_children", (F.col("leaf") + F.coalesce("passed_leaf", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("passed_saved", zero)).alias("saved_tokens"))
    shared = _running(shared, "conv_id", "depth", F.sum, lambda x, y: x + y, ["n_leaves", "saved_tokens"], backwards=True)
    single = nodes.filter("n = 1").select("conv_id", "depth", "parent", "n", "n_children", one.alias("n_leaves"), zero.alias("saved_tokens"))

    top = nodes.agg(F.coalesce(F.sum((F.col("depth") == 1).cast("long")), zero).alias("n_children"), F.coalesce(F.sum("leaf"), zero).alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
    top = top.select(F.lit(root).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(n_all).cast("long").alias("n"), "n_children", F.greatest("n_leaves", one).alias("n_leaves"), "saved_tokens")

    ended = owned.filter("depth = length").select("owner", "depth", "conv_id").unionByName(convs.filter("length = 0").select(F.lit(root).cast("long").alias("owner"), zero.alias("depth"), "conv_id"))
    ended = ends_digests(ended).select(F.col("owner").alias("conv_id"), "depth", "ends_sha256")
    inner = shared.unionByName(single).unionByName(top).join(ended, ["conv_id", "depth"], "left")
    inner = inner.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    return inner.unionByName(tails)


def conversation_trie(conversations: DataFrame, build: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] = whole, width: int | None = None) -> DataFrame:
    """The trie's nodes: columns `NODES`; `build` may rebuild the conversations from numbered turns first."""
    return trie(*build(*numbered(conversations)), width).select(*NODES)
