"""Exact top-k by inner product over a pivot-distance index.

Inner products become distances by one more dimension: with M the largest norm, (x, sqrt(M^2 - |x|^2)) and (q, 0) lie at
sqrt(|q|^2 + M^2 - 2 q.x). Every vector is keyed by its nearest pivot and its distance to it; a pivot's vectors, sorted by that
distance, are cut into annuli, and an annulus is one row of the index (its least and greatest distance and a bounded block of
vectors; a cell that holds a third of all vectors is merely many annuli).

A query starts in the annulus of its home cell that lies nearest its own distance, which gives a first k-th score. From there
the search expands in rounds: annuli are sorted by their distance from the query, a round opens the nearest ones that are still
closed (FIRST_ROUND of them, then GROWTH times as many each round), and the k-th score it gives tightens the bound of the next.
An annulus is opened only if the triangle inequality lets it hold a better score, that is if the query's distance to the pivot
is within the k-th distance of the annulus; a query stops when no such annulus is left, the search when no query has one.
Queries travel in blocks of one home cell, so a round's work list has a row for each block of queries and annulus that some
query of the block must open. Scores are exact: integers, computed in float64 where that is exact and in 64-bit integers
beyond (a product that outgrows those wraps around); the bounds carry a margin for rounding.

Pivots are a bounded sample (the `pivots` smallest hashes of distinct identifiers). Edge cases: vectors that are null, hold
null, NaN or infinite components or have a null identifier take no part; vectors of other lengths are compared over zero-filled components; fewer than k
candidates give fewer rows; equal scores go by smaller identifier; repeated identifiers are all candidates and, if divisible,
asked once, with the least of their vectors; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm import store

#: Pivots, vectors of an annulus and queries of a block.
PIVOTS, ANNULUS, QUERY_BLOCK = 64, 1024, 256
#: Annuli of a part of the ring table.
RING_PART = 4096
#: Annuli that a query block opens in the first round, and how many times as many in each later one.
FIRST_ROUND, GROWTH = 4, 4


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    sizes = np.diff(offsets)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)] = flat
    return out


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return queries @ vectors.T


def _best(scores: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the k best (query, vector) places of a block; a query's own rows are left out."""
    own = ids[None, :] == query_ids[:, None]
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores, own), axis=1)[:, : k + 1]
    rows = np.repeat(np.arange(len(scores)), order.shape[1])
    columns = order.ravel()
    keep = ~own[rows, columns]
    rows, columns = rows[keep], columns[keep]
    first = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1]) if len(rows) else np.zeros(0, int)
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[place < k], columns[place < k], scores[rows[place < k], columns[place < k]]


def _distances(vectors: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances between lifted vectors and lifted pivots."""
    a, b = vectors.astype(np.float64), pivots.astype(np.float64)
    squares = (a * a).sum(1)[:, None] + (lift * lift)[:, None] + ((b * b).sum(1) + pivot_lift * pivot_lift)[None, :]
    return np.sqrt(np.maximum(0, squares - 2 * (a @ b.T + lift[:, None] * pivot_lift[None, :])))


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 x) of every component of the vectors that take part."""
    whole = F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(whole & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("vec_id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """For every row whose identifier is divisible by `every`: query_id, rank, vec_id and score of the k best other rows."""
    whole = store.materialize(quantized(vectors, vec_id, embedding), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    width, largest = whole.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    chosen = [r["v"] for r in whole.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()]
    centres = np.zeros((max(1, len(chosen)), width), np.int64)
    for i, v in enumerate(chosen):
        centres[i, : len(v)] = v
    lift_of = lambda x: np.sqrt(np.maximum(0, largest - (x.astype(np.float64) ** 2).sum(1)))
    centre_lift = lift_of(centres)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            d = _distances(x, lift_of(x), centres, centre_lift)
            near = d.argmin(1)
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "v", "pivot", "distance"])

    keyed = whole.mapInArrow(key, "vec_id long, v array<long>, pivot int, distance double")
    # sorted by pivot and distance over all partitions, so that annuli are consecutive rows and a large cell is many tasks' work
    ordered = keyed.repartitionByRange(store.shuffle_partitions(whole.sparkSession), "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            cuts = np.flatnonzero(np.diff(pivot, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(pivot)], strict=True):
                for s in range(a, b, ANNULUS):
                    part = batch.slice(s, min(ANNULUS, b - s))
                    ids = part.column("vec_id").to_numpy()
                    d = part.column("distance").to_numpy()
                    x = _matrix(part.column("v"), width)
                    yield pa.record_batch({"pivot": pa.array([pivot[a]], pa.int32()), "low": [d[0]], "high": [d[-1]], "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "block": pa.array([x.astype(narrow).tobytes()], pa.binary())})

    # no component is larger than its vector's norm, so that the blocks take no more bytes than they need
    narrow = next((t for t in (np.int16, np.int32) if largest < float(np.iinfo(t).max) ** 2), np.int64)
    index = ordered.mapInArrow(annuli, "pivot int, low double, high double, n long, ids binary, block binary").withColumn("annulus", F.monotonically_increasing_id())
    index = store.materialize(index, "annuli")
    rings = index.select("annulus", "pivot", "low", "high", "n")

    asked = keyed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "pivot", "distance")).alias("least")).select("vec_id", "least.*")
    # queries of one cell are dealt to salts, so that a cell with many is many tasks' work
    salts = asked.count() // (QUERY_BLOCK * 256) + 1
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts))
    place = F.row_number().over(Window.partitionBy("pivot", salt).orderBy("distance", "vec_id"))
    asked = asked.withColumn("part", F.concat_ws("-", salt, F.floor((place - 1) / QUERY_BLOCK).cast("long")))
    blocks = asked.groupBy("pivot", "part").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("queries"), F.min("distance").alias("d_low"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pivot, low, queries in zip(batch.column("pivot").to_pylist(), batch.column("d_low").to_pylist(), batch.column("queries"), strict=True):
                ids, q = queries.values.field("vec_id").to_numpy(), _matrix(queries.values.field("v"), width)
                yield pa.record_batch([pa.array([pivot], pa.int32()), pa.array([low]), pa.array([ids.tobytes()], pa.binary()), pa.array([q.astype(narrow).tobytes()], pa.binary())], names=["pivot", "d_low", "q_ids", "q"])

    blocks = blocks.select("pivot", "d_low", "queries").mapInArrow(packed, "pivot int, d_low double, q_ids binary, q binary")
    blocks = store.materialize(blocks.withColumn("block_id", F.monotonically_increasing_id()), "queries")

    def unpack(row_ids: pa.Scalar, row_block: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(row_ids.as_buffer(), np.int64)
        return ids, np.frombuffer(row_block.as_buffer(), narrow).reshape(len(ids), width).astype(np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """k best of each query block in an annulus; `floor` (the k-th scores so far) leaves out what cannot count."""
        for batch in batches:
            floors = batch.column("floor") if "floor" in batch.schema.names else [None] * len(batch)
            for b, names, queries, ids, block, floor in zip(batch.column("block_id").to_pylist(), *(batch.column(c) for c in ("q_ids", "q", "ids", "block")), floors, strict=True):
                q_ids, q = unpack(names, queries)
                ids, x = unpack(ids, block)
                rows, columns, scores = _best(_scores(q, x), ids, q_ids, k)
                if floor is not None:
                    keep = scores >= np.array(floor.as_py(), np.int64)[rows]
                    rows, columns, scores = rows[keep], columns[keep], scores[keep]
                yield pa.record_batch([pa.array(np.full(len(rows), b)), pa.array(rows.astype(np.int32)), pa.array(q_ids[rows]), pa.array(ids[columns]), pa.array(scores)], names=["block_id", "row", "query_id", "vec_id", "score"])

    found_schema = "block_id long, row int, query_id long, vec_id long, score long"
    # first the annulus of the home cell that holds the queries' own distance: the last one that begins at or before it
    events = rings.select("pivot", F.col("low").alias("at"), F.lit(0).alias("late"), "annulus", F.lit(None).cast("long").alias("block_id")).unionByName(
        blocks.select("pivot", F.col("d_low").alias("at"), F.lit(1).alias("late"), F.lit(None).cast("long").alias("annulus"), "block_id")
    )
    so_far = Window.partitionBy("pivot").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    nearest = events.withColumn("annulus", F.last("annulus", True).over(so_far)).filter(F.col("block_id").isNotNull() & F.col("annulus").isNotNull()).select("block_id", "annulus")
    nearest = store.materialize(nearest, "nearest")

    def searched(work: DataFrame) -> DataFrame:
        pairs = work.join(blocks.select("block_id", "q_ids", "q"), "block_id").join(index.select("annulus", "ids", "block"), "annulus")
        return pairs.drop("annulus").mapInArrow(search, found_schema)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = store.materialize(searched(nearest).withColumn("rank", rank).filter(F.col("rank") <= k), "best-0")
    opened = nearest.groupBy("block_id").agg(F.collect_list("annulus").alias("seen"))
    # each query block reads the ring table (one row an annulus) by parts
    parts = rings.count() // RING_PART + 1
    part = F.pmod(F.xxhash64("annulus"), F.lit(parts)).cast("int")
    ring_parts = store.materialize(rings.groupBy(part.alias("ring_part")).agg(F.collect_list(F.struct("annulus", "pivot", "low", "high")).alias("rings")), "rings")
    step, turn = FIRST_ROUND, 0
    while True:
        kth = best.groupBy("block_id", "row").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
        kth = kth.groupBy("block_id").agg(F.collect_list(F.struct("row", "kth")).alias("kths"))

        def open_rings(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            """The `step` nearest closed annuli of each block that the bound leaves open."""
            for batch in batches:
                for b, names, queries, kths, seen, ring in zip(batch.column("block_id").to_pylist(), batch.column("q_ids"), batch.column("q"), batch.column("kths").to_pylist(), batch.column("seen").to_pylist(), batch.column("rings"), strict=True):
                    q_ids, q = unpack(names, queries)
                    floor = np.full(len(q_ids), np.iinfo(np.int64).min)
                    for r in kths or []:
                        if r["kth"] is not None:
                            floor[r["row"]] = r["kth"]
                    d = _distances(q, np.zeros(len(q)), centres, centre_lift)
                    known = floor > np.iinfo(np.int64).min
                    reach = np.where(known, np.sqrt(np.maximum(0, (q.astype(np.float64) ** 2).sum(1) + largest - 2 * np.where(known, floor, 0))), np.inf)
                    pivot, low, high, annulus = (ring.values.field(n).to_numpy() for n in ("pivot", "low", "high", "annulus"))
                    own = d[:, pivot]
                    gap = np.maximum(0, np.maximum(low[None, :] - own, own - high[None, :]))
                    slack = 1e-6 * (1 + own + high[None, :])
                    left = np.flatnonzero((gap <= reach[:, None] + slack).any(0) & ~np.isin(annulus, seen or []))
                    near = gap[:, left].min(0) if len(left) else np.zeros(0)
                    left = left[np.argsort(near, kind="stable")[:step]]
                    yield pa.record_batch([pa.array(np.full(len(left), b)), pa.array(annulus[left]), pa.array(gap[:, left].min(0) if len(left) else np.zeros(0)), pa.array([floor] * len(left), pa.list_(pa.int64()))], names=["block_id", "annulus", "gap", "floor"])

        state = blocks.select("block_id", "q_ids", "q").join(kth, "block_id", "left").join(opened, "block_id", "left")
        state = state.withColumn("ring_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        work = state.join(ring_parts, "ring_part").select("block_id", "q_ids", "q", "kths", "seen", "rings").mapInArrow(open_rings, "block_id long, annulus long, gap double, floor array<long>")
        work = work.withColumn("place", F.row_number().over(Window.partitionBy("block_id").orderBy("gap", "annulus"))).filter(F.col("place") <= step)
        work = store.materialize(work.select("block_id", "annulus", "floor"), f"work-{turn}")
        turn, step = turn + 1, step * GROWTH
        if not work.limit(1).count():
            break
        found = best.select("block_id", "row", "query_id", "vec_id", "score").unionByName(searched(work))
        best = store.materialize(found.withColumn("rank", rank).filter(F.col("rank") <= k), f"best-{turn}")
        opened = store.materialize(opened.select("block_id", F.explode("seen").alias("annulus")).unionByName(work.select("block_id", "annulus")).groupBy("block_id").agg(F.collect_list("annulus").alias("seen")), f"seen-{turn}")
    return best.select("query_id", "rank", "vec_id", "score")
