"""Contiguous shards of equal bytes by global prefix sums.

Rows are range-partitioned and sorted by their text's MD5 and document number, so equal texts follow each other and only a cut
can part them; each partition's byte and row totals (one row a partition) are summed up in order, and a row's place in the
whole is its partition's offset plus its running sum inside. Cuts lie at equal targets, so a shard's bytes differ from the
others' by about one document. Only numbers and digests move; texts stay where they are.

Edge cases: a null text has one byte and goes with empty ones; repeated rows follow each other; a text of a third of all bytes
is one row of one shard; copies of one text that outgrow a shard go on in the next; columns of any other name are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm import store


def assign_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard) and grown_shard (null)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.md5(F.encode(body, "UTF-8")).alias("_text"))
    order = ["_text", "doc_id"]
    # stored, as a range partitioning is sampled anew each time it is computed
    placed = store.materialize(
        sized.repartitionByRange(store.shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}),
        "sized",
    )
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    totals = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_total"),
    )
    inside = F.sum("size").over(Window.partitionBy("_part").orderBy("_row")) - F.col("size")
    middle = 2 * (F.col("_bytes_before") + F.col("_inside")) + F.col("size")
    numbered = (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(totals), "_part")
        .select("doc_id", "size", "text_crc32", F.expr("_rows_before + _row").alias("_index"), F.least(F.lit(shards - 1), F.call_function("div", middle * shards, 2 * F.col("_total"))).cast("int").alias("shard"))
    )
    numbered = store.materialize(numbered, "shards")
    first = numbered.groupBy("shard").agg(F.min("_index").alias("_first"))  # one row a shard
    return numbered.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_index") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
