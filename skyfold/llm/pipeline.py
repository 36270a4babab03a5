"""A training-corpus pipeline over `documents`: toxicity, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Rows without a doc_id take part in all
stages but the comparison of documents, which keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm import near_copies, packing, store, substring_dedup, toxicity
from skyfold.llm.tokenizer_files import BYTE_BPE

#: The packing stage and the near-duplicate stage have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, does not reject."""
    store.bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    added = tuple(store.free_name(docs, n) for n in ("score", "predicted", "matched_clauses"))
    return toxicity.score(docs, model, added=added).filter(F.col(added[1]) == 0).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by a similarity of 0.8 or more on five-word shingles one document, that with the smallest doc_id.

    SimHash segments find the candidates, an exact prefix search those that they miss, and the whole shingle sets decide.
    """
    kept = near_copies.keep_one(docs.filter("doc_id IS NOT NULL")).select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word windows that start earlier in the corpus; n_chars follows where a text changed."""
    added = tuple(store.free_name(docs, n) for n in substring_dedup.ADDED)
    found = substring_dedup.remove_repeats(docs, window=20, added=added)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col(added[1]) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, in sequences of at most 2048; with a smaller cache, as the executors hold earlier stages' heap."""
    return packing.pack_documents(docs, BYTE_BPE, capacity=2048, end_id=0, cache=150_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", keep_one_of_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; each stage's result is stored in the shared folder and read again."""
    store.bound_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
