"""Registered queries of the training-data operators: thin readers of one table, one operator, its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm import bpe, conversation_trie, flac, html_extract, packing, periodic_runs, quality, sharding, simhash, store, substring_dedup, topk, toxicity, warc
from skyfold.llm import pipeline as corpus
from skyfold.llm.tokenizer_files import BYTE_BPE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    store.bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, window=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=8)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, seed=42, most=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = store.materialize(flac.encode_column(_table(spark, sf_dir, "documents"), "doc_id", "text"), "media", parquet_compression_codec_zstd_level="9", parquet_page_size=str(8 << 20))
    return flac.describe_column(flac.pcm_column(media, "doc_id"), "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), BYTE_BPE, capacity=2048, end_id=0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(warc.write_bundles(_table(spark, sf_dir, "pages"), least_bytes=0))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"), conversation_trie.rebuilt)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.describe_runs(_table(spark, sf_dir, "documents"), change=periodic_runs.imposed)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


QUERIES = {
    q.__name__: q
    for q in (op1_substring_dedup, op2_bpe, op3_sharding, op4_simhash, op5_html_extraction, op6_flac, op7_toxicity, op8_packing, op9_warc, op10_topk, op11_conversation_trie, op12_quality, op13_periodic_runs, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH listed AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM listed
        ), windows AS (
            SELECT doc_id, pos, list_slice(w, pos + 1, pos + 20) AS seq FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS pos FROM listed WHERE len(w) >= 20)
        ), later AS (
            SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1
        ), marked AS (
            SELECT words.doc_id, words.pos, word,
                   max(later.pos) OVER (PARTITION BY words.doc_id ORDER BY words.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
            FROM words LEFT JOIN later ON words.doc_id = later.doc_id AND words.pos = later.pos
        ), summed AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id
        )
        SELECT documents.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN summed USING (doc_id)
    """,
    "op3_sharding": """
        WITH bits AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
        ), sized AS (
            SELECT doc_id, md5(coalesce(text, '')) AS digest, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents
        ), summed AS (
            SELECT doc_id, digest, size, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS text_crc32
            FROM sized, bits
        ), placed AS (
            SELECT *, coalesce(sum(size) OVER (ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM summed
        ), cut AS (
            SELECT *, least(7, (2 * before + size) * 8 // (2 * total))::INTEGER AS shard FROM placed
        )
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
               (row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
        FROM cut
    """,
    "op9_warc": """
        WITH named AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
        ), last AS (
            SELECT *, max(page_id) OVER (PARTITION BY hex) AS kept FROM named
        )
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> ((3 - i % 4) * 5)::BIGINT) & 31)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN kept <> page_id THEN kept END AS refers_to
        FROM last
    """,
    "op10_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM (SELECT vec_id, min(v) AS v FROM whole WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN whole c ON c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_conversation_trie": """
        WITH bits AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
        ), said AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), counted AS (
            SELECT conv_id, count(*) AS n FROM said GROUP BY conv_id
        ), convs AS (
            SELECT conv_id, n, conv_id - conv_id % 5 AS donor, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT % 9 AS h
            FROM counted, bits
        ), turns AS (
            SELECT c.conv_id, pos + 1 AS depth, role, text FROM convs c JOIN said ON said.conv_id = c.donor AND pos < h
            UNION ALL
            SELECT c.conv_id, least(c.h, coalesce(d.n, 0)) + pos - c.h + 1, role, text
            FROM convs c JOIN said ON said.conv_id = c.conv_id AND pos >= c.h LEFT JOIN convs d ON d.conv_id = c.donor
        ), paths AS (
            SELECT conv_id, depth, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, octet_length(encode(text)) AS bytes FROM turns
            UNION ALL
            SELECT conv_id, 0, '', 0 FROM convs
        ), nodes AS (
            SELECT path, depth, CASE WHEN depth > 0 THEN left(path, 128 * (depth - 1)) END AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '') AS ends
            FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS length FROM paths) GROUP BY path, depth
        ), children AS (
            SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
        ), under AS (
            SELECT left(path, 128 * k) AS path, count(*) FILTER (n IS NULL) AS leaves, sum((n_convs - 1) * bytes) AS saved
            FROM (SELECT nodes.*, children.n, unnest(range(depth + 1)) AS k FROM nodes LEFT JOIN children ON children.up = nodes.path) GROUP BY 1
        )
        SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0)::BIGINT AS n_children,
               leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(nodes.ends) AS ends_sha256
        FROM nodes JOIN under USING (path) LEFT JOIN children ON children.up = nodes.path LEFT JOIN nodes parent ON parent.path = nodes.up
    """,
}
