"""The corpus pipeline and the registered queries on small tables against brute force and DuckDB."""

from __future__ import annotations

import os
import random
import zlib

import duckdb
import pytest

import corpus_pipeline
from skyfold.llm import queries, warc

DATA = "/root/testdata/sf0.001"


def words_of(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["ka", "lo", "mi", "ten", "so", "ru", "an"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def tables(tmp_path, spark, seed: int = 3):
    rng = random.Random(seed)
    passage = " ".join(words_of(rng, 40))
    docs, labels = [], []
    for i in range(240):
        body = words_of(rng, rng.randint(30, 200))
        if i % 8 == 0:
            body[10:10] = passage.split()
        if i % 6 == 0:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), "vile")
        docs.append((i, " ".join(body), "en", "s", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(300 + k, docs[k][1], None, "copy", None) for k in (1, 1, 2)]
    docs += [(400, docs[3][1] + " kalo", "en", "near", 2), (401, None, None, None, None), (402, "", "en", "s", 0), (None, "kalo tenmi", "en", "s", 3), (403, "x " * 9000, "en", "s", 4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs, labels


def shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def test_every_stage_does_its_work(spark, tmp_path):
    docs, _ = tables(tmp_path, spark)
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash near-dedup", "substring dedup", "best-fit packing"]

    clean = stages["toxicity"](spark, rows, str(tmp_path))
    assert clean.columns == rows.columns
    kept = sorted((tuple(r) for r in clean.collect()), key=str)
    assert kept == sorted((d for d in docs if "vile" not in (d[1] or "")), key=str)

    single = stages["simhash near-dedup"](spark, clean, str(tmp_path))
    sets = {d[0]: shingles(d[1]) for d in kept if d[0] is not None}
    groups = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):  # five words, 0.8
                low, high = sorted((groups[a], groups[b]))
                groups = {i: low if g == high else g for i, g in groups.items()}
    expected = {i for i, g in groups.items() if i == g}
    got = [tuple(r) for r in single.collect()]
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(expected) and sum(r[0] is None for r in got) == 1
    assert expected < set(sets) and 400 not in expected  # the copy with one added word goes

    cut = stages["substring dedup"](spark, single, str(tmp_path))
    seen: set = set()
    for doc_id, text, _, _, n in sorted((tuple(r) for r in cut.collect()), key=lambda r: (r[0] is None, r[0])):
        before = next(r for r in got if r[0] == doc_id)
        words = (before[1] or "").split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        expected_text = " ".join(w for w, g in zip(words, gone) if not g) if any(gone) else before[1]
        assert text == expected_text and n == (len(expected_text) if any(gone) else before[4])

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in got}
    fill: dict[int, int] = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= sum(fill.values()) / 2048 + 2


def test_repeated_rows_of_one_number_leave_one(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 1)] * 3 + [(2, "e f g h", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()) == [1, 2]


def test_pipeline_takes_columns_named_like_those_it_adds(spark, tmp_path):
    body = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, body, "a", 7, "s"), (2, "x " + body, "b", 8, "t")], "doc_id long, text string, kept_sha256 string, n_removed int, spans string")
    got = dict(corpus_pipeline.STAGES)["substring dedup"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, body, "a", 7, "s"), (2, "x", "b", 8, "t")]


@pytest.mark.parametrize("name", ["op9_warc", "op10_topk"])
def test_null_identifiers_follow_the_oracle(spark, tmp_path, name):
    pages = [(1, "u", "same"), (None, "u", "same"), (None, "u", "same"), (None, None, "alone"), (2, "u", None), (3, "u", "")]
    vectors = [(k, [float(k % 7), 1.0]) for k in range(120)] + [(None, [9.0, 9.0]), (None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(cursor.fetchall(), key=str)


def test_nameless_pages_keep_their_payload(spark):
    pages = spark.createDataFrame([(None, "u", "alone")] * 2, "page_id long, url string, html string")
    found = set()
    for b in warc.write_bundles(pages).collect():
        for e in b["index"]:
            fields, block = warc.read_record(warc.read_frame(bytes(b["archive"]), warc.seek_table(bytes(b["archive"])), e["frame"]), e["offset"])
            assert block.endswith(b"\r\n\r\nalone") and warc.page_of(fields["WARC-Record-ID"]) is None
            found.add(fields["WARC-Record-ID"])
    assert len(found) == 2


def test_pipeline_takes_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(cursor.fetchall(), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_cover_their_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in ("op2_bpe", "op3_sharding", "op4_simhash", "op6_flac", "op7_toxicity"):
        assert queries.QUERIES[name](spark, DATA).select("doc_id").distinct().count() == docs, name
    assert queries.QUERIES["op5_html_extraction"](spark, DATA).count() == spark.read.parquet(f"{DATA}/pages.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/../sf0.1/labels.parquet").collect()}
    rows = queries.op7_toxicity(spark, f"{DATA}/../sf0.1").filter("held_out").collect()
    pairs = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in labels]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.98
    assert sum(b for a, b in pairs if a) >= 0.93 * sum(a for a, _ in pairs)  # recall
    assert sum(b for a, b in pairs if not a) <= 0.01 * sum(not a for a, _ in pairs)  # false alarms
    scored = sorted((r["score"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels)
    ranks: dict[float, list[int]] = {}
    for k, (value, _) in enumerate(scored, 1):
        ranks.setdefault(value, []).append(k)
    toxic = sum(y for _, y in scored)
    area = (sum(sum(ranks[v]) / len(ranks[v]) for v, y in scored if y) - toxic * (toxic + 1) / 2) / (toxic * (len(scored) - toxic))
    assert area >= 0.96
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
