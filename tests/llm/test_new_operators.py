"""Conversation trie, quality classifier and periodic runs against brute force, SQL and held-out labels."""

from __future__ import annotations

import hashlib
import math
import os
import random
import time
import zlib

import duckdb
import numpy as np
import pytest

from skyfold.llm import conversation_trie, html_extract, periodic_runs, quality
from skyfold.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn int, role string, text string, depth string, n string"


def trie_by_force(rows: list[tuple], rebuild: bool) -> list[tuple]:
    said: dict = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    said = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        built[c] = said.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members: dict = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        stack, leaves, saved = [p], 0, 0
        while stack:
            q = stack.pop()
            saved += (len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0
            leaves += q not in children
            stack += children.get(q, [])
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def turns(seed: int, n: int, most: int, texts: list) -> list[tuple]:
    rng = random.Random(seed)
    return [(c, t if rng.random() > 0.05 else None, rng.choice(["user", "bot", None]) if rng.random() < 0.2 else "user", rng.choice(texts), "x", None) for c in range(n) for t in range(rng.randint(0, most))]


@pytest.mark.parametrize(
    ("seed", "most", "texts", "rebuild", "chunk", "width"),
    [
        (1, 8, ["x", "y", None], True, 4096, None),
        (2, 14, ["x", "y"], True, 4096, 16),  # a sketch so small that nothing is proved alone
        (3, 30, ["x", "x", "x", "y"], True, 3, None),  # paths over many chunks
        (4, 30, [*"xxxxxxxy"], False, 4, 1024),
        (5, 12, ["x"], False, 3, None),  # one path that all share
    ],
)
def test_trie_is_that_of_brute_force(spark, monkeypatch, seed, most, texts, rebuild, chunk, width):
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    monkeypatch.setattr(conversation_trie, "SALT_ROWS", 8)
    rows = turns(seed, 50, most, texts)
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, TURNS), conversation_trie.rebuilt if rebuild else conversation_trie.whole, width)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == trie_by_force(rows, rebuild)


@pytest.mark.parametrize("rows", [[], [(5, 0, "user", "x", "", "")], [(7, 0, "a", "x", "", ""), (7, 0, "a", "x", "", ""), (None, 1, "a", "x", "", ""), (-3, None, None, None, "", ""), (2**40, 3, "a", "x " * 90_000, "", "")]])
def test_trie_of_few_rows_nulls_and_repeats(spark, rows):
    got = conversation_trie.conversation_trie(spark.createDataFrame(rows, TURNS), conversation_trie.rebuilt)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == trie_by_force(rows, True)


def test_turns_are_numbered_across_ranges(spark):
    """One conversation with nearly all rows is cut by the ranges of the sort."""
    rows = [(1, t, "user", f"t{t}", "", "") for t in range(4000)] + [(c, 0, "user", "x", "", "") for c in (0, 2)]
    found, convs = conversation_trie.numbered(spark.createDataFrame(rows, TURNS).repartition(8))
    assert sorted(r["pos"] for r in found.filter("conv_id = 1").collect()) == list(range(4000))
    assert {r["conv_id"]: r["n"] for r in convs.collect()} == {0: 1, 1: 4000, 2: 1}


def test_sketch_never_underestimates(spark):
    values = [random.Random(1).randrange(2**62) for _ in range(300)] * 2 + [5] * 70
    table = conversation_trie.sketch(spark.createDataFrame([(v,) for v in values], "a long").repartition(3), "a", 256)
    for v in set(values):
        own = min(int(table[r][conversation_trie._cells(np.array([v]), r, 256)[0]]) for r in range(len(table)))
        assert own >= values.count(v)
    assert table.sum(axis=1).tolist() == [len(values)] * len(table)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_trie_query_is_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    cursor = duck.execute(ORACLE_SQL["op11_conversation_trie"])
    columns = [c[0] for c in cursor.description]
    got = QUERIES["op11_conversation_trie"](spark, DATA).select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, cursor.fetchall()))


def runs_by_force(w: list) -> list[tuple[int, int, int]]:
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(24, 3 * q) and not any(all(w[s + k] == w[s + k + p] for k in range(size - p)) for p in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng: random.Random) -> list[int]:
    out: list[int] = []
    for _ in range(rng.randint(1, 6)):
        if rng.random() < 0.4:
            out += [rng.randrange(3) for _ in range(rng.randint(0, 30))]
        else:
            base = [rng.randrange(rng.choice([1, 2, 2, 50])) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 30, 31, 33, 64, 65]))]
            if rng.random() < 0.3:
                base = base + base[: len(base) // 2] + base[:3]
            out += (base * 9)[: int(len(base) * rng.choice([2.5, 2.9, 3, 3.2, 5]))]
    return out


def test_runs_are_those_of_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        w = random_words(rng)
        assert periodic_runs.find_runs(np.array(w, np.int64)) == runs_by_force(w), w


def described_by_force(doc_id: int | None, text: str | None) -> tuple:
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_force(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_runs_of_documents(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "é x " * 30, "a b " * 5000, "a " * 23, "a " * 24]
    texts += [rng.choice([" ", "\n", " \x0b"]).join(f"w{x}" for x in random_words(rng)) for _ in range(80)]
    texts += [" ".join(f"u{rng.randrange(400)}" for _ in range(rng.randint(1, 300))) for _ in range(150)]  # a tenth of them repeat a stretch
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(20, texts[20], None), (None, texts[21], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string").repartition(3)
    got = sorted(map(repr, map(tuple, periodic_runs.describe_runs(df, change=periodic_runs.imposed).collect())))
    assert got == sorted(repr(described_by_force(i, t)) for i, t, _ in rows)
    assert periodic_runs.describe_runs(df.limit(0)).count() == 0
    cut = {r["doc_id"]: r["text"] for r in periodic_runs.collapse_runs(df.filter("doc_id < 8")).collect()}
    assert cut == {0: None, 1: "", 2: " \t\n", 3: "one", 4: "é x", 5: "a b", 6: "a " * 23, 7: "a"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_runs_query_on_whole_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    assert set(got) == set(docs)
    short = [i for i, t in docs.items() if len(t or "") < 1500]
    assert len(short) > 200
    for i in short:
        assert got[i] == described_by_force(i, docs[i])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_quality_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r["quality"] is not None}
    rows = QUERIES["op12_quality"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, q, _ in held if q == 1], [s for s, q, _ in held if q == 0]
    assert len(bad) > 5
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) > 0.95 * len(good) * len(bad)
    assert sum(p == 1 for _, q, p in held if q == 1) > 0.97 * len(good)
    assert sum(p == 0 for _, q, p in held if q == 0) >= 0.8 * len(bad)
    assert abs(np.mean([s for s, *_ in held]) - np.mean([q for _, q, _ in held])) < 0.08  # calibrated


def test_quality_of_nulls_repeats_clashes_and_missing_labels(spark):
    rng = random.Random(4)
    text = lambda bad: " ".join(("#%" if bad else "") + rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(50)) + ("$$" if bad else "") for _ in range(60))
    rows = [(k, text(k % 2), 1.0, "x") for k in range(200)] + [(500, None, None, None), (501, "", 0.0, "x"), (502, "tail " * 40_000, 0.0, "x"), (3, None, 0.0, "x"), (None, "alpha1", 0.0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(200)] + [(3, 0), (None, 1), (7, None)], "doc_id long, quality int")
    found = quality.score(docs, quality.fit(docs, labels))
    assert found.columns == [*docs.columns, "_score", "_predicted", "size_difference"]
    got = found.collect()
    assert len(got) == len(rows)
    assert all((r["_predicted"] == 1) == (r["doc_id"] % 2 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and r["text"])
    assert len({r["_score"] for r in got if not r["text"]}) == 1
    assert quality.classify(docs.limit(0), labels).count() == 0
    for some in (labels.limit(0), labels.filter("quality = 1")):
        assert {r["score"] for r in quality.classify(docs, some).collect()} == {0.0}


ARTICLE = "<p>" + "plain words of an article, with commas, " * 10 + "</p>"


@pytest.mark.parametrize("kept", ['<p title="the hidden truth">KEEP</p>', '<p>x <a href="/hidden/gems">KEEP</a></p>', '<p data-id="comments-1">KEEP</p>', '<p data-hidden="false">KEEP</p>', "<p title='class=\"hidden\"'>KEEP</p>", '<p alt="id=sidebar" class = lead>KEEP</p>'])
def test_values_of_other_attributes_drop_nothing(kept):
    assert "KEEP" in html_extract.extract(f"<html><body><article>{ARTICLE}{kept}</article></body></html>")


@pytest.mark.parametrize("gone", ["<p hidden>GONE</p>", '<p hidden="">GONE</p>', '<p aria-hidden="true">GONE</p>', '<div class="comments">GONE</div>', '<p style="display:none">GONE</p>', "<div id='sidebar'>GONE</div>", "<div data-x='1' ROLE=navigation>GONE</div>"])
def test_furniture_and_hidden_elements_go(gone):
    assert "GONE" not in html_extract.extract(f"<html><body><article>{ARTICLE}{gone}</article></body></html>")


def test_very_deep_pages_take_time_in_proportion():
    began = time.time()
    assert html_extract.extract("<div>text, here " * 60_000 + "<b>" * 20_000 + "<p>x</p></i>" * 20_000)
    assert time.time() - began < 30


def test_equal_containers_and_odd_tables(spark):
    part = f"<div>{ARTICLE}</div>"
    assert html_extract.extract(f"<body>{part}{part}</body>").count("plain words") == 20  # the second scores like the first
    pages = spark.createDataFrame([(1, "u", None, "x", 2), (None, None, "<p>a &amp; b</p>", "y", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(repr, map(tuple, html_extract.extract_pages(pages).collect()))) == sorted([repr((1, "u", "", 0)), repr((None, None, "a & b", 5))])
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
