"""Near copies by SimHash and exact shingle similarity against brute force over all pairs."""

from __future__ import annotations

import random

import pytest

from skyfold.llm import near_copies, store


def shingles(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def similar(a: frozenset, b: frozenset) -> bool:
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9 > 0


def components(sets: dict[int, frozenset]) -> dict[int, int]:
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and group[a] != group[b] and similar(sets[a], sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return group


def corpus(seed: int = 5) -> list:
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(60)]
    docs = []
    for base in range(12):
        text = [word() for _ in range(rng.randint(30, 250))] + (common if base % 2 else [])
        for copy in range(12):  # a copy differs by 0 to 11 words, so that similarities lie on both sides of 0.8
            own = list(text)
            for at in rng.sample(range(len(own)), copy):
                own[at] = word()
            docs.append((20 * base + copy, " ".join(own)))
    return [*docs, (900, None), (901, ""), (902, "A b"), (903, "a  B"), (904, "a b c"), (905, "x " * 50), (906, "x " * 90)]


def test_linked_documents_are_similar_and_groups_are_those_of_brute_force(spark):
    docs = corpus()
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expected = components({i: shingles(t) for i, t in docs})
    assert set(got) == set(expected)
    for i, g in got.items():  # never more than brute force joins
        assert expected[i] == expected[g] and g <= i
    assert got == expected
    loose = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), exact=False).collect()}
    dropped = [i for i, g in expected.items() if i != g]
    assert sum(loose[i] != i for i in dropped) >= 0.8 * len(dropped)
    assert all(expected[i] == expected[g] for i, g in loose.items())
    for a, b in ((900, 901), (902, 903), (905, 906)):
        assert got[a] == got[b]
    assert got[904] == 904


@pytest.mark.parametrize("low", [0.8, 0.85])
def test_pairs_with_scattered_edits_and_with_one_block_of_new_words(spark, low):
    """Pairs of 120 to 400 words, edited until their similarity is between low and low + 0.05: every second one in one block."""
    rng = random.Random(int(100 * low))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    often = [word() for _ in range(30)]
    docs, pairs = [], 0
    while pairs < 200:
        text = [rng.choice(often) if rng.random() < 0.4 else word() for _ in range(rng.randint(120, 400))]
        own = list(text)
        at, edits = rng.randrange(len(own)), 0
        while len(shingles(" ".join(own)) & shingles(" ".join(text))) > (low + 0.04) * len(shingles(" ".join(own)) | shingles(" ".join(text))):
            own[(at + edits) % len(own) if pairs % 2 else rng.randrange(len(own))] = word()
            edits += 1
        a, b = " ".join(text), " ".join(own)
        if len(shingles(a) & shingles(b)) >= low * len(shingles(a) | shingles(b)):
            docs += [(2 * pairs, a), (2 * pairs + 1, b)]
            pairs += 1
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(pairs))
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_rows_of_one_number_empty_tables_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(3, text, 1, "x")] * 3 + [(1, text + " end", 2, "y"), (2, None, 3, None)], "doc_id long, text string, component_id int, hashes string")
    assert sorted(tuple(r) for r in near_copies.near_copies(docs).select("doc_id", "component_id").collect()) == [(1, 1), (2, 2)] + [(3, 1)] * 3
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_members_of_a_large_group_are_compared_by_rare_shingles(spark):
    """Copies of one text, each edited so far that many are similar to a few others only."""
    rng = random.Random(9)
    text = [f"w{k}" for k in range(200)]
    docs = []
    for i in range(80):
        own = list(text)
        for at in rng.sample(range(200), rng.choice([1, 3, 5])):
            own[at] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == components({i: shingles(t) for i, t in docs})


def test_texts_of_one_number_are_dropped_only_for_a_kept_copy(spark):
    """Rows of one doc_id with unrelated texts both stay; equal rows, and texts that differ in case alone, leave one."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(1, text("a"), 0), (1, text("b"), 1), (2, text("c"), 2), (3, text("b") + " tail", 3), (4, text("d").upper(), 4), (4, text("d"), 5), (5, text("e"), 6), (5, text("e"), 6), (6, None, 7), (6, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_key int").repartition(3)
    got = sorted((r["doc_id"], r["text"] or "") for r in near_copies.keep_one(docs).collect())
    assert got == [(1, text("a")), (1, text("b")), (2, text("c")), (4, text("d").upper()), (5, text("e")), (6, "")]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_heavy_shingles_come_last_and_nothing_is_lost(spark, monkeypatch):
    """Texts that are mostly passages which many share: their parts are used up by heavy shingles, so whole sets are read."""
    monkeypatch.setattr(near_copies, "HEAVY", 3)
    monkeypatch.setattr(near_copies, "SLACK_LEAST", 0)
    rng = random.Random(7)
    passages = [[f"p{n}x{k}" for k in range(25)] for n in range(8)]
    docs = []
    for i in range(120):
        body = [f"r{rng.randrange(10**6)}" for _ in range(rng.choice([0, 3, 10, 40]))]
        docs.append((i, " ".join(sum(rng.sample(passages, rng.choice([1, 2, 4])), []) + body)))
    docs += [(200 + i, t + " end of it") for i, t in docs[::7]]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == components({i: shingles(t) for i, t in docs})


def test_near_copies_that_do_not_link_are_told_apart_without_listing_their_pairs(spark, monkeypatch):
    """Copies of one text, half of them edited too far to link: of these, few pairs are compared."""
    rng = random.Random(3)
    text = [f"w{k}" for k in range(150)]
    docs = [(0, " ".join(text))]
    for i in range(1, 200):
        own = list(text)
        for at in rng.sample(range(3, 147), rng.choice([1, 2, 8, 9])):
            own[at] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    pairs = []
    before = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda listed, *more: pairs.append(listed.count()) or before(listed, *more))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == components({i: shingles(t) for i, t in docs})
    assert sum(pairs) <= 5 * len(docs)


def test_census_counts_the_shingles_that_another_set_has(spark):
    docs = [(1, "a b c d e f g h"), (2, "a b c d e f x y"), (3, "q r s t u v"), (4, None)]
    sets = near_copies._marked(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 5, 42, 4).selectExpr("doc_id as id", "doc_id as node", "set_key")
    texts = near_copies._texts(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", sets)
    assert {r["node"]: r["repeated"] for r in near_copies._census(texts, 5, 3).collect()} == {1: 2, 2: 2, 3: 0}


def shuffled(spark) -> dict[int, int]:
    """Bytes that each stage so far has written to shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = context._gateway
    stages = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_texts_without_a_partner_are_not_shuffled(spark, tmp_path):
    """Long words make texts much larger than their shingles' hashes; of 300 documents ten are copies or near copies."""
    rng = random.Random(4)
    texts = [" ".join(f"{rng.getrandbits(240):060x}" for _ in range(150)) for _ in range(290)]
    rows = list(enumerate([*texts, *texts[:5], *(t + " end" for t in texts[5:10])]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, usual = set(shuffled(spark)), spark.conf.get(name)
    spark.conf.set(name, "-1")  # as with tables too large to be broadcast
    try:
        got = sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect())
    finally:
        spark.conf.set(name, usual)
    assert got == list(range(290))
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 0.6 * sum(len(t) for _, t in rows)


def test_a_bitmap_parts_rows_and_loses_none_of_its_keys(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("id", "id as _bits")
    keys = spark.range(0, 5000, 50)
    for most, others in ((store.MOST_BITS, 300), (64, 4900)):  # a full bitmap lets more through
        monkeypatch.setattr(store, "LEAST_BITS", min(store.LEAST_BITS, most))
        monkeypatch.setattr(store, "MOST_BITS", most)
        bitmap = store.key_bitmap(keys)
        among, rest = ({r["id"] for r in store.by_bitmap(rows, "id", bitmap, side).collect()} for side in (True, False))
        assert {k for k in range(0, 5000, 50)} <= among and len(among) <= 100 + others
        assert among | rest == set(range(5000)) and not among & rest
    none = store.key_bitmap(keys.limit(0))
    assert store.by_bitmap(rows, "id", none).count() == 0 and store.by_bitmap(rows, "id", none, False).columns == ["id", "_bits"]
