"""The training-data operators against brute-force versions on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from skyfold.llm import bpe, flac, html_extract, packing, sharding, simhash, substring_dedup, topk, toxicity, warc
from skyfold.llm.components import connected_components
from skyfold.llm.queries import BYTE_BPE

DOCS = "doc_id long, text string, lang string, n_words string"


def corpus(seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts, and a column whose name clashes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(30))
    texts: list[str | None] = [None, "", " \t\n", "one", "Two words", "a b c", passage, "x " * 3000]
    for i in range(60):
        body = [word() for _ in range(rng.randint(1, 120))]
        if i % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        texts.append(rng.choice([" ", "  ", "\n"]).join(body))
    texts += [texts[20], texts[20], texts[20].upper(), texts[25] + " tail", texts[30].replace("a", "e", 1)]
    rng.shuffle(texts)
    return [(i, t, rng.choice(["en", None]), "clash") for i, t in enumerate(texts)]


def rows_of(df) -> list:
    return [tuple(r) for r in df.collect()]


def test_substring_dedup(spark):
    docs = corpus()
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, DOCS).drop("n_words"), window=20).collect()}
    seen: set = set()
    removed_any = False
    for doc_id, text, *_ in sorted(docs, key=lambda d: d[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        r = got[doc_id]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
        assert r["text"] == (kept.decode() if any(gone) else text)
        assert sum(b - a for a, b in r["spans"]) == sum(gone)
        removed_any |= any(gone)
    assert removed_any


def test_substring_dedup_takes_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), DOCS)
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == [*docs.columns, "_n_words", "n_removed", "kept_sha256", "spans"]
    assert {r["n_words"] for r in got.collect()} == {"clash"}
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_dedup_of_repeated_and_null_numbers(spark):
    body = " ".join(f"w{k}" for k in range(25))
    docs = spark.createDataFrame([(7, body), (7, body), (None, body), (3, "x " + body), (9, body + " y")], "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == [(False, 3, "x " + body), (False, 7, ""), (False, 7, ""), (False, 9, "y"), (True, None, "")]


@pytest.mark.parametrize("chunk", [3_000_000, 2000])
def test_words_decide_where_all_hashes_collide(spark, monkeypatch, chunk):
    """All words of one length have one hash, so every anchor and every label is shared by differing windows."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    docs = [(i, t) for i, t, *_ in corpus(4)]
    seen, expected = set(), {}
    for doc_id, text in docs:
        words = (text or "").split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        expected[doc_id] = sum(gone)
    found = substring_dedup._Suffixes

    class Colliding(found):
        def labels(self, length):
            return np.zeros(len(self.hashes) - length + 1, np.uint64)

    monkeypatch.setattr(substring_dedup, "_Suffixes", Colliding)
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == expected


def test_suffixes_are_in_the_order_of_their_words():
    rng = np.random.default_rng(3)
    numbers = rng.integers(0, 3, 400)
    at = np.arange(380)
    order = substring_dedup.suffix_order(numbers, at, (at,), 20)
    assert order.tolist() == sorted(range(380), key=lambda k: (numbers[k : k + 20].tolist(), k))
    depths = substring_dedup.common_prefixes(numbers, order, 20)
    for k in range(1, 380):
        a, b = numbers[order[k] : order[k] + 20], numbers[order[k - 1] : order[k - 1] + 20]
        assert depths[k] == np.cumprod(a == b).sum()


def test_suffix_groups_split_by_prefix_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "GROUP_SUFFIXES", 50)
    docs = spark.createDataFrame(corpus(2), DOCS).drop("n_words").repartition(3)
    small = sorted(rows_of(substring_dedup.remove_repeats(docs).select("doc_id", "kept_sha256")))
    monkeypatch.undo()
    assert small == sorted(rows_of(substring_dedup.remove_repeats(docs).select("doc_id", "kept_sha256")))


TEXTS = ["", "\n", " ", "  ", " a", "a ", "a  b", "a \nb", "\n\na", "<|endoftext|>", "x<|endoftext|> y", "a" * 3000, "don't we'll", "tab\tand nbsp", "　wide", "漢字🙂 1239 ß", "%%% ***foo### bar"]


def test_bpe_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab  \n\t.,'sxyzé漢🙂12<|endoftext|> ll're the") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    vocab = bpe.vocabulary(BYTE_BPE)
    flat, offsets = vocab.encode(pa.array([*texts, None]))
    for k, text in enumerate([*texts, ""]):
        ids = flat[offsets[k] : offsets[k + 1]].tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip_and_columns(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids2 string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE).collect()}
    assert back == {i: t for i, t in enumerate([*TEXTS, ""])}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    for r in bpe.round_trip(docs, BYTE_BPE).collect():
        text = [*TEXTS, ""][r["doc_id"]]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), BYTE_BPE).count() == 0


def test_bpe_cuts_words_as_the_pattern_does():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(6)
    parts = ["'s", "'ll", "'", "''", "don't", "'tis", " ", "  ", "\n", "\u3000", "\xa0", "a", "Z9", "²", "é", "日本", "!", "<|endoftext|>", "<|", "|>", "\u0301", "🙂", "\x1c", "\x85", "\u200b", "Ⅷ", "'S", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    flat, offsets = bpe.vocabulary(BYTE_BPE).encode(pa.array(texts))
    for k, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert flat[offsets[k] : offsets[k + 1]].tolist() == found.ids, texts[k]


def test_bpe_pairs_are_checked_like_merges():
    vocab = bpe.vocabulary(BYTE_BPE)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 2000, 3000)
    sound = [vocab._is_sound(int(x)) and vocab._is_sound(int(y)) for x, y in zip(a, b)]
    expected = [vocab.merged(vocab.bytes[x] + vocab.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert [o for o, s in zip(vocab.compatible(a, b).tolist(), sound) if s] == [e for e, s in zip(expected, sound) if s]
    long = rng.integers(97, 123, 200).astype(np.uint8).tobytes()
    short = vocab.merged(long[:60])
    assert vocab._merged_long(list(map(vocab._byte_ids.__getitem__, long[:60]))) == short


def test_sharding(spark):
    docs = corpus() + [(7, "again", None, "x")]
    got = sharding.assign_shards(spark.createDataFrame(docs, DOCS), 4).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    sizes, longest = [0] * 4, max(r["size"] for r in got)
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes) - min(sizes) <= 2 * longest
    for shard in range(4):
        own = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own)))
    texts = {(i, zlib.crc32((t or "").encode())): t or "" for i, t, *_ in docs}
    ordered = [(hashlib.md5(texts[r["doc_id"], r["text_crc32"]].encode()).hexdigest(), r["doc_id"]) for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert ordered == sorted(ordered)  # contiguous, equal texts together
    assert sharding.assign_shards(spark.createDataFrame([], DOCS)).count() == 0


def brute_components(values: dict[int, int], most: int) -> dict[int, int]:
    out = {i: i for i in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (values[a] ^ values[b]).bit_count() <= most and out[a] != out[b]:
                    out[a] = out[b] = min(out[a], out[b])
                    changed = True
    return out


def test_simhash_near_duplicates(spark):
    docs = corpus()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    prints = {}
    for i, t, *_ in docs:
        words = (t or "").encode().translate(lower).split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    expected = brute_components(prints, 3)
    got = simhash.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert {r["doc_id"]: r["fingerprint"] % 2**64 for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    assert len(set(expected.values())) < len(expected)


def test_simhash_broadcasts_no_table_of_its_keys(spark, monkeypatch):
    plans, write = {}, simhash.store.materialize

    def seen(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, **options)

    monkeypatch.setattr(simhash.store, "materialize", seen)
    # an exploded table is sized like its input, so by the default threshold Spark would broadcast this small one
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760b", "10MB")
    found = simhash.near_duplicates(spark.createDataFrame(corpus(), DOCS))
    assert "SortMergeJoin" in plans["keys"] and "BroadcastHashJoin" not in plans["keys"] + plans["edges"]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_simhash_links_connect_what_pairs_connect(spark, monkeypatch):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(20)}
    for _ in range(300):  # a chain of close fingerprints: heavy keys
        v = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    monkeypatch.setattr(simhash, "LIGHT_KEY", 5)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    named = {v: v for v in signed}
    expected = brute_components({v: v % 2**64 for v in named}, 3)
    assert {v: found.get(v, v) for v in signed} == expected


def test_connected_components_of_long_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (101, 102), (102, 101)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 101: 101, 102: 101}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href=/a>menu</a></li></ul></nav><div id="cookie-notice">We use cookies, sorry.</div><div class="layout"><div class="content">
<h2>Head &amp; line</h2><p>First paragraph, with commas, and  a <b>bold</b>
word. {0}</p><p>Second one, short.<!-- hidden --></p><form><p>Sign up, now</p></form></div>
<aside class=sidebar><p>Side, text, here {0}</p></aside></div><section class="comments"><p>I disagree, strongly, {0}</p></section><footer>f</footer></body></html>"""


def test_html_extraction():
    text = html_extract.extract(PAGE.format("word " * 40))
    assert text.split("\n")[0] == "Head & line"
    assert text.split("\n")[1].startswith("First paragraph, with commas, and a bold word. word")
    assert text.split("\n")[2:] == ["Second one, short."]
    for bad in ("menu", "cookies", "Sign up", "Side", "disagree", "Site", "var a"):
        assert bad not in text
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<html><body></body>") == ""
    assert html_extract.extract("plain &amp text") == "plain & text"
    assert html_extract.extract("<article><p>cut off &am") == "cut off &am"
    assert html_extract.extract("<article><p>one<p>two</p") == "one\ntwo"
    assert html_extract.extract("<p>" * 3000 + "deep") == "deep"


def test_html_furniture_names_do_not_hide_the_article():
    body = "word " * 40
    wrapped = f"<div class='layout has-sidebar'><article><p>Main, {body}</p></article><div class='sidebar'><p>Side, {body}</p></div></div>"
    assert html_extract.extract(wrapped).startswith("Main") and "Side" not in html_extract.extract(wrapped)
    assert html_extract.extract(f"<div class='banner'><p>Only, {body}</p></div>").startswith("Only")
    talk = f"<main><p>Main, {body}</p></main><section id='comments'><article class='comment'><p>Talk, {body}</p></article></section>"
    assert "Talk" not in html_extract.extract(talk)
    inner = f"<article><p>A, {body}</p><div class='ad'>Buy</div><p>B</p><div class='comments'><p>C, {body}</p></div></article>"
    assert html_extract.extract(inner).split("\n")[1:] == ["B"]
    assert html_extract.extract("<article><table><tr><td>1</td><td>2</td></tr></table><pre>a\n  b</pre><blockquote>q</blockquote></article>") == "1\n2\na b\nq"


def test_html_sections_of_an_article_stay():
    long = ", ".join(["word " * 30] * 30)
    short = "".join(f"<section><h2>Part {k}</h2><p>Short {k}.</p></section>" for k in range(4))
    for tag in ("article", "main"):
        text = html_extract.extract(f"<body><nav>menu</nav><{tag}><h1>Head</h1><section><p>{long}</p></section>{short}<aside>Side</aside></{tag}><div><p>Elsewhere</p></div></body>").split("\n")
        assert text[0] == "Head" and text[2:] == [x for k in range(4) for x in (f"Part {k}", f"Short {k}.")]
    nested = f"<main><article><p>{long}</p></article><div class='list'><p>More</p></div></main>"
    assert "More" not in html_extract.extract(nested)


def test_html_extraction_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE.format("word " * 40), "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract_pages(pages).collect()}
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0
    assert got[1]["n_chars"] == len(got[1]["text"]) > 0


def test_flac_round_trip_damage_and_seeking():
    rng = random.Random(4)
    payloads = [b"", b"a", rng.randbytes(2000), b"x" * 5000, b"\x00" * 575 + b"\xff" * 600, bytes(range(256)) * 20, flac._SYNC * 500, bytes(int(128 + 100 * np.sin(i / 9)) for i in range(6000)), b"The text of a document. " * 90]
    payloads += [rng.randbytes(rng.randint(1, 1300)) for _ in range(20)]
    padded = [flac.padded(p) for p in payloads]
    streams = flac.encode(padded)
    assert flac.decode(streams) == padded
    assert flac.encode([padded[3]]) == [streams[3]]
    assert sum(map(len, streams[7:9])) < sum(map(len, padded[7:9]))
    long = flac.padded(rng.randbytes(40_000))
    stream = flac.encode([long])[0]
    for sample in (0, 575, 576, len(long) // 2, len(long) - 1):
        first, block = flac.read_block(stream, sample)
        assert first <= sample < first + flac.BLOCK and block == long[first : first + flac.BLOCK]
    for at in (60, len(stream) // 2, len(stream) - 1):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def plain_decode(stream: bytes) -> bytes:
    """A second decoder, bit by bit from the format's description, for mono streams of blocks of 576 samples."""
    at, last = 4, False
    while not last:
        last, size = bool(stream[at] >> 7), int.from_bytes(stream[at + 1 : at + 4], "big")
        at += 4 + size
    bits = "".join(f"{b:08b}" for b in stream[at:])
    pos, out = 0, []

    def take(n: int, signed: bool = False) -> int:
        nonlocal pos
        value = int(bits[pos : pos + n], 2) if n else 0
        pos += n
        return value - (1 << n) if signed and n and value >> (n - 1) else value

    while pos < len(bits):
        assert take(16) == 0xFFF8 and take(8) == 0x24 and take(8) == 0x02
        more = take(8)
        for _ in range(0 if more < 128 else f"{more:08b}".index("0") - 1):
            take(8)
        take(8)
        kind = take(8) >> 1
        if kind == 0:
            x = [take(8, True)] * 576
        elif kind == 1:
            x = [take(8, True) for _ in range(576)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [take(8, True) for _ in range(order)]
            shift, c = 0, {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.get(order, [])
            if kind >= 32:
                precision, shift = take(4) + 1, take(5, True)
                c = [take(precision, True) for _ in range(order)]
            width, parts = (5 if take(2) else 4), 1 << take(4)
            for k in range(parts):
                rice = take(width)
                for _ in range(576 // parts - (order if not k else 0)):
                    high = bits.index("1", pos) - pos
                    pos += high + 1
                    value = high << rice | take(rice)
                    residual = value >> 1 if not value & 1 else -(value >> 1) - 1
                    x.append(residual + (sum(a * b for a, b in zip(c, x[::-1])) >> shift))
        pos += -pos % 8 + 16
        out += x
    return bytes(v + 128 for v in out)


def test_flac_streams_decode_with_a_second_decoder():
    rng = random.Random(7)
    payloads = [b"", b"x" * 1200, rng.randbytes(600), "Ein Text, ünd mehr. ".encode() * 80, bytes(int(128 + 100 * np.sin(i / 9)) for i in range(2000)), bytes(range(256)) * 3]
    padded = [flac.padded(p) for p in payloads]
    assert [plain_decode(s) for s in flac.encode(padded)] == padded


def test_flac_numbers_of_very_long_streams():
    n = np.array([0, 127, 128, 2047, 2048, 65535, 65536, (1 << 21) - 1, 1 << 21, 1 << 26, 1 << 31, (1 << 36) - 1])
    out, size = flac._numbers(n)
    assert size.tolist() == [1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 7]
    for k in range(8):
        assert bytes(out[k, : size[k]]) == chr(int(n[k])).encode("utf-8", "surrogatepass") if n[k] < 0x110000 else True
    assert bytes(out[-1]) == b"\xfe" + b"\xbf" * 6


def test_flac_columns(spark):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in corpus()], "doc_id long, text string")
    media = flac.encode_column(docs, "doc_id", "text")
    texts = {i: flac.padded((t or "").encode()) for i, t, *_ in corpus()}
    assert flac.describe_column(flac.pcm_column(media.limit(0), "doc_id"), "doc_id").count() == 0
    for r in flac.describe_column(flac.pcm_column(media, "doc_id"), "doc_id").collect():
        p = texts[r["doc_id"]]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    blocks = flac.pcm_blocks(media, "doc_id").orderBy("doc_id", "sample_offset").collect()
    joined: dict[int, bytes] = {}
    for b in blocks:
        assert b["sample_offset"] == len(joined.get(b["doc_id"], b""))
        joined[b["doc_id"]] = joined.get(b["doc_id"], b"") + bytes(b["pcm"])
    assert joined == texts


def labelled(n: int = 900) -> tuple[list, list]:
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ten", "so", "ru"]) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        body = [word() + ("." if k % 9 == 8 else "") for k in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                body.insert(rng.randrange(len(body)), rng.choice(["idiot", "zorb" + word(), "zorb" + word()]))
        docs.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_learns_words_and_stems(spark):
    docs, labels = labelled()
    docs += [(5000, None), (5001, ""), (5002, "you are no idiot"), (5003, "he said you idiot"), (5004, "you idiot")]
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(d, m).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i, _ in labels)
    right = sum(got[i]["predicted"] == dict(labels)[i] for i in held)
    assert right / len(held) > 0.97
    assert got[5000]["score"] == got[5001]["score"] < 0.3
    assert got[5002]["score"] < got[5003]["score"] < got[5004]["score"]


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "you idiot")], "doc_id long, text string")
    assert toxicity.classify(d, spark.createDataFrame([], "doc_id long, toxic int")).first()["score"] == 0


def test_toxicity_grammar():
    g = toxicity.Grammar()
    insult, target, no, report, threat, other = toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT, toxicity.OTHER
    plain = g.score([insult], [2.0])
    assert g.score([target, other, insult], [0, 0, 2.0]) > plain > g.score([no, insult], [0, 2.0]) > 0
    assert g.score([report, other, insult], [0, 0, 2.0]) < plain
    assert g.score([threat, other, target], [0, 0, 0]) > 0 == g.score([threat, other], [0, 0])


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    docs = corpus() + [(3, "again", None, "x")]
    got = packing.pack_documents(spark.createDataFrame(docs, DOCS), BYTE_BPE, capacity=64).collect()
    ids = {}
    for i, t, *_ in docs:
        ids.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    pieces, places = {}, {}
    for r in got:
        own = next(x for x in ids[r["doc_id"]] if zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"])
        pieces.setdefault((r["doc_id"], len(own)), []).append((r["piece"], r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (_, n), found in pieces.items():
        found.sort()
        assert [p for p, *_ in found] == list(range(len(found))) and sum(x for *_, x in found) == n
        assert all(x == 64 for *_, x in found[1:]) and found[0][1] == 0
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [sum(x for _, x in found[:k]) for k in range(len(found))] and sum(x for _, x in found) <= 64
    assert len(places) <= 1.05 * sum(len(x) for v in ids.values() for x in v) / 64 + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), BYTE_BPE).count() == 0


def test_packing_plan_uses_exact_complements():
    assert packing.plan({1500: 2, 548: 2}, 2048) == [((1500, 548), 2)]
    assert packing.plan({1000: 1, 500: 1, 300: 1, 248: 1}, 2048) == [((1000, 500, 300, 248), 1)]
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.lognormal(6, 1.2, 20_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    used: dict[int, int] = {}
    total = 0
    for held, times in packing.plan(counts, 2048):
        assert sum(held) <= 2048
        total += times
        for n in held:
            used[n] = used.get(n, 0) + times
    assert used == counts and total <= -(-int(lengths.sum()) // 2048) + 2


def test_warc_bundles(spark):
    pages = [(1, "http://a", "same", "x"), (5, None, "same", "x"), (3, "http://c", "same", "x"), (4, "http://d", None, "x"), (6, "http://e", "", "x"), (-7, "http://f", "ünïcode " * 90_000, "x"), (8, "http://g", "other\r\n\r\nlines", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    bundles = warc.write_bundles(df)
    got = {r["page_id"]: r for r in warc.read_bundles(bundles).collect()}
    payload = {p: (h or "").encode() for p, _, h, _ in pages}
    for p, r in got.items():
        last = max(q for q in payload if payload[q] == payload[p])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload[p]), base64.b32encode(hashlib.sha1(payload[p]).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last == p else ("revisit", last))
    assert len(got) == len(pages)
    none = {r["page_id"]: r["record_type"] for r in warc.read_bundles(warc.write_bundles(df, least_bytes=5)).collect()}
    assert set(none.values()) == {"response"}
    assert warc.read_bundles(warc.write_bundles(spark.createDataFrame([], df.schema))).count() == 0


def test_warc_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "u", str(i % 3)) for i in range(60)], "page_id long, url string, html string")
    whole = sorted(rows_of(warc.read_bundles(warc.write_bundles(df)).select("page_id", "refers_to")), key=str)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(rows_of(warc.read_bundles(warc.write_bundles(df)).select("page_id", "refers_to")), key=str) == whole


def test_warc_takes_any_url_and_finds_records(spark):
    urls = ["http://a\r\n\r\nb", "\x00\x1f\x7f", " pad ", "ünï: x", "a\u2028b\x85c", "", None, "http://x/%20y?z=1"]
    df = spark.createDataFrame([(i, u, f"page {i % 6}") for i, u in enumerate(urls * 9)], "page_id long, url string, html string").repartition(3)
    bundles = warc.write_bundles(df)
    got = {r["page_id"]: r for r in warc.read_bundles(bundles).collect()}
    assert len(got) == 72 and all(r["payload_bytes"] == 6 for r in got.values())
    assert warc.target("http://a\r\n\r\nb") == "http://a%0D%0A%0D%0Ab" and warc.target("http://x/ä b") == "http://x/ä b"
    assert sorted(r["page_id"] for r in warc.record_index(bundles).collect()) == list(range(72))
    wanted = spark.createDataFrame([(70,), (71,), (3,), (1000,), (3,)], "page_id long")
    found = {r["page_id"]: bytes(r["record"]) for r in warc.read_by_id(bundles, wanted).collect()}
    assert set(found) == {3, 70, 71}
    assert found[71].endswith(b"\r\n\r\npage 5") and found[3].endswith(b"\r\n\r\n")
    assert bundles.select("bundle").distinct().count() == bundles.count() > 1
    # equal bundles of different partitions stay apart, and a repeated identifier gives each of its records
    twice = spark.createDataFrame([(7, "u", "same")] * 2, "page_id long, url string, html string").repartition(2)
    assert [bytes(r["record"])[-4:] for r in warc.read_by_id(warc.write_bundles(twice), wanted.limit(0).union(spark.range(8))).collect()] == [b"same"] * 2


def test_warc_archive_is_plain_zstandard():
    import zstandard

    bundle = warc.Bundle()
    records = {i: warc.write_record(i, "u", "2024-01-01T00:00:00Z", b"p" * 100_000, b"d" * 20, None) for i in range(5)}
    for i, r in records.items():
        bundle.add(i, r)
    archive = bundle.finish()
    table = warc.seek_table(archive)
    assert len(table) > 1
    with zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True) as reader:
        assert reader.read() == b"".join(records.values())
    for i, frame, offset in bundle.index:
        assert warc.page_of(warc.read_record(warc.read_frame(archive, table, frame), offset)[0]["WARC-Record-ID"]) == i
    assert warc.page_of(warc.record_id(-5)) == -5


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "FIRST_ROUND", 1)
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.normal(0, 0.2, 8) + (i % 4)).tolist()) for i in range(400)]
    vectors += [(500 + i, vectors[3][1]) for i in range(60)]  # ties
    vectors += [(700, None), (750, [float("nan")] * 8), (None, [9.0] * 8), (800, [float("inf")] * 8), (850, [None] * 8), (900, [1.0, 2.0])]
    got: dict[int, list] = {}
    for r in topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 5, 50, pivots=6).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: np.pad(np.floor(256 * np.array(v)).astype(int), (0, 8 - len(v))) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in whole:
        if q % 50 == 0:
            best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
            assert got[q] == [(i, -s) for s, i in best]
    assert set(got) == {q for q in whole if q % 50 == 0}
    repeated = [(50, [2.0, 1.0]), (50, [1.0, 3.0]), (50, [1.0, 3.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0])]
    asked = topk.top_k(spark.createDataFrame(repeated, "vec_id long, embedding array<double>"), pivots=2).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in asked] == [(50, 1, 3 * 256**2), (50, 1, 256**2)]  # the least vector asks
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).collect()[0]["vec_id"] == 1
