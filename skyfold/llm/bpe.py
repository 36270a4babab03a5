"""Byte-level BPE by speculation: propose by greedy longest match, verify adjacent pairs in bulk, merge only what fails.

A token sequence is what the merges produce exactly if every token is the encoding of its own bytes and every adjacent pair
would stay two tokens when encoded alone. Whether a pair does is settled by undoing, of the two tokens that touch, the one
that a later merge made, until either a merge across the boundary turns out to come first or only bytes are left; the check
runs over all pairs of a batch at once. Words whose greedy proposal fails it, a minority, are merged exactly.

Work is per Arrow batch inside mapInArrow: all texts are cut into words at once by the kinds of neighbouring characters, which
is what the pre-tokenizer's pattern comes to; the words, which cover the batch's text buffer without gaps, are numbered by
Arrow's dictionary encoding, those that the worker's bounded cache lacks are encoded in bulk, and the ids of all texts are
gathered from their words' ids at once.

Edge cases: null is the empty text and has no ids; special tokens' strings in a text become their ids, as the vocabulary file
says; undecodable bytes decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyfold.llm import store, words

#: Words in the newer of the two generations that a worker remembers; some 0.2 KB for each of these.
CACHE = 400_000
#: Bytes up to which words are merged side by side, and how many at once.
SHORT_WORD, STEP_WORDS = 64, 4_000
NO_RANK = 1 << 62
#: Text bytes encoded in one go.
BATCH_BYTES = 14_000_000

# fixed values: the white space of Unicode, and the suffixes that the byte-level pre-tokenizer's pattern cuts off at a quote;
# the rest of that pattern is runs of letters, of numbers and of other characters, each with the space before it
_BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(maxsize=1)
def _kind_table() -> np.ndarray:
    """Kind of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, f"[{_BLANKS}]+")):
            for m in regex.finditer(pattern, every):
                table[low + m.start() : low + m.end()] = kind
    return table


def character_kinds(data: np.ndarray) -> np.ndarray:
    """Kind of the character that each byte of a UTF-8 buffer belongs to."""
    table = _kind_table()
    kinds = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
        for k in range(4):
            kinds[lead[size > k] + k] = table[point[size > k]]
    return kinds


def _byte_characters() -> dict[str, int]:
    """Byte-level vocabularies print the visible Latin-1 characters as themselves, the other bytes from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Lookup:
    """Numbers by key for whole arrays: an open-addressing table with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self._bits = max(4, int(len(keys) * 2.5).bit_length())
        self._keys, self._values, self._missing = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, missing, np.int64), missing
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self._keys[slot] < 0
            self._keys[slot[free]] = keys[left[free]]
            won = self._keys[slot] == keys[left]
            self._values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self._bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        held = self._keys[slot]
        out = self._values[slot]
        again = np.flatnonzero((held != keys) & (held >= 0))
        out[held != keys] = self._missing
        while len(again):
            slot[again] = (slot[again] + 1) & ((1 << self._bits) - 1)
            held = self._keys[slot[again]]
            found = held == keys[again]
            out[again[found]] = self._values[slot[again[found]]]
            again = again[~found & (held >= 0)]
        return out


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str, cache: int = CACHE):
        self._cache = cache
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        characters = _byte_characters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        raw = {bytes(characters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        n = max([*raw.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for token, i in raw.items():
            self.bytes[i] = token
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.ids = raw
        self.left, self.right = np.arange(n), np.arange(n)
        self.born = np.zeros(n, np.int64)
        pairs: dict[tuple[int, int], int] = {}
        self._made = [0] * (len(spec["model"]["merges"]) + 1)
        for rank, merge in enumerate(spec["model"]["merges"], 1):
            a, b = (raw[bytes(characters[c] for c in part)] for part in (merge.split(" ") if isinstance(merge, str) else merge))
            made = raw[self.bytes[a] + self.bytes[b]]
            self._made[pairs.setdefault((a, b), rank)] = made
            if not self.born[made]:
                self.left[made], self.right[made], self.born[made] = a, b, rank
        self._rank_of = _Lookup(np.array([a * n + b for a, b in pairs], np.int64), np.array(list(pairs.values()), np.int64), NO_RANK)
        self._made_by = np.array(self._made, np.int64)
        self._trie(raw)
        self._pair_rank = pairs
        self._byte_ids = [raw[bytes([b])] for b in range(256)]
        self._of_byte = np.array(self._byte_ids, np.int64)
        self._sound: dict[int, bool] = {}
        self.split_special = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._decimal: list[str] = [str(i) for i in range(n)]
        self._special_bytes = {t.encode(): i for t, i in self.special.items()}
        self._words: dict[bytes, bytes] = {}
        self._old_words: dict[bytes, bytes] = {}

    def _trie(self, raw: dict[bytes, int]) -> None:
        """Edges (node, byte) of the tree of all tokens, and the token that ends at each node."""
        nodes: dict[bytes, int] = {b"": 0}
        for token in raw:
            for end in range(1, len(token) + 1):
                nodes.setdefault(token[:end], len(nodes))
        prefixes = [p for p in nodes if p]
        self._edge = _Lookup(np.array([nodes[p[:-1]] * 256 + p[-1] for p in prefixes], np.int64), np.array([nodes[p] for p in prefixes], np.int64), -1)
        self._ends = np.full(len(nodes), -1, np.int64)
        for token, i in raw.items():
            self._ends[nodes[token]] = i

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a number above all ranks."""
        return self._rank_of(a * len(self.bytes) + b)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens would stay two tokens."""
        ok = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        before = np.full(len(a), NO_RANK)
        while len(live):
            crossed = self._rank(x, y) < before
            ok[live[crossed]] = False
            bx, by = self.born[x], self.born[y]
            going = ~crossed & (np.maximum(bx, by) > 0)
            live, x, y, bx, by = live[going], x[going], y[going], bx[going], by[going]
            undo = bx > by
            before = np.where(undo, bx, by + 1)  # equal ranks apply from left to right
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def merged(self, word: bytes) -> list[int]:
        """Exact encoding: the lowest-ranked leftmost pair merges until none is left."""
        ids = [self._byte_ids[b] for b in word]
        if len(ids) > SHORT_WORD:
            return self._merged_long(ids)
        get, none = self._pair_rank.get, NO_RANK
        ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [self._made[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        known, made = self._pair_rank, self._made
        heap = [(known[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in known]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (found := known.get(p := (ids[k], ids[after[k]]))):
                    heapq.heappush(heap, (found, k, p))
        return [i for i in ids if i >= 0]

    def proposed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of words in a byte buffer: (word, token) in order. All words walk the tree of tokens in step."""
        word, at = np.arange(len(starts)), starts.copy()
        node, look = np.zeros(len(starts), np.int64), starts.copy()
        best, after = np.full(len(starts), -1, np.int64), starts.copy()
        words, tokens = [], []
        while len(word):
            inside = look < ends[word]
            nxt = np.where(inside, self._edge(node * 256 + data[np.minimum(look, len(data) - 1)]), -1)
            stuck = nxt < 0
            if stuck.any():
                words.append(word[stuck])
                tokens.append(best[stuck])
                at = np.where(stuck, after, at)
                look = np.where(stuck, at, look)
                node = np.where(stuck, 0, node)
            node = np.where(stuck, node, nxt)
            look = np.where(stuck, look, look + 1)
            token = np.where(stuck, -1, self._ends[node])
            best, after = np.where(token >= 0, token, best), np.where(token >= 0, look, after)
            going = ~(stuck & (at >= ends[word]))
            if not going.all():
                word, at, node, look, best, after = (x[going] for x in (word, at, node, look, best, after))
        words, tokens = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, tokens))
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def merged_in_step(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Exact encoding of many short words: each step merges the lowest-ranked leftmost pair of every word."""
        out: list[bytes] = [b""] * len(starts)
        for low, width in ((0, 8), (8, 12), (12, 16), (16, 24), (24, 40), (40, SHORT_WORD)):  # words of like length share a matrix
            every = np.flatnonzero((sizes > low) & (sizes <= width))
            for k in range(0, len(every), STEP_WORDS):
                self._merge_matrix(data, every[k : k + STEP_WORDS], starts, sizes, width, out)
        return out

    def _merge_matrix(self, data: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, out: list[bytes]) -> None:
        place = np.arange(width, dtype=np.int32)
        count = sizes[rows]
        ids = np.where(place < count[:, None], self._of_byte[data[np.minimum(starts[rows][:, None] + place, len(data) - 1)]], -1)
        ranks = np.full(ids.shape, NO_RANK, np.int64)
        r, c = np.nonzero(place[1:] < count[:, None])
        ranks[r, c] = self._rank(ids[r, c], ids[r, c + 1])
        live = np.arange(len(rows))
        while len(live):
            part = ranks[live]
            j = part.argmin(1)
            least = part[np.arange(len(live)), j]
            going = least < NO_RANK
            live, j, least = live[going], j[going], least[going]
            if not len(live):
                break
            move = np.minimum(place + (place > j[:, None]), width - 1)
            own = np.take_along_axis(ids[live], move, 1)
            part = np.take_along_axis(part[going], move, 1)
            own[:, -1], part[:, -1] = -1, NO_RANK
            at = np.arange(len(live))
            own[at, j] = self._made_by[least]
            right = np.where(j + 1 < width, own[at, np.minimum(j + 1, width - 1)], -1)
            near = np.where(right >= 0, self._rank(own[at, j], np.maximum(right, 0)), NO_RANK)
            before = np.flatnonzero(j > 0)
            part[at, j] = near
            part[before, j[before] - 1] = self._rank(own[before, j[before] - 1], own[before, j[before]])
            ids[live], ranks[live] = own, part
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)) * 4
        for k, a, b in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[k] = flat[a:b]

    def _is_sound(self, token: int) -> bool:
        if token not in self._sound:
            self._sound[token] = self.merged(self.bytes[token]) == [token]
        return self._sound[token]

    def encode_words(self, raw: list[bytes]) -> list[bytes]:
        """Ids of pre-tokenized words and special tokens, each as little-endian 32-bit numbers."""
        if not raw:
            return []
        sizes = np.array([len(w) for w in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        word, flat = self.proposed(data, ends - sizes, ends)
        bad = np.zeros(len(raw), bool)
        unsound = [t for t in np.unique(flat).tolist() if not self._is_sound(t)]
        if unsound:
            bad[word[np.isin(flat, unsound)]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, inverse = np.unique(flat[inner] * len(self.bytes) + flat[inner + 1], return_inverse=True)
        ok = self.compatible(pairs // len(self.bytes), pairs % len(self.bytes))
        bad[word[inner[~ok[inverse]]]] = True
        cuts = np.searchsorted(word, np.arange(len(raw) + 1)) * 4
        good = flat.astype("<u4").tobytes()
        out = [good[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        short = np.flatnonzero(bad & (sizes <= SHORT_WORD))
        for k, ids in zip(short.tolist(), self.merged_in_step(data, (ends - sizes)[short], sizes[short]), strict=True):
            out[k] = ids
        for k in np.flatnonzero(bad & (sizes > SHORT_WORD)).tolist():
            out[k] = np.array(self.merged(raw[k]), "<u4").tobytes()
        if self.special:
            for k, w in enumerate(raw):
                if w in self._special_bytes:
                    out[k] = np.array([self._special_bytes[w]], "<u4").tobytes()
        return out

    def _known(self, listed: list[bytes]) -> list[bytes]:
        """Ids of distinct words, from the cache or made now."""
        if len(self._words) > self._cache:
            self._old_words, self._words = self._words, {}
        found = list(map(self._words.get, listed))
        missing = [k for k, ids in enumerate(found) if ids is None]
        older = self._old_words.get
        fresh = []
        for k in missing:
            found[k] = older(listed[k])
            if found[k] is None:
                fresh.append(k)
        for k, ids in zip(fresh, self.encode_words([listed[k] for k in fresh]), strict=True):
            found[k] = ids
        self._words.update((listed[k], found[k]) for k in missing)
        return found

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of all words: each text cut as the pre-tokenizer's pattern does, special tokens left whole."""
        texts = np.zeros(len(data) + 1, bool)
        texts[offsets] = True
        inside = np.zeros(0, np.int64)
        if self.split_special:
            raw = data.tobytes()
            spans = [m.span() for m in self.split_special.finditer(raw)] if any(t in raw for t in self._special_bytes) else []
            # a span across two texts is none
            spans = [(a, b) for a, b in spans if not texts[a + 1 : b].any()]
            for a, b in spans:
                texts[[a, b]] = True
            if spans:
                inside = np.concatenate([np.arange(a + 1, b) for a, b in spans])
        kind = character_kinds(data)
        at = np.flatnonzero((kind[1:] != kind[:-1]) & ~texts[1:-1]) + 1
        after_space = kind[at - 1] == _SPACE
        starts = texts[:-1].copy()
        starts[at[~after_space | (data[at - 1] != 32)]] = True
        # of white space before a word the last character stands apart; a plain space there belongs to the word
        last = at[after_space] - 1
        while (inner := (data[last] & 0xC0) == 0x80).any():
            last[inner] -= 1
        starts[last] = True
        quote = np.flatnonzero((data == 39) & starts)
        for suffix in _CONTRACTIONS:
            n = len(suffix)
            cut = quote[quote + n < len(data)] if len(quote) else quote
            for k, letter in enumerate(suffix, 1):
                cut = cut[(data[cut + k] == letter) & ~texts[cut + k]]
            starts[cut + 1] = False
            cut = cut[cut + n + 1 < len(data)]
            starts[cut + n + 1] = True
        starts[inside] = False
        return np.flatnonzero(starts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column as one array, and the n + 1 offsets of the texts in it; null is empty."""
        data, offsets = words.text_buffer(texts)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = self._cut(data, offsets)
        kind, width = (pa.binary(), np.int32) if len(data) < 1 << 31 else (pa.large_binary(), np.int64)
        edges = np.append(starts, len(data)).astype(width)
        coded = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        held = self._known(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        start = np.cumsum(size) - size
        sizes = size[code]
        ends = np.cumsum(sizes)
        blob = np.frombuffer(b"".join(held), "<u4")
        narrow = np.int32 if max(len(blob), int(ends[-1])) < 1 << 31 else np.int64
        at = np.repeat((start[code] - ends + sizes).astype(narrow), sizes)
        at += np.arange(len(at), dtype=narrow)
        return blob[at], np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decimal(self, ids: list[int]) -> str:
        return ",".join(map(self._decimal.__getitem__, ids))


@lru_cache(maxsize=4)
def vocabulary(path: str, cache: int = CACHE) -> Vocabulary:
    """One per worker, file and cache size."""
    return Vocabulary(path, cache)


def slices(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Start and texts of slices of about `most` bytes."""
    for begin, end in words.pieces(column, most):
        yield begin, column.slice(begin, end - begin)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with a column of ids (array of int) instead of their texts; every other column passes through."""
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch.column(text)):
                flat, offsets = vocabulary(path).encode(texts)
                found = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), found], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The documents with the text of their ids; null ids give the empty text."""
    kept = [f for f in docs.schema.fields if f.name != ids]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vocabulary(path).decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens and the digests of its ids and of the text decoded from them.

    One pass: the ids of a batch are encoded, digested and decoded where they are made and never stored.
    """

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for begin, texts in slices(batch.column(text)):
                counts, listed, decoded = [], [], []
                flat, offsets = vocab.encode(texts)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    ids = flat[a:b].tolist()
                    counts.append(len(ids))
                    listed.append(hashlib.sha256(vocab.decimal(ids).encode()).hexdigest())
                    decoded.append(hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
                yield pa.record_batch([batch.column(doc_id).slice(begin, len(texts)), pa.array(counts, pa.int64()), pa.array(listed), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
