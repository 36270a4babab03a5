"""Periodic runs of words by seeds on diagonals.

A run is a stretch of words with smallest period q and a length of at least max(24, 3 q) that neither neighbour extends. On the
diagonal of lag q its words match over at least max(16, 2 q) places, so it holds equal k-grams q words apart for k = 16 where
q <= 16, and for k = 16 * 2^j where k / 2 < q <= k: the guaranteed overlap. As k >= q and q is the smallest period, nothing
nearer than q words repeats such a k-gram inside the run, so only neighbouring occurrences have to be paired and a document of n
words gives at most n pairs a scale. Seeds of a lag are taken in order; a table holds the furthest word that an extension along
that lag has covered, and seeds before it are passed over. A seed that is left is extended word by word, in growing blocks, in
both directions, which gives the whole run.

k-grams are named exactly: the name of 2k words is that of a pair of names of k words, kept only where both repeat, so nothing
depends on hashes, and ordinary text has no names left after a few doublings.

Edge cases: null, empty and wordless texts have no words and no runs; a text of any length is read whole, in memory
proportional to it; rows are independent, so repeated rows and repeated or null doc_ids give a row each; an empty table gives
no rows; columns other than the identifier and the text don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyfold.llm import store

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The overlap that a run of the smallest scale guarantees: of 24 words at period 8 sixteen match, at period 9 eighteen of 27.
SEED = 16


def _names(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs again, in order of key and place, and dense names of those keys."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    repeats = np.zeros(len(keys), bool)
    repeats[1:] |= same
    repeats[:-1] |= same
    fresh = np.ones(len(keys), np.int64)
    fresh[1:] = ~same
    return at[order][repeats], (np.cumsum(fresh) - 1)[repeats]


def _scales(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, names) for k = 16, 32, ...: where k-grams that occur again start, ordered by name and place."""
    n = len(numbers)
    at, names = _names(numbers, np.arange(n))
    k = 1
    while len(at):
        if k >= SEED:
            yield k, at, names
        if 2 * k > n:
            return
        name = np.full(n, -1, np.int64)
        name[at] = names
        left = np.flatnonzero(name[: n - k] >= 0)
        left = left[name[left + k] >= 0]
        at, names = _names(name[left] * (int(names[-1]) + 1) + name[left + k], left)
        k *= 2


def _reach(numbers: np.ndarray, a: int, b: int, step: int, most: int) -> int:
    """How many of `most` words equal each other from a and b on, in the direction of `step`."""
    done, block = 0, 64
    while done < most:
        size = min(block, most - done)
        if step > 0:
            differ = numbers[a + done : a + done + size] != numbers[b + done : b + done + size]
        else:
            differ = (numbers[a - done - size + 1 : a - done + 1] != numbers[b - done - size + 1 : b - done + 1])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done += size
        block *= 2
    return done


def find_runs(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; numbers stand for words."""
    n, out = len(numbers), []
    if n < LEAST_WORDS:
        return out
    covered: dict[int, int] = {}
    for k, at, names in _scales(numbers):
        lags = at[1:] - at[:-1]
        seeds = (names[1:] == names[:-1]) & (lags <= k) & (lags > (k // 2 if k > SEED else 0))
        first, lags = at[:-1][seeds], lags[seeds]
        order = np.lexsort((first, lags))
        first, lags = first[order], lags[order]
        bounds = [0, *(np.flatnonzero(np.diff(lags)) + 1).tolist(), len(lags)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if lo == hi:
                continue
            own, lag = first[lo:hi], int(lags[lo])
            i = 0
            while i < len(own):
                s = int(own[i])
                if s < covered.get(lag, 0):
                    i = int(np.searchsorted(own, covered[lag]))
                    continue
                begin = s - _reach(numbers, s - 1, s + lag - 1, -1, s)
                end = s + _reach(numbers, s, s + lag, 1, n - lag - s)
                covered[lag] = end
                if end - begin + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                    out.append((begin, end - begin + lag, lag))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def imposed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: a tenth of the documents, by crc32 of doc_id, repeat a stretch of theirs to the end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def _describe(words: list[bytes]) -> tuple:
    number: dict[bytes, int] = {}
    # few words are distinct, so a loop over a dictionary numbers them faster than a sort of the strings
    numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) if len(words) >= LEAST_WORDS else np.zeros(0, np.int64)
    runs = find_runs(numbers)
    kept = words
    if runs:
        stay = collapsed(len(words), runs)
        kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
    best = (None, None, None)
    for run in runs:  # exact comparison of length / period; the order settles ties
        if best[0] is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return len(runs), *best, milli, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def describe_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli), runs_sha256 and
    collapsed_sha256; `change` may replace a document's words first."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kind = docs.schema[doc_id].dataType.simpleString()

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(doc_id).to_pylist(), []
            for row, i in enumerate(ids):
                words = (batch.column(text)[row].as_py() or "").encode().split()
                out.append(_describe(change(i, words) if change else words))
            columns = list(zip(*out, strict=True)) or [()] * 7
            numbers = [pa.array(c, pa.int64()) for c in columns[:5]]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), *numbers, *(pa.array(c, pa.string()) for c in columns[5:])], names=names)

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every run cut to its first period, words joined by one space; texts without runs stay as they are."""
    names, schema = docs.columns, docs.schema

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(names.index(text)).to_pylist():
                words = (t or "").encode().split()
                number: dict[bytes, int] = {}
                runs = find_runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
                stay = collapsed(len(words), runs).tolist()
                out.append(b" ".join(w for w, s in zip(words, stay, strict=True) if s).decode() if runs else t)
            columns = [pa.array(out, pa.string()) if k == names.index(text) else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
