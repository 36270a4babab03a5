"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens become symbols (insult, threat verb, target, negation, report, other) and five small transducers read each clause in
step: the insult transducer emits a term's learned weight, the target transducer raises it when someone is addressed nearby,
the negation transducer lowers what follows a negation, the reported-speech transducer lowers what a report introduces, and the
threat transducer emits when a threat verb meets a target. Their product is built lazily as one deterministic table. A
document's mass is the sum over its matched clauses and a logistic curve turns it into a score.

What insults weigh is learned: over a bounded sample of labelled rows (`TOXIC_ROWS` toxic and `CLEAN_ROWS` clean ones, by
hash), terms are counted by distinct contexts (the words before and after), so that copies and shared passages count once, and
a term or a stem that covers many words enters with the lower bound of its log-odds. A third of the sample is held back from
the lexicon and fits the curve. Neither labels nor lang, source or doc_id are inputs of a score.

Edge cases: null, empty and wordless texts have no matches and get the curve's base score; texts of any length are read whole;
labels with null marks are left out, repeated ones count by their maximum; repeated rows and equal texts score alike; without
labelled rows of both kinds every score is the base score 0; an empty table gives no rows; an added column whose name is taken
gets underscores before it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfold.llm import store

#: Labelled rows that the lexicon and the curve are fitted on, at most.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
#: Lower bounds of the log-odds from which a word or stem enters the lexicon, and the lengths of stems. The sample bounds the
#: lexicon: a word needs three contexts in its toxic rows, a stem four words.
WORD_BOUND, STEM_BOUND, STEMS = 1.0, 2.5, (3, 8)
THRESHOLD = 0.3

# fixed values: function words of the grammar in the corpus's languages
_TARGET = frozenset("you your youre u ur yourself du dich dir dein deine euch ihr sie tu toi te vous vos ton ta usted ustedes ti tus vosotros".split())
_NEGATION = frozenset("not no never isn't aren't wasn't don't doesn't didn't without nicht kein keine keinen nie ohne ne pas jamais aucun sans nunca jamás ni sin tampoco".split())
_REPORT = frozenset("said says wrote writes called calls quoted claimed reported according sagte sagt schrieb nannte laut zitiert dit écrit appelé selon cite dijo dice escribió llamó según citó".split())
_THREAT = frozenset("kill murder hurt stab shoot strangle destroy beat töten töte umbringen erschlagen vernichten tuer tuerai massacrer étrangler frapper matar mataré matarte matarlo destruir golpear".split())
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_THREAT_WEIGHT = 4.0

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+(?=\s|$)|\n")


@dataclass(frozen=True)
class Machine:
    """A transducer over symbols: step(state, symbol) gives the next state, the factor on an insult and what it emits itself."""

    start: int
    step: object


def _window(opens: int, length: int, factor: float) -> Machine:
    """For `length` tokens after the symbol `opens`, insults are multiplied by the factor."""

    def step(state: int, symbol: int) -> tuple[int, float, float]:
        inside = factor if state else 1.0
        return (length if symbol == opens else max(0, state - 1)), inside, 0.0

    return Machine(0, step)


def _report() -> Machine:
    """Behind a report the rest of the clause is somebody else's."""
    return Machine(0, lambda state, symbol: (1 if symbol == REPORT else state, 0.4 if state else 1.0, 0.0))


def _threat() -> Machine:
    """A threat verb and a target within four tokens, in either order; 0 nothing, 1-4 after a verb, 5-8 after a target."""

    def step(state: int, symbol: int) -> tuple[int, float, float]:
        verb, target = 1 <= state <= 4, state >= 5
        if (verb and symbol == TARGET) or (target and symbol == THREAT):
            return 0, 1.0, _THREAT_WEIGHT
        if symbol in (THREAT, TARGET):
            return (4 if symbol == THREAT else 8), 1.0, 0.0
        return (state - 1 if state not in (0, 1, 5) else 0), 1.0, 0.0

    return Machine(0, step)


def _insult() -> Machine:
    return Machine(0, lambda state, symbol: (0, 1.0 if symbol == INSULT else 0.0, 0.0))


@dataclass
class Grammar:
    """The composed transducer."""

    machines: tuple[Machine, ...] = field(default_factory=lambda: (_insult(), _window(TARGET, 4, 1.5), _window(NEGATION, 3, 0.2), _report(), _threat()))
    table: dict = field(default_factory=dict)

    def score(self, symbols: list[int], weights: list[float]) -> float:
        """Mass of a clause."""
        state, mass = tuple(m.start for m in self.machines), 0.0
        for symbol, weight in zip(symbols, weights, strict=True):
            move = self.table.get((state, symbol))
            if move is None:
                steps = [m.step(s, symbol) for m, s in zip(self.machines, state, strict=True)]
                move = self.table[state, symbol] = (tuple(s for s, _, _ in steps), math.prod(f for _, f, _ in steps), sum(e for _, _, e in steps))
            state, factor, emitted = move
            mass += weight * factor + emitted
        return mass


class Scorer:
    """Finds lexicon terms in a text and scores the clauses around them."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        import ahocorasick

        self.words, self.grammar = words, Grammar()
        self.stems = {n: {s: w for s, w in stems.items() if len(s) == n} for n in sorted({len(s) for s in stems})}
        self.any = ahocorasick.Automaton()
        for term in {*words, *stems, *_THREAT}:
            self.any.add_word(term, (len(term), term in stems))
        if len(self.any):
            self.any.make_automaton()

    def weight(self, token: str) -> float:
        found = self.words.get(token, 0.0)
        for n, own in self.stems.items():
            if len(token) > n and (w := own.get(token[:n])):
                found = max(found, w)
        return found

    def hits(self, low: str) -> list[int]:
        """Where terms begin that stand at the start of a word (and end with it, but for stems)."""
        out = []
        for end, (size, stem) in self.any.iter(low) if len(self.any) else ():
            at = end - size + 1
            if (not at or not low[at - 1].isalpha()) and (stem or end + 1 == len(low) or not low[end + 1].isalpha()):
                out.append(at)
        return out

    def mass(self, text: str | None) -> tuple[float, int]:
        """(summed mass, matched clauses) of a text."""
        low = (text or "").lower()
        hits = self.hits(low)
        if not hits:
            return 0.0, 0
        cuts = [m.end() for m in _CLAUSE.finditer(low)]
        clauses = sorted({int(i) for i in np.searchsorted(cuts, hits, "right")})
        total, matched = 0.0, 0
        for c in clauses:
            tokens = _TOKEN.findall(low, cuts[c - 1] if c else 0, cuts[c] if c < len(cuts) else len(low))
            symbols, weights = [], []
            for t in tokens:
                w = self.weight(t)
                weights.append(w)
                symbols.append(INSULT if w else THREAT if t in _THREAT else NEGATION if t in _NEGATION else TARGET if t in _TARGET else REPORT if t in _REPORT else OTHER)
            value = self.grammar.score(symbols, weights)
            total += value
            matched += value > 0
        return total, matched


@dataclass(frozen=True)
class Model:
    """A learned lexicon and curve."""

    words: dict[str, float]
    stems: dict[str, float]
    slope: float
    base: float

    def score(self, mass: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.zeros(len(mass))
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * np.log1p(mass), -30, 30)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _sample(docs: DataFrame, labels: DataFrame, text: str) -> DataFrame:
    """(text, toxic, fold) of the bounded sample; its identifiers are few enough to broadcast by their number."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    by = F.xxhash64("doc_id", F.lit(5))
    chosen = marks.filter("toxic = 1").orderBy(by).limit(TOXIC_ROWS).unionByName(marks.filter("toxic = 0").orderBy(by).limit(CLEAN_ROWS))
    chosen = chosen.select(F.col("doc_id").alias("of"), "toxic")
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)).alias("fold"))


@store.trimmed
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            tokens = ["", *_TOKEN.findall((text or "").lower()), ""]
            pairs = {(w, xxhash.xxh64_intdigest(f"{a} {b}") >> 1) for a, w, b in zip(tokens, tokens[1:], tokens[2:], strict=False)}
            if pairs:
                yield pa.record_batch([pa.array([toxic] * len(pairs), pa.int32()), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], names=["toxic", "word", "context"])


def _bound(a: F.Column, b: F.Column, all_a: int, all_b: int) -> F.Column:
    """Lower bound (two standard errors) of the log-odds of a in toxic against b in clean contexts."""
    odds = F.log((a + 0.5) / (all_a + 1)) - F.log((b + 0.5) / (all_b + 1))
    return odds - 2 * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def _stems(rows: list) -> dict[str, float]:
    """Of nested stems: the longest that keeps nearly all the support, and none below another that is kept."""
    support = {r["term"]: r["a"] for r in rows}
    longer: dict[str, int] = {}
    for s, a in support.items():
        longer[s[:-1]] = max(longer.get(s[:-1], 0), a)
    kept = {r["term"]: r["bound"] for r in rows if longer.get(r["term"], 0) < 0.95 * r["a"]}
    return {s: w for s, w in kept.items() if not any(s[:n] in kept for n in range(STEMS[0], len(s)))}


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    sample = store.materialize(_sample(docs, labels, text), "labelled")
    seen = sample.filter("fold > 0").select("toxic", "text").mapInArrow(_contexts, "toxic int, word string, context long").distinct()
    words = seen.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    words = store.materialize(words, "terms")
    all_a, all_b = (int(n or 0) for n in words.agg(F.sum("a"), F.sum("b")).first())
    if not all_a or not all_b:
        return Model({}, {}, 0.0, 0.0)
    bound = _bound(F.col("a"), F.col("b"), all_a, all_b)
    terms = words.withColumn("bound", bound).filter((F.col("a") >= 3) & (F.col("bound") >= WORD_BOUND)).collect()
    prefixes = words.select(F.explode(F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[1] - 1)), lambda n: F.when(F.length("word") > n, F.substring("word", F.lit(1), n)))).alias("term"), "a", "b").filter("term is not null")
    prefixes = prefixes.groupBy("term").agg(F.max("a").alias("top"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.when(F.col("a") > 0, 1)).alias("words"))
    prefixes = prefixes.withColumn("bound", bound).filter((F.col("words") >= 4) & (F.col("top") < 0.6 * F.col("a")) & (F.col("bound") >= STEM_BOUND))
    stems = _stems(prefixes.collect())
    lexicon = {r["word"]: r["bound"] for r in terms}

    @store.trimmed
    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, stems)
        for batch in batches:
            yield pa.record_batch([batch.column("toxic"), pa.array([scorer.mass(t)[0] for t in batch.column("text").to_pylist()])], names=["toxic", "mass"])

    rows = sample.filter("fold = 0").select("toxic", "text").mapInArrow(masses, "toxic int, mass double").collect()  # a third of the sample
    y, x = np.array([r["toxic"] for r in rows], float), np.log1p(np.array([r["mass"] for r in rows], float))
    return Model(lexicon, stems, *_logistic(x, y))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of a ridge logistic curve, by Newton's steps."""
    if not len(y):
        return 1.0, -2.0
    design, w = np.column_stack([x, np.ones(len(x))]), np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 0.05 * w
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def score(docs: DataFrame, model: Model, text: str = "text", added: tuple[str, str, str] = ("score", "predicted", "matched_clauses")) -> DataFrame:
    """The documents with score, predicted and matched_clauses, under the names `added`, with underscores before taken ones."""
    added = tuple(store.free_name(docs, name) for name in added)
    names = docs.columns

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.words, model.stems)
        for batch in batches:
            found = [scorer.mass(t.as_py()) for t in batch.column(names.index(text))]
            value = model.score(np.array([f[0] for f in found], float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32)), pa.array([f[1] for f in found], pa.int32())], names=[*names, *added])

    fields = [T.StructField(n, t) for n, t in zip(added, (T.DoubleType(), T.IntegerType(), T.IntegerType()), strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted and matched_clauses."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = fit(named, labels)
    return score(named, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "matched_clauses")
