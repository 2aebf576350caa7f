"""Toxicity: a learned lexicon, matched with misspellings, weighed by context.

Terms, whole words and word stems, are those that set toxic training texts
apart. They form a trie. Its product with Levenshtein automata is determinised
while it is used: a state is the set of (trie node, edits so far), and each
step is remembered, so a word costs a look-up for each of its letters. Every hit
is weighed by the words around it, which tell abuse from quotation, and a
logistic model turns the sums into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm.common import in_batches, materialize, text_of

#: The model is fitted on at most so many labelled rows, those of the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
#: Lengths of word stems, the least training texts with a term, its least G-square, and the most terms.
STEMS, LEAST_TEXTS, LEAST_G, MOST_TERMS = (4, 5, 6, 7), 4, 16.0, 400
#: Words on each side of a hit that are its context.
WINDOW = 5

_WORD = re.compile(r"[^\W_]+")
#: Words that tell of what others say, in English, German, French and Spanish.
_REPORTING = frozenset("said says say called calls calling quote quotes quoted quoting wrote writes word words term slur insult allegedly reported sagte sagt nannte nennt zitat zitiert schrieb wort wörter beleidigung angeblich dit disait appelle appelait citation cite écrit mot mots insulte dijo dice llamó llama cita escribió palabra palabras insulto".split())
_QUOTES = frozenset("\"“”«»„‟‘’'`")
#: An apostrophe inside a word, which quotes nothing.
_INNER = re.compile(r"(?<=\w)['’`](?=\w)")


@dataclass(frozen=True)
class Term:
    """text: a word, or with stem the beginning of words; weight: log odds of a toxic text."""

    text: str
    stem: bool
    weight: float

    @property
    def edits(self) -> int:
        """Edits allowed: few letters leave no room for any."""
        return 0 if len(self.text) < (7 if self.stem else 5) else 1 if len(self.text) < 9 else 2


class FuzzyTrie:
    """find(word): (term, edits) with the fewest edits, then the largest weight, else None."""

    def __init__(self, terms: list[Term], words: int = 100_000, most_states: int = 50_000):
        self.terms, self.children, self.ends, self.room = terms, [{}], [[]], [0]
        for k, t in enumerate(terms):
            node = 0
            for i, c in enumerate(t.text):
                self.room[node] = max(self.room[node], t.edits)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.children[node][c]
            self.room[node] = max(self.room[node], t.edits)
            self.ends[node].append(k)
        self.words, self.known, self.most_states = words, {}, most_states
        self._begin()

    def _begin(self) -> None:
        """Without any states but the start; also when there are too many."""
        self.states: list[tuple[frozenset, tuple | None, tuple | None]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _better(self, a: tuple | None, b: tuple | None) -> tuple | None:
        if a is None or b is None:
            return a or b
        return min(a, b, key=lambda x: (x[1], -self.terms[x[0]].weight, x[0]))

    def _state(self, places: set[tuple[int, int]]) -> int:
        """Number of the state; a letter of the trie left out is an edit, too."""
        least: dict[int, int] = {}
        todo = sorted(places, key=lambda p: p[1])
        while todo:
            node, e = todo.pop()
            if e > self.room[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(least.items())
        if key not in self.numbers:
            whole = stem = None
            for node, e in least.items():
                for k in self.ends[node]:
                    if e <= self.terms[k].edits:
                        if self.terms[k].stem:
                            stem = self._better(stem, (k, e))
                        else:
                            whole = self._better(whole, (k, e))
            self.numbers[key] = len(self.states)
            self.states.append((key, whole, stem))
            self.steps.append({})
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        to = set()
        for node, e in self.states[state][0]:
            for letter, child in self.children[node].items():
                to.add((child, e + (letter != c)))
            to.add((node, e + 1))  # a letter too many
        self.steps[state][c] = self._state(to)
        return self.steps[state][c]

    def find(self, word: str) -> tuple | None:
        if word in self.known:
            return self.known[word]
        if len(self.states) > self.most_states:
            self._begin()
        state, found = self.start, None
        for c in word:
            n = self.steps[state].get(c)
            state = self._step(state, c) if n is None else n
            places, _, stem = self.states[state]
            if stem:
                found = self._better(found, stem)
            if not places:
                break
        else:
            found = self._better(found, self.states[state][1])
        if len(self.known) >= self.words:
            self.known.clear()
        self.known[word] = found
        return found


FEATURES = ("exact", "fuzzy", "quoted", "strongest", "density")


def features(text: str, trie: FuzzyTrie) -> list[float]:
    """Sums over the hits in a text. A hit between quotation marks or near a reporting word counts as quoted."""
    lower = text.lower()
    find, known = trie.find, trie.known
    hits = [(w, f) for w in set(_WORD.findall(lower)) if (f := known[w] if w in known else find(w))]
    if not hits:
        return [0.0] * len(FEATURES)
    found = dict(hits)
    places = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(lower)]
    exact = fuzzy = quoted = strongest = 0.0
    for i, (a, b, w) in enumerate(places):
        if w not in found:
            continue
        k, edits = found[w]
        weight = trie.terms[k].weight
        lo, hi = max(0, i - WINDOW), min(len(places), i + WINDOW + 1)
        around = _INNER.sub(" ", lower[places[lo][0] : places[hi - 1][1] + 1])  # of the same length
        marks = bool(_QUOTES.intersection(around[: a - places[lo][0]])) and bool(_QUOTES.intersection(around[b - places[lo][0] :]))
        reported = any(p[2] in _REPORTING for p in places[lo:hi])
        abuse = 0.3 if marks and reported else 0.6 if marks or reported else 1.0
        quoted += 1 - abuse
        if edits:
            fuzzy += abuse * weight / (1 + edits)
        else:
            exact += abuse * weight
            strongest = max(strongest, abuse * weight)
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), strongest, math.log1p(100 * (exact + fuzzy) / len(places))]


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and toxic of at most so many labelled documents that aren't held out. Of several labels the largest counts, of several texts under one doc_id the least."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def learn_terms(rows: DataFrame) -> list[Term]:
    """The words and stems that set toxic texts apart, by G-square; of related stems, and of related words, the best.

    A word stays beside its stem, which matches longer words but allows fewer edits, and doesn't count towards the most terms.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = F.flatten(F.transform(F.array(*[F.lit(n) for n in STEMS]), lambda n: F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.left(w, n), F.lit("*")))))
    terms = rows.select("toxic", F.explode(F.array_distinct(F.concat(words, stems))).alias("term"))
    total = rows.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") != 1).alias("n")).first()
    pos, neg = float(total["p"] or 0), float(total["n"] or 0)
    if not pos or not neg:
        return []
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda seen, all_: F.when(seen > 0, seen * F.log(seen / (all_ * (a + b) / (pos + neg)))).otherwise(0.0)
    g = 2 * (part(a, F.lit(pos)) + part(b, F.lit(neg)))
    weight = F.log((a + 0.5) / (pos + 1)) - F.log((b + 0.5) / (neg + 1))
    counts = terms.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") != 1).alias("b"))
    best = counts.filter(F.col("a") >= LEAST_TEXTS).select("term", g.alias("g"), weight.alias("weight")).filter((F.col("g") >= LEAST_G) & (F.col("weight") >= 2.0)).orderBy(F.desc("g"), F.desc(F.length("term")), "term").limit(20 * MOST_TERMS)
    kept: list[Term] = []
    groups = 0
    for row in best.collect():
        text, stem = row["term"].removesuffix("*"), row["term"].endswith("*")
        related = [t for t in kept if text.startswith(t.text) or t.text.startswith(text)]
        if len(text) < 3 or any(stem or not t.stem for t in related) or not related and groups == MOST_TERMS:
            continue
        kept.append(Term(text, stem, round(row["weight"], 6)))
        groups += not related
    return kept


def _featured(docs: DataFrame, terms: list[Term], keep: list[str]) -> DataFrame:
    """The columns to keep and the features of each row's text."""
    kinds = dict(docs.dtypes)
    given = docs.select(*keep, text_of().alias("text"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FuzzyTrie(terms)
        for batch in batches:
            found = [features(t, trie) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features"])

    return given.transform(in_batches).mapInArrow(over, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "features array<double>"]))


@dataclass(frozen=True)
class Model:
    terms: list[Term]
    coefficients: list[float]  # of the features; the intercept last


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Terms and a ridge-penalised logistic model of the features, by Newton's method. Without labels of both kinds every score is 0 or 1 by the share of toxic ones."""
    rows = materialize(training_rows(docs, labels, most), "training")
    terms = learn_terms(rows)
    data = _featured(rows, terms, ["toxic"]).collect()  # at most `most` rows of a few numbers
    x = np.array([[*r["features"], 1.0] for r in data]).reshape(len(data), len(FEATURES) + 1)
    y = np.array([float(r["toxic"] == 1) for r in data])
    ridge = np.diag([0.5] * len(FEATURES) + [0.01])
    beta = np.zeros(len(FEATURES) + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(terms, beta.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of documents(doc_id, text, ...). A null text is empty; repeated rows are scored each; a null doc_id isn't held out."""
    logit = sum((F.col("features")[i] * c for i, c in enumerate(model.coefficients[:-1])), F.lit(model.coefficients[-1]))
    p = F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    scored = _featured(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model.terms, ["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), p.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose text scores under 0.5, with all columns; a null text is scored as empty."""
    at, beta, terms = docs.columns.index("text"), np.array(model.coefficients), model.terms

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FuzzyTrie(terms)
        for batch in batches:
            clean = [float(np.dot([*features(t or "", trie), 1.0], beta)) < 0 for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.transform(in_batches).mapInArrow(over, docs.schema)
