"""Toxicity by Levenshtein automata over a lexicon trie, with context windows around each hit.

The lexicon is learned from a bounded sample of labelled documents: words, and word beginnings, whose documents are toxic
far more often than others; how many edits an entry allows depends on how common the words near to it are. Its trie is intersected with the Levenshtein automata of its entries: a state is the set of
(trie node, edits so far), determinised and remembered as words are read, so that a word is matched character by character
against all entries at once, misspelled or not. Each hit is scored in a window of words around it: hits in quotation marks or
near a reporting word count as quotation, hits near an address as abuse. A logistic regression weighs the counts; its
weights are pulled towards prior ones, so that kinds of hits that the sample lacks still count.

Edge cases: null and empty texts have no hits and get the base score. A row with a null doc_id is scored and isn't held out.
Repeated rows are scored alike; an empty table gives no rows; without any labelled row the lexicon is empty and the prior
weights hold. The columns named by the caller are carried through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices
from .labelled import PER_CLASS, labelled_sample

STRIP = ".,;:!?\"'()[]{}<>«»“”„‘’‹›…|-–—*#&%$/\\"
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says say saying quote quoted quotes wrote writes called calls word words term terms slur insult dit écrit mot mots terme sagte sagt schrieb wort worte begriff dijo dice escribió palabra palabras término".split())
ADDRESS = frozenset("you your you're youre u ur yourself tu toi vous ton votre du dich dein ihr euch sie tú usted ustedes eres vosotros".split())
WINDOW, BEGINNING, MIN_DOCS, MIN_ODDS, MAX_TERMS = 6, (4, 8), 3, 2.5, 2_000
#: A number of edits is no misspelling of an entry if a larger share of the texts that aren't toxic has such words.
MAX_CLEAN = 1e-4
#: A beginning that clean texts have too is an entry if toxic texts have it so many times far more often.
REPEATED = 3
#: A word's beginning is an entry if so many times more toxic texts have it than the commonest word that starts with it.
WIDER = 1.25
#: Counts in a document, and the weight each has before any label is seen. Misspelled hits have a share of the exact hits'
#: weight, and their own weight on top.
FEATURES = (("exact", 2.0), ("beginning", 2.0), ("one_edit", 0.0), ("two_edits", 0.0), ("quoted", -1.0), ("addressed", 0.5), ("words", 0.0), ("beginning_edit", 0.0))
SHARES, BEGINNING_SHARE = {2: 0.8, 3: 0.5}, 0.8
BASE, PULL = -3.0, 1.0


def words_of(text: str) -> list[str]:
    return [w.strip(STRIP) for w in text.lower().split()]


def edits_for(term: str, beginning: bool) -> int:
    """Edits within which a word still matches: none for short terms, of which everything is a misspelling."""
    if beginning:
        return 0 if len(term) < 7 else 1
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The determinised intersection of a trie with its entries' Levenshtein automata."""

    def __init__(self, terms: list[tuple[str, bool]], allowed: list[int] | None = None, max_states: int = 50_000):
        self.terms, self.max_states = terms, max_states
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most: list[int] = [0]  # edits that any entry below a node allows
        self.allowed = [edits_for(*t) for t in terms] if allowed is None else allowed
        for k, (term, _) in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], self.allowed[k])
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.ends.append([]), self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], self.allowed[k])
            self.ends[node].append(k)
        self._reset()

    def _reset(self) -> None:
        self.steps: list[dict[str, int]] = []
        self.sets: list[tuple[frozenset, tuple[int, int] | None]] = []
        self.found: list[tuple[int, int] | None] = []
        self.numbers: dict[tuple, int] = {}
        self.start = self._state({0: 0}, None)

    def _state(self, nodes: dict[int, int], held: tuple[int, int] | None) -> int:
        """The number of a state, closed under characters that the word lacks. held: (edits, entry) of a matched beginning."""
        queue = list(nodes.items())
        for node, e in queue:
            if e < self.most[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.most[child] and e + 1 < nodes.get(child, 99):
                        nodes[child] = e + 1
                        queue.append((child, e + 1))
        best = held
        for node, e in nodes.items():
            for k in self.ends[node]:
                if e <= self.allowed[k] and self.terms[k][1]:
                    held = min(held or (e, k), (e, k))
                if e <= self.allowed[k]:
                    best = min(best or (e, k), (e, k))
        key = (frozenset(nodes.items()), held)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key), self.steps.append({}), self.found.append(best)
        return self.numbers[key]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        pairs, held = self.sets[state]
        for node, e in pairs:
            if (child := self.children[node].get(c)) is not None and e <= self.most[child]:
                nodes[child] = min(e, nodes.get(child, 99))
            if e < self.most[node]:
                nodes[node] = min(e + 1, nodes.get(node, 99))
                for child in self.children[node].values():
                    if e + 1 <= self.most[child]:
                        nodes[child] = min(e + 1, nodes.get(child, 99))
        return self._state(nodes, held) if nodes or held else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry, or None."""
        if len(self.sets) > self.max_states:
            self._reset()
        state, steps = self.start, self.steps
        for c in word:
            to = steps[state].get(c)
            if to is None:
                to = steps[state][c] = self._step(state, c)
            if to < 0:
                return None
            state = to
        return self.found[state] if word else None


class Scorer:
    """Counts of a text's hits by kind and context, and their weighted score."""

    def __init__(self, terms: list[tuple[str, bool]], weights: np.ndarray | None = None, allowed: list[int] | None = None, max_words: int = 300_000):
        self.automaton, self.weights, self.max_words = LexiconAutomaton(terms, allowed), weights, max_words
        self.seen: set[str] = set()
        self.hits: dict[str, int] = {}

    def _look_up(self, words: set[str]) -> None:
        if len(self.seen) > self.max_words:
            self.seen.clear(), self.hits.clear()
        match, terms = self.automaton.match, self.automaton.terms
        for w in words - self.seen:
            if m := match(w):
                self.hits[w] = (7 if m[0] else 1) if terms[m[1]][1] else 0 if not m[0] else 2 if m[0] == 1 else 3
        self.seen |= words

    def features(self, text: str) -> list[float]:
        words = words_of(text)
        distinct = set(words)
        self._look_up(distinct)
        counts = [0.0] * len(FEATURES)
        if met := distinct & self.hits.keys():
            raw = text.split()
            for k, w in enumerate(words):
                if w not in met:
                    continue
                around = words[max(0, k - WINDOW) : k + WINDOW + 1]
                before, after = "".join(raw[max(0, k - WINDOW) : k]) + raw[k][:1], raw[k][-1:] + "".join(raw[k + 1 : k + WINDOW + 1])
                quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES) or not REPORTING.isdisjoint(around)
                counts[self.hits[w]] += 1
                counts[4] += quoted
                counts[5] += not quoted and not ADDRESS.isdisjoint(around)
        counts[6] = len(words) / 1000
        out = [math.log1p(c) for c in counts]
        out[0] += sum(share * out[k] for k, share in SHARES.items())
        out[1] += BEGINNING_SHARE * out[7]
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def learn_lexicon(sample: DataFrame, max_terms: int = MAX_TERMS) -> list[tuple[str, bool]]:
    """Entries (term, whether it is a word's beginning) from (text, label): those with the highest lower bounds of their log
    odds of standing in a toxic text, or for beginnings of standing there repeatedly if that is higher. Copies of a text count
    once. A beginning is an entry only if many words share it; of beginnings that start with each other, the stronger stays,
    and beside one too short for edits the strongest longer one."""
    sample = sample.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text")).select("text", "label")
    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter(), Counter()]
        often: list[Counter] = [Counter(), Counter()]

        def flush() -> pa.RecordBatch:
            rows = [(t, *((c, 0) if v else (0, c)), *((often[v][t], 0) if v else (0, often[v][t]))) for v in (0, 1) for t, c in held[v].items()]
            for c in (*held, *often):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 5, (pa.string(), *[pa.int64()] * 4))], names=["term", "toxic", "clean", "toxic_often", "clean_often"])

        for cut, texts in text_slices(batches, "text"):
            for t, v in zip(texts, cut.column("label").to_pylist()):
                words, beginnings = Counter(words_of(t)), Counter()
                for w, c in words.items():
                    for n in range(BEGINNING[0], min(BEGINNING[1], len(w) - 1) + 1):
                        beginnings[f"{w[:n]}*"] += c
                held[v].update(words.keys())
                held[v].update(beginnings.keys())
                often[v].update(b for b, c in beginnings.items() if c >= REPEATED)
            if len(held[0]) + len(held[1]) > 300_000:
                yield flush()
        yield flush()

    names = {"toxic": "a", "clean": "b", "toxic_often": "c", "clean_often": "d"}
    counts = sample.mapInArrow(run, "term string, toxic long, clean long, toxic_often long, clean_often long").groupBy("term").agg(*(F.sum(k).alias(v) for k, v in names.items()))

    def odds(toxic: str, clean: str) -> Column:
        a, b = F.col(toxic) + 0.5, F.col(clean) + 0.5
        bound = F.log(a / (totals.get(1, 0) - F.col(toxic) + 0.5)) - F.log(b / (totals.get(0, 0) - F.col(clean) + 0.5)) - 1.65 * F.sqrt(1 / a + 1 / b)
        return F.when(F.col(toxic) >= MIN_DOCS, bound)

    found = counts.withColumn("odds", F.greatest(odds("a", "b"), odds("c", "d"))).filter(F.col("odds") >= MIN_ODDS).orderBy(F.desc("odds"), F.length("term"), "term").limit(4 * max_terms)
    return choose_entries([(r.term, r.a) for r in found.collect()])[:max_terms]


def choose_entries(found: list[tuple[str, int]]) -> list[tuple[str, bool]]:
    """Of (term, toxic texts with it), strongest first, beginnings marked by a '*', those that stay."""
    commonest: dict[str, int] = {}
    for term, a in found:
        for n in range(BEGINNING[0], BEGINNING[1] + 1):
            if not term.endswith("*") and len(term) > n:
                commonest[term[:n]] = max(a, commonest.get(term[:n], 0))
    kept: dict[tuple[str, bool], None] = {}
    for marked, a in found:
        beginning, term = marked.endswith("*"), marked.rstrip("*")
        if not term or beginning and (a < WIDER * commonest.get(term, 0) or any(was and (t.startswith(term) or term.startswith(t) and edits_for(t, True) >= edits_for(term, True)) for t, was in kept)):
            continue
        kept[(term, beginning)] = None
    return list(kept)


def learn_edits(sample: DataFrame, terms: list[tuple[str, bool]]) -> list[int]:
    """The edits within which each entry matches: fewer than edits_for() where words so near to it are common in texts that
    aren't toxic, as some entries are near to ordinary words."""
    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    shared = sample.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, found = LexiconAutomaton(shared.value).match, Counter()
        for cut, texts in text_slices(batches, "text"):
            for t, v in zip(texts, cut.column("label").to_pylist()):
                hits = {m for m in map(match, set(words_of(t))) if m and m[0]}
                found.update((k, e, v) for e, k in hits)
        rows = [(*key, n) for key, n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 4)], names=["entry", "edits", "label", "n"])

    counts = sample.mapInArrow(run, "entry long, edits long, label long, n long").groupBy("entry", "edits", "label").agg(F.sum("n").alias("n"))
    share = {(r.entry, r.edits, r.label): r.n / totals[r.label] for r in counts.collect()}  # a few numbers for each entry
    out = []
    for k, term in enumerate(terms):
        clean = [e for e in range(1, edits_for(*term) + 1) if share.get((k, e, 0), 0) > max(MAX_CLEAN, share.get((k, e, 1), 0) / math.exp(MIN_ODDS))]
        out.append(min([e - 1 for e in clean], default=edits_for(*term)))
    return out


def fit_weights(features: np.ndarray, labels: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, pulled towards the prior ones; ``share`` weighs the rows."""
    prior = np.array([BASE, *(w for _, w in FEATURES)])
    x, w = np.concatenate([np.ones((len(features), 1)), features.reshape(len(features), len(FEATURES))], 1), prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(w)), x.T @ (share * (labels - p)) - PULL * (w - prior))
        w += step * min(1, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


Model = tuple[list[tuple[str, bool]], np.ndarray, list[int]]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Lexicon, weights and the entries' edits; ``per_class`` bounds the labelled rows of each class that they come from."""
    sample, stands_for = labelled_sample(docs, labels, label, per_class)
    terms = learn_lexicon(sample)
    allowed = learn_edits(sample, terms)
    shared = docs.sparkSession.sparkContext.broadcast((terms, None, allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for cut, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in texts], pa.list_(pa.float64())), cut.column("label")], names=["features", "label"])

    rows = sample.mapInArrow(run, "features array<double>, label int").collect()  # the bounded sample's few counts
    y = np.array([r.label for r in rows], float)
    x = np.array([r.features for r in rows], float).reshape(len(rows), len(FEATURES))
    return terms, fit_weights(x, y, np.array([stands_for.get(int(v), 1.0) for v in y])), allowed


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and the probability that a text is toxic, which replaces a kept column of its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(c for c in dict.fromkeys(keep) if c != name)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for cut, texts in text_slices(batches, text):
            scores = scorer.score(np.array([scorer.features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in keep), pa.array(scores)], names=[*keep, name])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, text, tuple(docs.columns), name).filter(F.col(name) < threshold).drop(name)
