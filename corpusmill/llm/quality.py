"""Quality by random-indexing word vectors pooled per document and a two-layer network with calibrated probabilities.

Every token falls into one of ``BUCKETS`` buckets, each with a sparse random index vector. A bucket's word vector is the sum
of the index vectors of its neighbours in all documents, scaled to unit length. A document is the
mean of its tokens' vectors, rarer tokens weighing more, next to a few shares of token shapes. A network of two layers maps
that to a logit, trained on a bounded sample of labelled documents; a temperature fitted on a part of the sample kept aside calibrates the probability.

Edge cases: a null or empty text is a zero vector and scored as such. A row with a null doc_id is scored and isn't held out.
Repeated rows are scored alike; an empty table gives no rows; without labelled rows of both classes every score is the share
of the class seen, 0.5 without any. The columns named by the caller are carried through.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import partitions, text_slices
from .labelled import PER_CLASS, labelled_sample
from .words import SLICE_CHARS, finished, span_keys

BUCKETS, DIM, NONZERO, REACH, HIDDEN = 1 << 15, 64, 8, 2, 32
SHAPES = ("upper", "symbol", "repeat", "distinct", "length", "lines")


#: Signs of a bucket's index vector in its places.
SIGNS = np.tile([1.0, -1.0], NONZERO // 2)


def index_places(seed: int = 17) -> np.ndarray:
    """Of each bucket, the random places in which its sparse index vector isn't zero, as many +1 as -1."""
    rng = np.random.default_rng(seed)
    return rng.random((BUCKETS, DIM)).argpartition(NONZERO, axis=1)[:, :NONZERO]


@lru_cache(maxsize=1)
def _characters() -> dict[str, np.ndarray]:
    """Of each code point: its class (0 white space, 1 part of a word, 2 other), marks of case, and values to hash by."""
    every = [chr(k) for k in range(sys.maxunicode + 1)]
    mark = lambda f: np.fromiter(map(f, every), bool, len(every))
    letter, upper = mark(str.isalnum), mark(str.isupper)
    small = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every), np.int64, len(every))
    word = letter.copy()
    word[ord("_")] = True
    return {
        "class": np.where(mark(str.isspace), 0, np.where(word, 1, 2)).astype(np.int8),
        "symbol": ~letter,
        "upper": upper,
        "other_case": (mark(str.islower) | mark(str.istitle)) & ~upper,
        "value": finished(np.arange(1, len(every) + 1, dtype=np.uint64))[small],
    }


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each token, number of tokens of each text, shapes of each text). Tokens are runs of word characters and runs
    of others that aren't white space, whatever their case."""
    ends = np.cumsum([len(t) for t in texts])
    parts, start = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(SHAPES))))], 0
    while start < len(texts):  # as many texts at once as stay in a core's cache
        to = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_CHARS, "right")))
        parts.append(_tokens(texts[start:to]))
        start = to
    return tuple(np.concatenate(x) for x in zip(*parts))


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    about = _characters()
    joined = "\n".join([*texts, ""])
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kind = about["class"][code]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edges = np.concatenate([[0], edge, [len(code)]])
    full = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][full], edges[1:][full]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    n = np.diff(np.searchsorted(starts, bounds))
    of = np.repeat(np.arange(len(texts)), n)
    keys = span_keys(code, starts, ends, about["value"])
    at = keys & (BUCKETS - 1)
    inside = lambda c: (total := np.concatenate([[0], np.cumsum(about[c][code])]))[ends] - total[starts]
    upper = (ends - starts > 1) & (inside("upper") > 0) & (inside("other_case") == 0)
    symbol = ~upper & about["symbol"][code[starts]]
    repeat = np.zeros(len(at), bool)
    repeat[1:] = (at[1:] == at[:-1]) & (of[1:] == of[:-1])
    named = finished(keys.view(np.uint64) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(of[np.unique(named, return_index=True)[1]], minlength=len(texts))
    shapes = np.zeros((len(texts), len(SHAPES)))
    some = n > 0
    share = lambda marks: np.bincount(of, marks, len(texts))[some] / n[some]
    lines = np.array([t.count("\n") + 1 for t in texts])
    shapes[some] = np.stack([share(upper), share(symbol), share(repeat), distinct[some] / n[some], np.log1p(n[some]) / 10, lines[some] / n[some]], 1)
    return at, n, shapes


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    constant: float | None = None

    def pool(self, texts: list[str]) -> np.ndarray:
        """One row for each text: its mean word vector and its shapes."""
        at, n, shapes = tokens_of(texts)
        pooled = np.zeros((len(texts), DIM))
        for k, (first, last) in enumerate(zip(np.cumsum(n) - n, np.cumsum(n))):
            for a in range(first, last, 20_000):
                some = at[a : min(last, a + 20_000)]
                pooled[k] += self.weights[some] @ self.vectors[some]
            if last > first:
                pooled[k] /= self.weights[at[first:last]].sum()
        return np.concatenate([pooled, shapes], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def word_vectors(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(unit word vectors, token weights) by bucket, from all texts: sums of whole numbers, the same in any order."""

    def rows(sums: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(counts)
        for a in range(0, len(used), 4_000):
            some = used[a : a + 4_000]
            packed = pa.array([x.tobytes() for x in sums[some].astype("<i8" if np.abs(sums[some]).max(initial=0) >= 1 << 31 else "<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), packed], names=["bucket", "n", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = index_places()
        sums, counts = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64)  # whole numbers, which floats hold exactly
        for _, texts in text_slices(batches, text):
            at, n, _ = tokens_of(texts)
            of = np.repeat(np.arange(len(n)), n)
            counts += np.bincount(at, minlength=BUCKETS)
            for k in range(1, REACH + 1):
                beside = np.flatnonzero(of[k:] == of[:-k])
                for mine, other in ((at[beside], at[beside + k]), (at[beside + k], at[beside])):
                    for a in range(0, len(mine), 500_000):
                        spots = mine[a : a + 500_000, None] * DIM + places[other[a : a + 500_000]]
                        sums += np.bincount(spots.ravel(), np.broadcast_to(SIGNS, spots.shape).ravel(), BUCKETS * DIM)
        sums = sums.astype(np.int64).reshape(BUCKETS, DIM)
        yield from rows(sums, counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((BUCKETS, DIM), np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for b, n, x in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("sums").to_pylist()):
                counts[b] += n
                sums[b] += np.frombuffer(x, f"<i{len(x) // DIM}")
        yield from rows(sums, counts)

    kind = "bucket int, n long, sums binary"
    # BUCKETS rows at most come back
    table = docs.select(text).mapInArrow(run, kind).repartition(partitions(docs.sparkSession), "bucket").mapInArrow(add, kind).toArrow()
    vectors, counts = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for b, n, x in zip(*(table.column(c).to_pylist() for c in ("bucket", "n", "sums"))):
        counts[b], vectors[b] = n, np.frombuffer(x, f"<i{len(x) // DIM}")
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    share = counts / max(1, counts.sum())
    return vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def fit_network(x: np.ndarray, y: np.ndarray, share: np.ndarray, model: Model, epochs: int = 60, rate: float = 0.01, seed: int = 5) -> Model:
    """Two layers by Adam on four fifths of the rows, then the temperature on the others; ``share`` weighs the rows."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    train, aside = order[len(x) // 5 :], order[: len(x) // 5]
    model.mean, model.scale = x[train].mean(0), x[train].std(0) + 1e-6
    z = (x - model.mean) / model.scale
    layers = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    share = share / share[train].mean()
    decay = max(1e-4, 2 / len(train))
    for epoch in range(epochs):
        mixed = rng.permutation(train)
        for a in range(0, len(mixed), 256):
            at = mixed[a : a + 256]
            h = np.tanh(z[at] @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -30, 30)))
            d = share[at] * (p - y[at]) / len(at)
            dh = d[:, None] * layers[2] * (1 - h**2)
            grads = [z[at].T @ dh + decay * layers[0], dh.sum(0), h.T @ d + decay * layers[2], np.array([d.sum()])]
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                layers[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = layers
    if len(aside):
        logits = model.logits(x[aside])
        choices = np.geomspace(0.3, 10, 60)
        losses = [(share[aside] * np.logaddexp(0, np.where(y[aside] == 1, -logits, logits) / t)).mean() for t in choices]
        model.temperature = float(choices[int(np.argmin(losses))])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Word vectors of all documents, and network and temperature; ``per_class`` bounds the labelled rows of each class that
    these two are fitted on."""
    sample, stands_for = labelled_sample(docs, labels, label, per_class)
    model = Model(*word_vectors(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, texts in text_slices(batches, "text"):
            x = shared.value.pool(texts)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), cut.column("label")], names=["x", "label"])

    table = sample.mapInArrow(run, "x array<double>, label int").toArrow()  # the bounded sample's vectors
    y = table.column("label").to_numpy().astype(float)
    if len(np.unique(y)) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort(x.T)  # tasks return rows in any order
    return fit_network(x[order], y[order], np.array([stands_for[int(v)] for v in y[order]]), model)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` and the probability that a text's quality is 1, which replaces a kept column of its name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(c for c in dict.fromkeys(keep) if c != name)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, texts in text_slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in keep), pa.array(shared.value.score(shared.value.pool(texts)))], names=[*keep, name])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
