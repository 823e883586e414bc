"""Benchmark decontamination: a broadcast set of benchmark windows is looked up in every document's windows of words.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. Words lower-case
A-Z and are runs of ASCII letters, digits and all characters beyond ASCII. Windows are found by a hash of word numbers,
each hit is verified on the words themselves, and every document word inside an occurrence is hit.

The set goes to the tasks in blocks of at most ``block_windows`` windows. A benchmark of one block takes one pass over the
documents; a larger one takes a pass for each block. Only the rows with hits leave those passes; they are put together by
row and joined to the documents once, so that what is broadcast stays bounded and no window is left out.

Edge cases: null and empty texts have no words, are never contaminated and match nothing; repeated documents and items are
kept row by row, items that share an id count once; empty tables give no rows or no hits. Columns besides the named ones
are carried through unread; results of removal keep all columns of the documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices, written

WIDTH = 13
BLOCK_WINDOWS = 500_000
#: Every ASCII byte that isn't part of a word becomes a space, A-Z become a-z.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct windows of the benchmark: window (its words, space-joined) and items (the sorted ids that hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, texts in text_slices(batches, "text"):
            for i, t in zip(cut.column("item").to_pylist(), texts):
                words = words_of(t)
                found = {b" ".join(words[k : k + width]).decode() for k in range(max(1, len(words) - width + 1))} if words else set()
                if found and i is not None:
                    yield pa.RecordBatch.from_pydict({"item": [i] * len(found), "window": list(found)}, schema=pa.schema([("item", pa.string()), ("window", pa.string())]))

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(run, "item string, window string")
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


class WindowSet:
    """A block of windows, arranged for lookup in runs of words."""

    def __init__(self, windows: dict[str, list[str]]):
        self.number: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], list[str]] = {}
        for window, items in windows.items():
            key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.encode().split())
            self.items[key] = items
        by_length = defaultdict(list)
        for key in self.items:
            by_length[len(key)].append(key)
        self.hashes = {n: np.unique(self._rolled(np.array(keys, np.uint64).reshape(-1), n)[::n]) for n, keys in by_length.items()}

    @staticmethod
    def _rolled(numbers: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(max(0, len(numbers) - n + 1), np.uint64)
        for k in range(n):
            out = out * _BASE + numbers[k : k + len(out)]
        return out

    def scan(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]] | None]:
        """For each text with a window in it: the number of the block's windows over each word, and the items."""
        lengths = np.array([len(t) for t in texts], np.int64)
        firsts = np.cumsum(lengths + 1) - lengths - 1
        # a zero between texts and for every word that no window has: no window spans one
        numbers = np.zeros(int(lengths.sum()) + len(texts), np.int64)
        get = self.number.get
        for first, words in zip(firsts, texts):
            numbers[first : first + len(words)] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        out: list[tuple[np.ndarray, set[str]] | None] = [None] * len(texts)
        for n, hashes in self.hashes.items():
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            rolled = np.zeros(len(at), np.uint64)
            for k in range(n):
                rolled = rolled * _BASE + numbers[at + k].astype(np.uint64)
            place = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for p in at[hashes[place] == rolled]:
                items = self.items.get(tuple(numbers[p : p + n].tolist()))
                if items is None:
                    continue  # another window's hash
                k = int(np.searchsorted(firsts, p, "right")) - 1
                if out[k] is None:
                    out[k] = (np.zeros(lengths[k] + 1, np.int64), set())
                cover, seen = out[k]
                cover[p - firsts[k]] += 1
                cover[p - firsts[k] + n] -= 1
                seen.update(items)
        return [None if x is None else (np.cumsum(x[0])[:-1], x[1]) for x in out]


def _spans(cover: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate([[0], (cover > 0).astype(np.int8), [0]]))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


HITS = "n_words long, n_hit long, items array<string>, spans array<struct<first: int, last: int>>"
_SPAN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _scan_block(docs: DataFrame, block: dict[str, list[str]], text: str, keep: list[str], hits_only: bool = False) -> DataFrame:
    """The columns ``keep`` and HITS of every row, or of those with hits."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(HITS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(shared.value)
        for cut, texts in text_slices(batches, text):
            words = [words_of(t) for t in texts]
            found = windows.scan(words)
            out = pa.RecordBatch.from_arrays(
                [
                    *(cut.column(c) for c in keep),
                    pa.array(map(len, words), pa.int64()),
                    pa.array([0 if x is None else int((x[0] > 0).sum()) for x in found], pa.int64()),
                    pa.array([[] if x is None else sorted(x[1]) for x in found], pa.list_(pa.string())),
                    pa.array([[] if x is None else _spans(x[0]) for x in found], _SPAN),
                ],
                names=[*keep, "n_words", "n_hit", "items", "spans"],
            )
            yield out.filter(pa.array([x is not None for x in found])) if hits_only else out

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """(__row, items, spans) of rows that several blocks hit: overlapping and adjoining spans become one."""
    rows = reduce(DataFrame.unionByName, parts).groupBy("__row").agg(F.flatten(F.collect_list("items")).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = F.aggregate(
        "spans",
        F.array().cast("array<struct<first: int, last: int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] + 1 >= s["first"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], s["last"]).alias("last")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return rows.select("__row", F.array_sort(F.array_distinct("items")).alias("items"), joined.alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns ``keep``, n_words, n_hit (words inside occurrences), items (sorted ids) and spans (word positions). Kept
    columns of these names give way to them."""
    found = written(benchmark_windows(benchmark, item, item_text, width), "benchmark-windows")
    keep = [c for c in dict.fromkeys(keep) if c not in ("n_words", "n_hit", "items", "spans")]
    if text not in keep and text in ("n_words", "n_hit", "items", "spans"):
        docs, text = docs.withColumnRenamed(text, "__text"), "__text"
    blocks = max(1, -(-found.count() // block_windows))
    if blocks == 1:
        return _scan_block(docs, {r.window: list(r["items"]) for r in found.toLocalIterator()}, text, keep)
    found = found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    marked = written(docs.select(*dict.fromkeys([*keep, text])).withColumn("__row", F.monotonically_increasing_id()), "decontamination")
    # a block at a time is read on the driver and sent; rows without hits don't leave their task
    parts = [
        _scan_block(marked, {r.window: list(r["items"]) for r in found.filter(F.col("block") == b).toLocalIterator()}, text, ["__row"], hits_only=True).select("__row", "items", "spans")
        for b in range(blocks)
    ]
    merged = _merged(parts)
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.regexp_count(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    rows = marked.select(*keep, n_words.alias("n_words"), "__row").join(merged, "__row", "left")
    empty = {"items": "array<string>", "spans": "array<struct<first: int, last: int>>"}
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in empty.items()})
    return rows.select(*keep, "n_words", n_hit.alias("n_hit"), "items", "spans")


def is_contaminated(n_hit: Column | str = "n_hit", n_words: Column | str = "n_words") -> Column:
    """At least a twentieth of the words are hit."""
    n_hit, n_words = (F.col(c) if isinstance(c, str) else c for c in (n_hit, n_words))
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def _with_hits(docs: DataFrame, benchmark: DataFrame, text: str, options: dict) -> tuple[DataFrame, dict[str, str]]:
    """The documents with their hits, each column under a name of its own, and those names' columns."""
    own = {f"__{k}": c for k, c in enumerate(docs.columns)}
    named = docs.withColumnsRenamed({c: k for k, c in own.items()})
    name = next(k for k, c in own.items() if c == text)
    return contamination(named, benchmark, name, keep=tuple(own), **options), own


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, but for the contaminated ones."""
    scored, own = _with_hits(docs, benchmark, text, options)
    return scored.filter(~is_contaminated()).select(*(F.col(k).alias(c) for k, c in own.items()))


def without_spans(text: str, spans: list[dict[str, int]]) -> str:
    """A text without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for s in spans:
        out.append(text[end : at[s["first"]][0]])
        end = at[s["last"]][1]
    return "".join([*out, text[end:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents and columns, the texts without the words inside occurrences of benchmark windows. A text that has none
    stays as it is, null too."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else without_spans(t, s) for t, s in zip(texts, spans)], dtype=object)

    scored, own = _with_hits(docs, benchmark, text, options)
    name = next(k for k, c in own.items() if c == text)
    shorter = cut(F.when(F.col("n_hit") > 0, F.col(name)), F.col("spans"))
    return scored.withColumn(name, F.coalesce(shorter, F.col(name))).select(*(F.col(k).alias(c) for k, c in own.items()))
