"""Periodic runs of words by online dyadic square catching.

Words are appended, one or many at a time, and stand for their keys. Level k cuts the words so far into blocks of m = 2 ** k.
A completed block has a catcher for periods from 2 m - 1 to 4 m - 2: each appended word ends a suffix of m words, which is
compared with the two blocks whose catchers are alive at that distance. A suffix that equals its block is caught as (block,
period). Every square of a period in that range has a whole block in its first half, so its period is caught; what is caught
at neighbouring blocks with one period is one stretch of words that equal those a period later. Stretches of enough blocks are
compared word by word, are widened to both sides, and merge into runs, shorter periods first: a stretch that lies within a
known run has that run's period and is left out, so a run's period is its smallest.

Suffixes are compared by 64-bit hashes, each level's made of two of the level below, so an appended word costs two comparisons
and one hash a level. The documents of a slice of bounded size are appended one behind the other, each with a word of its own
behind it, so no stretch goes over a document's end.

Edge cases: a null text, an empty one and one of white space alone have no words. Repeated rows have equal results. A document
of any length is one task's, with less than 100 bytes of state a word. A null id has no planted repeats. An empty table gives no
rows. Columns of the documents besides the named ones are carried through; added columns replace columns of the same names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices
from .words import EXACT, finished, span_keys

#: Words and periods of a run, at least.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Bytes of text whose documents are appended to one catcher.
SLICE_CHARS = 1_000_000
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _doubled(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _LEFT + (right ^ (right >> np.uint64(31))) * _RIGHT
    return out ^ (out >> np.uint64(29))


@dataclass
class SquareCatcher:
    """Words so far; of each level, the hashes of its latest stretches, from a block's start on, which hold the live catchers'
    blocks; and what each level has caught: rows (period, first block, last block) of equal neighbours."""

    max_period: int
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    levels: list[tuple[int, np.ndarray]] = field(default_factory=list)
    caught: list[list[np.ndarray]] = field(default_factory=list)

    def append(self, words: np.ndarray) -> None:
        """Go on with these words' keys."""
        self.words = np.concatenate([self.words, words.view(np.uint64)])
        level, m = 0, 1
        while 2 * m - 1 <= self.max_period and len(self.words) > 2 * m - 1:
            if level == len(self.levels):
                self.levels.append((0, np.empty(0, np.uint64)))
                self.caught.append([])
            base, hashes = self.levels[level]
            done = base + len(hashes)
            if level == 0:
                new = self.words[done:]
            else:
                from_, below = self.levels[level - 1]
                new = _doubled(below[done - from_ : len(below) - m // 2], below[done - from_ + m // 2 :])
                self._forget(level - 1)
            self.levels[level] = (base, np.concatenate([hashes, new]))
            self._catch(level, done)
            level, m = level + 1, 2 * m
        if level:
            self._forget(level - 1)

    def _forget(self, level: int) -> None:
        """Blocks beyond the reach of words to come go."""
        base, hashes = self.levels[level]
        m = 1 << level
        gone = max(0, len(hashes) // m - 5) * m
        self.levels[level] = (base + gone, hashes[gone:].copy() if gone else hashes)

    def _catch(self, level: int, start: int) -> None:
        """Compare the suffixes that begin at ``start`` and later with the blocks whose catchers are alive."""
        m, (base, hashes) = 1 << level, self.levels[level]
        blocks, found, start = hashes[::m], [], start - base
        for nearest in (2 * m - 1, 3 * m - 1):  # block b meets the suffixes from b * m + nearest on, m of them
            first = max(0, (start - nearest) // m)
            n = min(len(blocks) - first, max(0, -(-(len(hashes) - nearest - first * m) // m)))
            if n <= 0:
                continue
            suffixes = hashes[first * m + nearest :][: n * m]
            whole = len(suffixes) // m
            hit = np.flatnonzero(suffixes[: whole * m].reshape(whole, m) == blocks[first : first + whole, None])
            if whole < n:
                hit = np.concatenate([hit, whole * m + np.flatnonzero(suffixes[whole * m :] == blocks[first + whole])])
            hit = hit[hit + first * m + nearest >= start]  # those before were compared as they came
            found.append(np.stack([hit % m + nearest, base // m + first + hit // m], 1))
        hits = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        if len(hits):
            self.caught[level].append(_neighbours(np.column_stack([hits, hits[:, 1]])))

    def runs(self, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> np.ndarray:
        """Rows (start, length, period) of the runs among the words so far, by start, then period."""
        runs = np.empty((0, 3), np.int64)
        for level, parts in enumerate(self.caught):
            if not parts:
                continue
            m = 1 << level
            stretches = parts[0] if len(parts) == 1 else _neighbours(np.concatenate(parts))
            period, first, last = stretches.T
            least = np.maximum(min_words - period, (min_periods - 1) * period)  # words that equal those a period later
            enough = (last - first + 1) * m >= least - 2 * (m - 1)
            stretches = stretches[enough & (period <= self.max_period)]
            for twice in (False, True):  # of one level's periods, only the largest is a multiple of another
                part = stretches[(stretches[:, 0] == 4 * m - 2) == twice]
                start, end = part[:, 1] * m, (part[:, 2] + 1) * m + part[:, 0]
                part = part[~_within(start, end, runs)]
                new = [r for p, a, b in part.tolist() if (r := self._widened(p, a * m, (b + 1) * m, m)) and r[1] >= max(min_words, min_periods * p)]
                if new:
                    new = np.array(new, np.int64)
                    runs = np.concatenate([runs, new[~_within(new[:, 0], new[:, 0] + new[:, 1], runs)]])
        return np.unique(runs[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]

    def _widened(self, period: int, start: int, end: int, most: int) -> tuple[int, int, int] | None:
        """The run of the words from start to end, each of which should equal that a period later; on both sides fewer than
        ``most`` words more do, as whole blocks would have been caught."""
        words, end = self.words, min(end, len(self.words) - period)
        if not np.array_equal(words[start:end], words[start + period : end + period]):
            return None  # hashes met by chance
        low = max(0, start - most)
        differ = np.flatnonzero(words[low:start] != words[low + period : start + period])
        start = low + int(differ[-1]) + 1 if len(differ) else low
        high = min(len(words) - period, end + most)
        differ = np.flatnonzero(words[end:high] != words[end + period : high + period])
        end = end + int(differ[0]) if len(differ) else high
        return start, end - start + period, period


def _neighbours(rows: np.ndarray) -> np.ndarray:
    """Rows (period, first block, last block), those of one period that follow each other as one."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] > rows[:-1, 2] + 1)
    at = np.flatnonzero(new)
    return np.column_stack([rows[at, :2], rows[np.append(at[1:], len(rows)) - 1, 2]])


def _within(starts: np.ndarray, ends: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether stretches lie within one of the runs."""
    if not len(runs) or not len(starts):
        return np.zeros(len(starts), bool)
    order = np.argsort(runs[:, 0])
    furthest = np.maximum.accumulate((runs[:, 0] + runs[:, 1])[order])
    at = np.searchsorted(runs[order, 0], starts, "right") - 1
    return (at >= 0) & (furthest[np.maximum(at, 0)] >= ends)


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which of a document's n words stands at each place, where a tenth of the documents has a repeated end."""
    places = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        places[a:] = a + (places[a:] - a) % p
    return places


def _keys(words: list[bytes]) -> np.ndarray:
    """A 64-bit key of each word."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    data = np.frombuffer(b"".join(words), np.uint8)
    return span_keys(data, np.concatenate([[0], ends[:-1]]), ends, EXACT) if len(words) else np.empty(0, np.int64)


def slice_runs(texts: list[list[bytes]], places: list[np.ndarray], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[np.ndarray]:
    """The runs of each of several documents' words."""
    sizes = np.array([len(p) for p in places], np.int64)
    if not len(sizes):
        return []
    offsets = np.cumsum(np.array([0, *map(len, texts)], np.int64))
    keys = _keys([w for words in texts for w in words])
    ends = finished(np.arange(1, len(sizes) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    catcher = SquareCatcher(int(sizes.max()) // min_periods)
    catcher.append(np.concatenate([x for at, p, end in zip(offsets, places, ends) for x in (keys[at + p], [end])]))
    runs = catcher.runs(min_words, min_periods)
    starts = np.cumsum(np.concatenate([[0], sizes + 1]))
    bounds = np.searchsorted(runs[:, 0], starts)
    return [runs[a:b] - [s, 0, 0] for a, b, s in zip(bounds, bounds[1:], starts)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: a run keeps its first period alone."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def strongest(runs: np.ndarray) -> list[int | None]:
    """(start, length, period) of the run with the greatest exponent, the first and then the shortest period at a tie."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:  # they come by start, then period
            best = [start, length, period]
    return best or [None, None, None]


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), plant: str | None = None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """The columns ``keep``, n_words, runs (an array of start, length, period), best (the one with the greatest exponent) and
    collapsed, the words that runs don't repeat, joined by spaces. ``plant`` names an id column by which a tenth of the documents
    gets a repeated end first."""
    added = T.StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, best struct<start: long, length: long, period: long>, collapsed string")
    keep = tuple(c for c in keep if c not in added.names)
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "__text", SLICE_CHARS):
            words = [t.encode().split() for t in texts]  # of bytes: only ASCII white space splits
            ids = batch.column("__plant").to_pylist() if plant else [None] * len(words)
            places = [planted(i, len(w)) if plant else np.arange(len(w)) for i, w in zip(ids, words)]
            runs = slice_runs(words, places, min_words, min_periods)
            collapsed = []
            for w, p, r in zip(words, places, runs):
                if len(r) or plant:
                    p = p[kept_words(len(p), r)] if len(r) else p
                    w = w if len(p) == len(w) and (not len(p) or p[-1] == len(p) - 1 and (np.diff(p) == 1).all()) else [w[k] for k in p.tolist()]
                collapsed.append(b" ".join(w).decode())
            as_runs = pa.array([[dict(zip(("start", "length", "period"), x)) for x in r.tolist()] for r in runs], pa.list_(run_type))
            best = pa.array([dict(zip(("start", "length", "period"), b)) if (b := strongest(r))[0] is not None else None for r in runs], run_type)
            columns = [pa.array([len(p) for p in places], pa.int64()), as_runs, best, pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *added.names])

    extra = [F.col(plant).alias("__plant")] if plant else []
    return docs.select(*keep, *extra, F.col(text).alias("__text")).mapInArrow(run, schema)
