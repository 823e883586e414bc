"""A bounded table of distinct text chunks and their token ids, from which whole texts are put together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import EXACT, span_keys

#: A longer chunk, in bytes, is encoded wherever it stands and not kept.
LONGEST = 256


def flat(encoded: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Id lists as all their ids after another and the lists' lengths."""
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    return np.fromiter(chain.from_iterable(encoded), np.int32, int(lengths.sum())), lengths


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of runs, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def chunk_bounds(bounds: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of chunks of each text) of texts that are cut at the given positions, each of which is left out
    of the chunks on both its sides. An empty text has no chunk."""
    first, last = bounds[:-1], bounds[1:]
    counts = np.diff(np.searchsorted(cuts, bounds)) + (last > first)
    heads = (np.cumsum(counts) - counts)[counts > 0]
    starts = np.empty(int(counts.sum()), np.int64)
    inner = np.ones(len(starts), bool)
    inner[heads] = False
    starts[heads], starts[inner] = first[counts > 0], cuts + 1
    ends = np.append(starts[1:] - 1, 0)
    ends[(np.cumsum(counts) - 1)[counts > 0]] = last[counts > 0]
    return starts, ends, counts


def strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Spans of bytes as strings."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[runs(starts, lengths)])])


class ChunkTable:
    """Encodes each distinct chunk once and joins the ids back by the chunks' positions.

    ``encode_many`` maps chunks, and whether each is a text's first, to their ids, one chunk's after another, and how many each
    has. The table finds chunks by 64-bit hashes and lengths. It holds at most about ``max_chunks`` chunks: when it is full it starts afresh, so that memory stays
    bounded and the ids stay the same.
    """

    def __init__(self, encode_many: Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray]], max_chunks: int = 200_000):
        self.encode_many, self.max_chunks = encode_many, max_chunks
        self._clear()

    def _clear(self) -> None:
        self.mask, self.table = -1, np.empty(0, np.int32)
        self.keys = np.empty(1 << 14, np.int64)
        self.sizes, self.starts, self.lengths = (np.empty(1 << 14, np.int64) for _ in range(3))
        self.ids = np.empty(1 << 16, np.int32)
        self.used = self.held = 0

    def _room(self, n: int) -> None:
        """Make the table large enough for ``n`` more chunks."""
        if 2 * (self.held + n) > len(self.table):
            self.mask = (1 << max(16, (4 * (self.held + n)).bit_length())) - 1
            self.table = np.full(self.mask + 1, -1, np.int32)
            self._enter(0)

    def _enter(self, first: int) -> None:
        """Enter the held chunks from ``first`` on into the table."""
        left, step = np.arange(first, self.held, dtype=np.int32), 0
        while len(left):
            at = (self.keys[left] + step) & self.mask
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            left, step = left[self.table[at] != left], step + 1

    def _place(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where chunks are held, -1 for those that aren't."""
        out = np.full(len(keys), -1, np.int64)
        left, step = np.arange(len(keys) if self.held else 0), 0
        while len(left):
            place = self.table[(keys[left] + step) & self.mask]
            some = place >= 0
            left, place = left[some], place[some]
            hit = (self.keys[place] == keys[left]) & (self.sizes[place] == sizes[left])
            out[left[hit]] = place[hit]
            left, step = left[~hit], step + 1
        return out

    def _add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, first = len(keys), self.held
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while first + n > len(self.keys):
            self.keys, self.sizes, self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.keys, self.sizes, self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        for held, new in ((self.keys, keys), (self.sizes, sizes), (self.starts, self.used + np.cumsum(lengths) - lengths), (self.lengths, lengths)):
            held[first : first + n] = new
        self.used, self.held = self.used + len(ids), first + n
        self._enter(first)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, first: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Of texts given by their chunks' places in ``data`` and how many each text has: all their ids after another, and the
        number of ids of each text. With ``first``, a text's first chunk is told apart from others of the same bytes."""
        sizes = ends - starts
        heads = np.zeros(len(starts), bool)
        if first:
            heads[(np.cumsum(counts) - counts)[counts > 0]] = True
        keys = span_keys(data, starts, ends, EXACT)
        keys[heads] = ~keys[heads]
        place = np.where(sizes <= LONGEST, self._place(keys, sizes), -2)
        missed = np.flatnonzero(place == -1)
        new, at = np.unique(keys[missed], return_index=True)
        if self.held and self.held + len(new) > self.max_chunks:
            self._clear()
            missed = np.flatnonzero(place != -2)
            new, at = np.unique(keys[missed], return_index=True)
        if len(missed):
            at = missed[at]
            self._room(len(new))
            self._add(new, sizes[at], *self.encode_many(strings(data, starts[at], sizes[at]), heads[at]))
            found = self._place(keys[missed], sizes[missed])
            place[missed] = np.where(found < 0, -2, found)  # a chunk whose hash another one has is encoded alone
        long = np.flatnonzero(place == -2)
        ids, begin, lengths = self.ids, self.starts[place], self.lengths[place]
        if len(long):
            more, lengths[long] = self.encode_many(strings(data, starts[long], sizes[long]), heads[long])
            begin[long] = len(ids) + np.cumsum(lengths[long]) - lengths[long]
            ids = np.concatenate([ids, more])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        return ids[runs(begin, lengths)], np.diff(bounds[np.concatenate([[0], np.cumsum(counts)])])
