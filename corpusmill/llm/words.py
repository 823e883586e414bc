"""Hashes of all words of many texts at once, from the texts' bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are taken at once: so few that the arrays stay in a core's cache.
SLICE_CHARS = 200_000
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Its inverse modulo 2 ** 64.
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def finished(x: np.ndarray) -> np.ndarray:
    """Spread all bits of unsigned 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """The first powers of a base; those of slices of the usual size are kept."""
    if base in known and n <= len(known[base]):
        return known[base][:n]
    out = np.full(max(n, SLICE_CHARS), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    known.setdefault(base, out[:SLICE_CHARS])
    return out[:n]


#: A value for each byte; the same with A-Z as a-z; and which bytes part words.
EXACT = finished(np.arange(1, 257, dtype=np.uint64))
LOWER = EXACT[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, bounds of the texts among them); a null text has none."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each span of bytes: a polynomial in a constant over the bytes' values, taken from running sums over all
    bytes, and finished so that all its bits count."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _powers(_MULTIPLIER, len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64)
    return finished(raw).view(np.int64)


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit key of each word, number of words of each text): words are what stands between ASCII white space, with A-Z
    lower-cased; a null text has none."""
    data, bounds = text_bytes(texts)
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    ends = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    return span_keys(data, starts, ends, LOWER), np.diff(np.searchsorted(starts, bounds))


def key_of(word: bytes) -> int:
    """The key of one lower-cased word."""
    data = np.frombuffer(word, np.uint8)
    return int(span_keys(data, np.array([0]), np.array([len(data)]), LOWER)[0])
