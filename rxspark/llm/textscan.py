"""Vectorised scanning of many texts at once: words, word hashes and word shingles as flat numpy arrays.

Words are ``[^\\x20\\x09-\\x0D]+``.  All separators are single bytes below 0x80, so UTF-8 bytes are scanned directly.
Hashes are 64 bits wide; two different words or shingles of one corpus share one with a probability near
n*n / 2**65.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, n, dtype=U) | U(1)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = _table(101, 256)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_BASE = int(_table(102, 1)[0])
_SHINGLE = _table(103, 64)


def _powers(n: int, known: list = [np.ones(1, U)]) -> np.ndarray:  # noqa: B006
    """1, B, B**2, ... modulo 2**64; kept and lengthened as longer words come."""
    while len(known[0]) < n:
        p = known[0]
        known[0] = np.concatenate([p, p * U(pow(_BASE, len(p), 2**64))])
    return known[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all output bits depend on all input bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


#: Separators for terms: all of ASCII but letters and digits.
_TERM = np.ones(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Separators for lines.
_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
SEPARATORS = {"words": _SPACE, "terms": _TERM, "lines": _LINE}


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of the texts in data, one more than texts
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    first: np.ndarray  # index of the first word of each text, one more than texts
    outside: np.ndarray  # the bytes that are separators


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, separators: str = "words") -> Words:
    data, offsets = text_bytes(column)
    n = len(data)
    inside = np.zeros(n + 1, bool)
    outside = SEPARATORS[separators][data]
    np.logical_not(outside, out=inside[:n])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), outside)


def word_hashes(w: Words, lower: bool = True) -> np.ndarray:
    """One 64-bit hash for each word; ``lower`` folds A-Z."""
    if not len(w.starts):
        return np.zeros(0, U)
    lead = w.starts[0]
    data = w.data[lead:]
    starts = w.starts - lead
    spans = np.diff(starts, append=len(data))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, spans)
    outside = w.outside[lead:]
    place[outside] = 0
    size = int((w.ends - w.starts).max())
    value = (_LOWER if lower else _BYTES)[data] * _powers(size)[place]
    value[outside] = 0
    return mix(np.add.reduceat(value, starts))


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by text) of the ``k``-word windows; a text with fewer words has one window of all its words,
    a text without words none."""
    counts = np.diff(first)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    out = np.zeros(offsets[-1], U)
    n = len(h)
    if n >= k:
        rolled = np.zeros(n - k + 1, U)
        for j in range(k):
            rolled += h[j : n - k + 1 + j] * _SHINGLE[j]
        long = np.flatnonzero(counts >= k)
        at = ranges(first[long], per[long])
        out[ranges(offsets[long], per[long])] = rolled[at]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = h[first[i] : first[i + 1]]
        out[offsets[i]] = np.add.reduce(np.append(own * _SHINGLE[: len(own)], _SHINGLE[k + 1 : k + 2] * U(len(own))))
    return mix(out), offsets


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift
