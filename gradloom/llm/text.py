"""Whole Arrow batches of texts as bytes: word boundaries and word hashes without a loop over documents or words.

Words are runs of bytes other than space and 0x09-0x0D; UTF-8 never has these bytes inside a code point, so byte runs
and code point runs agree.  A word's hash is a sum of random 64-bit values of its bytes times powers of an odd base,
taken from prefix sums modulo 2**64 and then mixed; equal words have equal hashes in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SECTION = 1 << 18  # bytes hashed at once; the work arrays then fit in a core's cache
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled, step = 1, base & _M64
    while filled < n:  # doubles what is filled
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(step)
        filled, step = filled + more, step * step & _M64
    return out


_VALUES = np.random.default_rng(20_240_101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z
_VALUES_FOLDED = _VALUES[_FOLD]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_PW, _PW_INV = _powers(_BASE, _SECTION + 1), _powers(pow(_BASE, -1, 1 << 64), _SECTION + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 2 << 20):
    """(first, end) of runs of documents of ``limit`` bytes or so; a longer document is a run of its own."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of all words, in order; no word crosses documents."""
    n = len(data)
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    if n:
        edge = offsets[(offsets > 0) & (offsets < n)]
        first[1:] &= ~inside[:-1]
        first[edge] = inside[edge]
        last[:-1] &= ~inside[1:]
        last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), counts)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words; ``fold`` lower-cases A-Z."""
    values, out = _VALUES_FOLDED if fold else _VALUES, np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _SECTION, "right")))
        hi = ends[j - 1]
        pw, inv = (_PW, _PW_INV) if hi - lo <= _SECTION else (_powers(_BASE, hi - lo), np.ones(1, np.uint64))  # one word longer than a section
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * pw[: hi - lo], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * inv[s]
        i = j
    return mix(out)


def shingle_hashes(words: np.ndarray, document: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every k-word window in word order; a shorter document's words are one window."""
    counts = np.bincount(document, minlength=n_docs)
    first = np.cumsum(counts) - counts
    salts = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    n = max(0, len(words) - k + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc += words[j : j + n] * salts[j]
    whole = document[:n] == document[k - 1 : k - 1 + n]
    hashes, docs = mix(acc[whole]), document[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for m in range(1, k):  # by length; the length enters the hash
            pick = counts[short] == m
            acc = np.full(int(pick.sum()), m * _BASE & _M64, np.uint64)
            for j in range(m):
                acc += words[first[short[pick]] + j] * salts[j]
            extra[pick] = mix(mix(acc))
        hashes, docs = np.concatenate([hashes, extra]), np.concatenate([docs, short])
        order = np.argsort(docs, kind="stable")
        hashes, docs = hashes[order], docs[order]
    return hashes, docs
