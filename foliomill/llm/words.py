"""Vectorised word hashes over the buffers of Arrow string columns.

Words are maximal runs of bytes other than space and \\t..\\r, the class `[^\\x20\\x09-\\x0D]+`; as those are ASCII,
working on UTF-8 bytes gives the same words as working on characters. A text is never turned into Python strings.

Words, and spans that do not overlap, are hashed as sums of their values times a multiplier of their own for every place in the word
or span (multilinear hashing modulo 2**64): no family of long words collides by construction, as such families do under powers of
one base. Short windows that slide over words have sums with powers of an odd base: their hash is a difference of two prefix
sums divided by a power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply), so that every bit depends on all bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xE9846AF9B1A615D)
    x = x ^ (x >> U(32))
    x = x * U(0xE9846AF9B1A615D)
    return x ^ (x >> U(28))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base & _MASK))
    if n:
        out[0] = U(1)
    return np.multiply.accumulate(out)


_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process up to the chunk size."""
    have = _CACHE.get(base)
    if have is None or len(have) < n:
        have = _powers(base, max(n, 1024))
        if n <= 2 * CHUNK_BYTES + 2:
            _CACHE[base] = have
    return have[:n]


_BASE_INV = pow(_BASE, -1, 1 << 64)
_WORD_INV = pow(_WORD_BASE, -1, 1 << 64)


def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `limit` bytes: index of the first text, their bytes, and where each text starts in them.

    A single text longer than the limit is a run of its own. Null texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and for each text the number of words before it (length: texts + 1)."""
    inside = ~_SPACE[data]
    edge = np.empty(len(data) + 1, dtype=np.int8)
    body = inside.view(np.int8)
    edge[1:-1] = body[1:] - body[:-1] if len(data) else 0
    edge[0] = body[0] if len(data) else 0
    edge[-1] = -body[-1] if len(data) else 0
    begin, end = edge == 1, edge == -1
    # two texts meet without white space between them: the word ends where the next text starts
    cut = np.unique(starts[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    glued = cut[inside[cut] & inside[cut - 1]]
    begin[glued] = True
    end[glued] = True
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; `lower` folds A-Z first."""
    out = np.empty(len(begin), dtype=U)
    at = 0
    while at < len(begin):  # a long text goes in blocks of whole words, so that memory stays bounded
        to = max(at + 1, int(np.searchsorted(end, begin[at] + CHUNK_BYTES, side="right")))
        low = begin[at]
        out[at:to] = _block_hashes(data[low : end[to - 1]], begin[at:to] - low, end[at:to] - low, lower)
        at = to
    return out


def _block_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    if lower:
        data = _LOWER[data]
    return _summed(_BYTE_VALUE[data], begin, end)


_PLACES = 1 << 12
_PLACE_VALUE = mix(np.arange(1, _PLACES + 1, dtype=U) * U(_WORD_BASE)) | U(1)


def _summed(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values [begin, end) of each of several spans that follow each other, the first from 0 on."""
    if not len(begin):
        return np.zeros(0, dtype=U)
    place = np.arange(len(values)) - np.repeat(begin, np.diff(np.append(begin, len(values))))
    if place.max(initial=0) < _PLACES:
        factor = _PLACE_VALUE[place]
    else:
        factor = mix((place + 1).astype(U) * U(_WORD_BASE)) | U(1)
    prefix = np.empty(len(values) + 1, dtype=U)
    prefix[0] = 0
    np.cumsum(values * factor, out=prefix[1:])
    return mix(prefix[end] - prefix[begin] + (end - begin).astype(U) * U(0xC2B2AE3D27D4EB4F))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive words (length: words - width + 1, or 0).

    Windows across two texts are among them; the caller leaves those out by position.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    prefix = np.empty(len(words) + 1, dtype=U)
    prefix[0] = 0
    np.cumsum(words * powers(_WORD_BASE, len(words)), out=prefix[1:])
    return mix((prefix[width:] - prefix[:-width]) * powers(_WORD_INV, n))


def span_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words [begin, end) of each span, of short ones that may overlap."""
    prefix = np.empty(len(words) + 1, dtype=U)
    prefix[0] = 0
    np.cumsum(words * powers(_WORD_BASE, len(words)), out=prefix[1:])
    h = (prefix[end] - prefix[begin]) * powers(_WORD_INV, len(words) + 1)[begin]
    return mix(h ^ mix((end - begin).astype(U)))


def starts_within(counts_before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts given by their word counts before them: the first word of each window inside one text, and its text."""
    n = np.diff(counts_before)
    windows = np.maximum(n - width + 1, 0)
    owner = np.repeat(np.arange(len(n)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    return counts_before[:-1][owner] + offset, owner


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each row's list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


BYTE_VALUE = _BYTE_VALUE


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the byte values times powers of a base, and the inverse powers: (p[j] - p[i]) * inverse[i] is the hash of [i, j)."""
    prefix = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_BYTE_VALUE[data] * powers(_BASE, len(data)), out=prefix[1:])
    return prefix, powers(_BASE_INV, len(data) + 1)
