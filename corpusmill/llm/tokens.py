"""Vectorised word tokens over Arrow string batches.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters
in the lower-cased text; everything else separates words.  In SQL terms the words
are the non-empty parts of ``lower(text)`` split at ``[^0-9a-z\\x{80}-\\x{10FFFF}]+``.

Words are represented by 64-bit hashes that depend on nothing but the word, so two
executors (or two attempts of one task) always agree.  A whole batch is hashed by a
handful of numpy passes over the UTF-8 bytes: no Python object is made per word.

Nulls and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, dtype=bool)
for _range in (range(48, 58), range(97, 123), range(128, 256)):
    _WORD[list(_range)] = True

_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

#: Bytes of text that are tokenized at a time; whole texts only, so one longer text is one piece.
PIECE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer that spreads a hash over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def combine(*parts: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of equally long arrays of hashes."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array, offsets from 0."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def runs(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes in the table ``inside``; no run crosses a text's end."""
    n = len(raw)
    mask = np.zeros(n + 2, dtype=np.int8)
    mask[1:-1] = inside[raw]
    step = np.diff(mask)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = np.unique(offsets[(offsets > 0) & (offsets < n)])
    cuts = cuts[(mask[cuts] == 1) & (mask[cuts + 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def hash_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, read eight bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    h = mix((eights[starts] & _KEEP[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at, left = 8, np.flatnonzero(lengths > 8)
    while len(left):
        h[left] = combine(h[left], eights[starts[left] + at] & _KEEP[np.minimum(lengths[left] - at, 8)])
        at += 8
        left = left[lengths[left] > at]
    return h


def pieces(strings: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE_BYTES each."""
    _, offsets = buffers(strings)
    a, n = 0, len(strings)
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + PIECE_BYTES, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of all words of these rows, bounds): row first+i has hashes[bounds[i]:bounds[i+1]]."""
    strings = as_strings(column)
    if lower:
        strings = pc.utf8_lower(strings)
    for a, b in pieces(strings):
        raw, offsets = buffers(strings.slice(a, b - a))
        starts, ends = runs(raw, offsets, _WORD)
        yield a, b, hash_runs(raw, starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def word_hash(word: str) -> int:
    """The hash of one word, as ``words`` gives it."""
    return int(next(iter(words(pa.array([word]))))[2][0])
