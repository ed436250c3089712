"""Word and shingle hashes of whole Arrow text columns, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text that are hashed at a time; a longer text is a chunk of its own.
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE[65:91] = _TABLE[97:123]  # A-Z hash as a-z
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
_S = np.uint64(31)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    found = _POWERS.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        found[0] = 1
        found = np.cumprod(found)
        if n <= CHUNK + 1:
            _POWERS[base] = found
    return found[:n]


def mix(x: np.ndarray, by: np.uint64 = _M1) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _S)) * by
    return x ^ (x >> _S)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about CHUNK bytes; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin and end among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # words never cross texts
    starts = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | first[:-1]))
    ends = np.flatnonzero(solid & (np.r_[~solid[1:], True] | first[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_BASE, len(data)), out=sums[1:])
    words = (sums[ends] - sums[starts]) * _powers(_BASE_INV, len(data))[starts]
    return mix(words + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; with fewer words, one hash of all of them; without, none."""
    words, at = word_hashes(data, offsets)
    joined = words
    for j in range(1, k):
        joined = mix(joined[: len(words) - j] if j == 1 else joined[: max(0, len(words) - j)], _M2) * _M3 + words[j:]
    joined = mix(joined)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            h = words[a : a + 1]
            for j in range(a + 1, b):
                h = mix(h, _M2) * _M3 + words[j : j + 1]
            out.append(mix(mix(h) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
