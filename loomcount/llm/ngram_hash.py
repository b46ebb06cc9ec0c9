"""Hashes of words and word n-grams of a batch of texts, with NumPy over the UTF-8 bytes.

A word's hash is a polynomial of random byte values modulo 2^64, taken from running sums, so that the work is a few vector
operations per byte and no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 18  # bytes hashed at once, so that the vectors stay in the cache; a longer text makes a chunk of its own
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
#: 0 white space, 1 letters, digits and all bytes beyond ASCII, 2 the rest
KIND = np.full(256, 2, dtype=np.uint8)
KIND[0x80:] = 1
for _a, _z in ("az", "AZ", "09"):
    KIND[ord(_a) : ord(_z) + 1] = 1
KIND[SPACE] = 0
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n, CHUNK) + 1
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > CHUNK:
            return both[0], both[1]  # not kept
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(offsets: np.ndarray):
    """Ranges of texts whose bytes come to CHUNK at most, or single longer ones."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, fold: bool, by_kind: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of the texts data[offsets[i]:offsets[i + 1]]. fold: A-Z count as a-z. by_kind: a word
    also ends where letters and other signs meet; else only at white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = KIND[data] if by_kind else (~SPACE[data]).astype(np.uint8)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    full = kind[starts] > 0
    starts, ends = starts[full], ends[full]
    power, inverse = _power_tables(n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUE[FOLD[data] if fold else data] * power[:n], out=sums[1:])
    hashed = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashed, np.searchsorted(offsets, starts, side="right") - 1


def shingles(hashed: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words inside a text, and their text numbers."""
    if len(hashed) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = len(hashed) - size + 1
    inside = text[:k] == text[size - 1 :]
    out = np.zeros(k, dtype=np.uint64)
    for i in range(size):
        out += hashed[i : i + k] * PLACE[i]
    return mix(out[inside]), text[:k][inside]


def arrow_strings(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without nulls, copying nothing."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]
