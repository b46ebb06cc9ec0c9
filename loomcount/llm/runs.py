"""Runs of signs (words, terms) of a batch of texts, with NumPy over the UTF-8 bytes: exact strings, no hashes."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 22  # bytes handled at once; a longer text makes a chunk of its own


def signs(*ranges: tuple[int, int], other: bool) -> np.ndarray:
    """Whether each byte belongs to a run: bytes of the ranges (both ends inclusive) if not `other`, else all but them."""
    out = np.full(256, other)
    for a, z in ranges:
        out[a : z + 1] = not other
    return out


#: Everything but space and the characters 09-0D.
WORD = signs((0x20, 0x20), (0x09, 0x0D), other=True)
#: ASCII letters and digits, and all bytes beyond ASCII.
TERM = signs((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F), other=True)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def chunks(offsets: np.ndarray):
    """Ranges of texts whose bytes come to CHUNK at most, or single longer ones."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield first, last
        first = last


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: bool = False):
    """The maximal runs of bytes `inside` of the texts data[offsets[i]:offsets[i + 1]]: an Arrow dictionary array of them in order, and the text number of each.
    fold: A-Z become a-z."""
    import pyarrow as pa

    n = len(data)
    held = inside[data]
    if not held.any():
        return pa.array([], pa.large_binary()).dictionary_encode(), np.zeros(0, np.int64)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(held[1:], held[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, lengths = at[:-1], np.diff(at)
    full = held[starts]
    starts, lengths = starts[full], lengths[full]
    raw = np.ascontiguousarray(FOLD[data[held]] if fold else data[held])
    ends = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return found.dictionary_encode(), np.searchsorted(offsets, starts, side="right") - 1
