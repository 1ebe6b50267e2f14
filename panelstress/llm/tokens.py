"""Words of whole texts as numpy arrays over the UTF-8 bytes of an Arrow batch; no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is taken alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
SHINGLE_FACTORS = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64
)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser of a splitmix generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def unit(h: np.ndarray) -> np.ndarray:
    """Values in [0, 1) from the upper bits."""
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(array) + 1, offset=8 * array.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to ``size`` bytes, or of one document."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of every run of bytes that are no ASCII white space."""
    solid = ~_SPACE[raw]
    if not solid.any():
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True  # a document's first byte starts a word, whatever stands before it
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _POWERS[:] = [
            np.cumprod(np.where(np.arange(size) == 0, np.uint64(1), np.uint64(x)), dtype=np.uint64)
            for x in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _POWERS


def run_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes; equal bytes have equal hashes wherever they stand. Runs are in order."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + SLICE_BYTES, "right")))
        part = raw[base : end[j - 1]]
        power, inverse = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (total[e] - total[s]) * inverse[s]
        i = j
    return mix(out)


def shingles(doc: np.ndarray, word: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every run of ``size`` words; a shorter text is one shingle."""
    n = len(word)
    factors = SHINGLE_FACTORS[:size] if size <= 5 else mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    lengths = np.diff(np.append(first, n))
    rows, hashes = [], []
    if n >= size:
        h = np.zeros(n - size + 1, dtype=np.uint64)
        for j in range(size):
            h += word[j : n - size + 1 + j] * factors[j]
        whole = doc[: n - size + 1] == doc[size - 1 :]
        rows.append(doc[: n - size + 1][whole])
        hashes.append(h[whole])
    small = np.flatnonzero(lengths < size)
    if len(small):
        place = np.arange(n) - np.repeat(first, lengths)
        part = np.add.reduceat(word * factors[np.minimum(place, size - 1)], first)[small]
        rows.append(doc[first[small]])
        hashes.append(part + lengths[small].astype(np.uint64))
    return np.concatenate(rows), mix(np.concatenate(hashes))


def counted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, value) in order, with their numbers."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    if len(d) == 0:
        return d, v, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
    return d[new], v[new], np.diff(np.append(new, len(d)))
