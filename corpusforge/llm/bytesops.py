"""Vectorised word work on Arrow string batches, for tasks that run Python.

A batch is handled as one flat byte buffer with row offsets, so a word costs a
few numpy operations instead of a Python object. Callers walk a batch in
``pieces`` of bounded size, which bounds a task's memory whatever the batch.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa

#: `[^\x20\x09-\x0D]+` are words: these bytes separate them.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Letters, digits and every byte of a non-ASCII character; all else separates.
NOT_ALNUM = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PRIME = np.uint64(0x100000001B3)
_BASIS = np.uint64(0xCBF29CE484222325)
_LONG_WORD = 96  # bytes; longer words are hashed one by one


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``limit`` bytes, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; words never cross a row's end.

    ``offsets`` may be a slice of a batch's offsets; positions index ``raw``."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.concatenate(([False], ~separators[raw[lo:hi]], [False]))
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    cuts = np.unique(offsets[1:-1] - lo)  # a row that ends inside a run cuts it
    cuts = cuts[(cuts > 0) & (cuts < hi - lo)]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    if len(cuts):
        starts = np.sort(np.concatenate((starts, cuts)))
        ends = np.sort(np.concatenate((ends, cuts)))
    rows = np.searchsorted(offsets, starts + lo, side="right") - 1
    return starts + lo, ends + lo, rows


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased on request)."""
    sizes = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    order = np.argsort(-np.minimum(sizes, _LONG_WORD + 1).astype(np.int16), kind="stable")
    long = int(np.searchsorted(-sizes[order].clip(max=_LONG_WORD + 1), -_LONG_WORD, side="left"))
    for i in order[:long]:
        word = raw[starts[i] : ends[i]]
        word = LOWER[word] if lower else word
        out[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    order = order[long:]
    first, size = starts[order], sizes[order]
    h = np.full(len(order), _BASIS, dtype=np.uint64)
    counts = len(order) - np.cumsum(np.bincount(size, minlength=1))  # words longer than k bytes
    source = LOWER if lower else np.arange(256, dtype=np.uint8)
    for k in range(int(size[0]) if len(size) else 0):
        m = int(counts[k])
        h[:m] = (h[:m] ^ source[raw[first[:m] + k]].astype(np.uint64)) * _PRIME
    out[order] = mix64(h ^ (size.astype(np.uint64) << np.uint64(56)))
    return out


def row_slices(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets into a row-ordered element array: row r owns [o[r], o[r+1])."""
    return np.searchsorted(rows, np.arange(n_rows + 1), side="left")


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """A Python worker's prepared model. Workers are used again by later
    operators, so only the last model stays in memory."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Let the prepared model go, in an operator that needs none. What it and
    freed Arrow batches took goes back to the system, as Arrow's pool keeps it."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
