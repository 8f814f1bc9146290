"""Whole-batch text primitives on Arrow string buffers.

An Arrow string column is one byte buffer plus row offsets, so word boundaries, word hashes and
rolling substring hashes of a whole batch are a handful of NumPy passes with no per-row Python.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; a null text is an empty text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, dtype=bool)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: Tables of powers grow by so many entries.
STEP = 1 << 17


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.drop()

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // STEP) * STEP
            self.up, self.down = self._table(self.base, size), self._table(self.inverse, size)
        return self.up[:n], self.down[:n]

    def drop(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        return out


_BYTES = Powers(int(BASE))
_WORDS = Powers(0xD6E8FEB86659FD93)


def give_back() -> None:
    """Return what this process holds free, or can make again. Workers are shared by all stages of an application; Arrow's pool and the C library
    keep freed memory for themselves, so a stage should leave nothing behind for the next one to carry."""
    _BYTES.drop()
    _WORDS.drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def leaves_nothing(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step of a task, with all that it held given back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows back to back, and row offsets (one more than rows)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def slices(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy row ranges of a batch whose texts hold about ``limit`` bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each row's first word (one more than rows).

    ``outside`` tells for each of the 256 byte values whether it separates words."""
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, one more than values."""
    up, _ = powers.to(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix(data.astype(np.uint64) + np.uint64(1), _BYTES)
    _, down = _BYTES.to(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts], 0x51)


def byte_windows(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of data[i:i+width] for every i that has width bytes."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(data.astype(np.uint64) + np.uint64(1), _BYTES)
    _, down = _BYTES.to(len(data) + 1)
    return mix((sums[width:] - sums[:n]) * down[:n], 0xB7)


def word_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of width consecutive word hashes at every start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix(hashes, _WORDS)
    _, down = _WORDS.to(len(hashes) + 1)
    return mix((sums[width:] - sums[:n]) * down[:n], 0x63)


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one blank after each, and where each starts and ends in there."""
    sizes = ends - starts
    after = np.cumsum(sizes + 1)
    out = np.full(int(after[-1]) if len(after) else 0, 0x20, dtype=np.uint8)
    out[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = data[~SPACE[data]]
    return out.tobytes(), after - sizes - 1, after - 1


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of the given byte ranges, 128 bits in two halves: strings with equal digests are equal for all that is known of BLAKE2b."""
    made = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    halves = np.frombuffer(made, dtype="<u8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    step = np.diff(covered.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the ranges [start, end)."""
    step = np.bincount(starts, minlength=n + 1).astype(np.int64) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the minimum of values[i:i+width], for every full window."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        at = np.where(take, at[step:], at[: len(at) - step])
        best = np.where(take, right, left)
        have += step
    return at


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array holds."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def spread(keys: np.ndarray, *, second: np.ndarray | None = None, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What one slice already knows of repeated keys: which rows are not the first of their key in the slice (by ``order``, if
    given), which keys occur more than once in it, and the keys with those of the first kind replaced by numbers of their own.

    Rows after the first need no shuffle to be known as repeated, so a key that a third of all rows hold is sent once a slice.
    With ``second``, the other half of the keys, rows count as equal only where they stand side by side; others just stay as they are."""
    at = np.argsort(keys, kind="stable") if order is None else np.lexsort((order, keys))
    head = np.ones(len(keys), dtype=bool)
    head[1:] = keys[at[1:]] != keys[at[:-1]]
    if second is not None:
        head[1:] |= second[at[1:]] != second[at[:-1]]
    later, several = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[at] = ~head
    several[at[:-1]] |= ~head[1:]
    several |= later
    return later, several, np.where(later, mix(keys + np.arange(len(keys), dtype=np.uint64), 0x5A), keys)


def pieces(data: np.ndarray, outside: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """One text in ranges of about ``limit`` bytes that end at a separator, so no word is cut; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + limit
        if end < len(data):
            breaks = np.flatnonzero(outside[data[at:end]])
            if len(breaks):
                end = at + int(breaks[-1]) + 1
            else:
                while end < len(data) and not outside[data[end]]:
                    near = np.flatnonzero(outside[data[end : end + limit]])
                    end = end + int(near[0]) if len(near) else min(end + limit, len(data))
        yield data[at:end]
        at = end
