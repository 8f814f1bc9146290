"""CRC-32 of many strings at once, and of joined strings from the CRCs of their parts.

A CRC is linear: what n more bytes do to it is a fixed map of its 32 bits, kept as four tables of 256 entries for every n below NEAR
and for every power of two. So the CRC of a run of words needs no second look at their bytes."""

from __future__ import annotations

import zlib

import numpy as np

#: Lengths with a table of their own.
NEAR = 64
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ np.where(out & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return out


BYTE = _byte_table()


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][crc >> 8 & 0xFF] ^ table[2][crc >> 16 & 0xFF] ^ table[3][crc >> 24]


def _length_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    near = np.empty((NEAR, 4, 256), dtype=np.uint32)
    near[0] = np.arange(256, dtype=np.uint32) << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
    for n in range(1, NEAR):
        near[n] = BYTE[near[n - 1] & 0xFF] ^ (near[n - 1] >> np.uint32(8))
    doubled = [near[1]]
    for _ in range(40):
        doubled.append(np.stack([_apply(doubled[-1], x) for x in doubled[-1]]))
    return near.reshape(NEAR * 4, 256), doubled


LENGTHS, POWERS = _length_tables()


def extended(crc: np.ndarray, more: np.ndarray) -> np.ndarray:
    """What crc becomes by ``more`` further bytes; xor with the CRC of those bytes gives the CRC of the whole."""
    near = np.minimum(more, NEAR - 1) * 4
    out = LENGTHS[near, crc & 0xFF] ^ LENGTHS[near + 1, crc >> 8 & 0xFF] ^ LENGTHS[near + 2, crc >> 16 & 0xFF] ^ LENGTHS[near + 3, crc >> 24]
    far = np.flatnonzero(more >= NEAR)
    if len(far):
        value, left = crc[far], more[far]
        for power, table in enumerate(POWERS):
            if not (left >> power).any():
                break
            odd = (left >> power & 1) > 0
            value[odd] = _apply(table, value[odd])
        out[far] = value
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for every word."""
    sizes = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(-np.minimum(sizes, NEAR).astype(np.int8), kind="stable")
    order = order[sizes[order] < NEAR]
    at, state = starts[order], np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    left = np.searchsorted(-sizes[order], -np.arange(NEAR), side="left")  # words longer than k bytes come first
    for k in range(NEAR):
        if not left[k]:
            break
        live = state[: left[k]]
        state[: left[k]] = BYTE[(live ^ data[at[: left[k]] + k]) & 0xFF] ^ (live >> np.uint32(8))
    out[order] = ~state
    for i in np.flatnonzero(sizes >= NEAR):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out
