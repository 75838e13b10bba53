"""Static binary-fuse filters over 64-bit keys: three cells a key, one byte a cell."""

from __future__ import annotations

import math

import numpy as np

SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _hashed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed) * SPREAD
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _cells(x: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three cells of each hash, in three segments that follow each other."""
    first = ((x >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((x >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (x & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _check(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """``(seed, segment length, segments, cells)`` of a filter that holds every key.

    A cell that one key alone touches is given up for that key, again and again, all such cells
    of a round at once; the cells are then filled in the opposite order.  The rare seed for
    which keys are left over is replaced.
    """
    keys = np.unique(keys)
    n = max(2, len(keys))
    segment = 1 << max(2, math.floor(math.log(n) / math.log(3.33) + 2.25))
    wanted = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(wanted / segment) - 2)
    for seed in range(1, 1000):
        x = _hashed(keys, seed)
        cells = _cells(x, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(cells.ravel(), minlength=size)
        held = np.zeros(size, dtype=np.int64)
        places = np.arange(len(keys))
        for row in cells:
            np.bitwise_xor.at(held, row, places)
        rounds, done = [], 0
        single = np.flatnonzero(count == 1)
        while len(single):
            key, at = np.unique(held[single], return_index=True)
            rounds.append((single[at], key))
            done += len(key)
            touched = cells[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            np.bitwise_xor.at(held, touched.ravel(), np.tile(key, 3))
            near = np.unique(touched)
            single = near[count[near] == 1]
        if done == len(keys):
            break
    else:
        raise RuntimeError("no seed found for the filter")
    value, check = np.zeros(size, dtype=np.uint8), _check(x)
    for own, key in reversed(rounds):
        a, b, c = cells[:, key]
        value[own] = check[key] ^ value[a] ^ value[b] ^ value[c]
    return seed, segment, segments, value.tobytes()


def contains(keys: np.ndarray, seed: int, segment: int, segments: int, cells: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 others."""
    x, value = _hashed(keys, seed), np.frombuffer(cells, dtype=np.uint8)
    a, b, c = _cells(x, segment, segments)
    return _check(x) == value[a] ^ value[b] ^ value[c]
