"""64-bit hashes of many pieces of one array at once."""

from __future__ import annotations

import hashlib

import numpy as np

#: Items hashed at once.
BLOCK = 1 << 19
#: An odd multiplier; its powers weigh the items of a piece.
BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, BASE, np.uint64)]))
_BACK = np.cumprod(np.concatenate([[np.uint64(1)], np.full(BLOCK, pow(BASE, -1, 1 << 64), np.uint64)]))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of `x`."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def piece_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each items[start:end]; pieces in order, items are small unsigned numbers.

    Running sums of item times BASE**place give a piece's polynomial from two
    of them, brought to place 0 by the inverse power.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + BLOCK, "right")))
        b = int(ends[j - 1])
        part = items[a:b]
        if b - a <= BLOCK:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mixed((sums[e] - sums[s]) * _BACK[s])
        else:  # one piece longer than a block
            out[i] = int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little")
        i = j
    return out
