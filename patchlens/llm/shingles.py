"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from patchlens.llm.hashing import mixed, piece_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, and each text's number of words."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    last = np.searchsorted(starts, np.cumsum(sizes))
    return piece_hashes(_LOWER[data], starts, ends), np.diff(np.concatenate([[0], last]))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `width` words, sorted; with fewer words, the whole sequence as one; without any, none."""
    words, counts = word_hashes([t or "" for t in texts])
    rows = max(0, len(words) - width + 1)
    sums = np.zeros(rows, np.uint64)
    for k in range(width):
        sums += words[k : k + rows] * np.uint64(2 * pow(0x9E3779B97F4A7C15, k + 1, 1 << 63) + 1)
    grams = mixed(sums)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(grams[at : at + n - width + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for w in words[at : at + n]:
                short = mixed(short * np.uint64(0x9E3779B97F4A7C15) + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
