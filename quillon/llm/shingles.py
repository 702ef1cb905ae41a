"""Hashes of word shingles, and of numbers."""

from __future__ import annotations

import numpy as np

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose every bit depends on all (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``size`` words; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)
