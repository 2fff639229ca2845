"""Hashes of word shingles and the SimHash fingerprint of a list of hashes."""

from __future__ import annotations

import numpy as np

BITS, SEED, SLICE = 64, 42, 1 << 16


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle in order, repeats included; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    parts = (text or "").encode().lower().split()  # of bytes: A-Z only, and exactly the six ASCII blanks
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n, digest = b" ".join(parts), max(1, len(parts) - words + 1), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(words, len(parts)) - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(found: np.ndarray) -> np.uint64:
    """A bit is 1 if it is set in over half of the hashes; zero without any."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(found), SLICE):
        planes = np.unpackbits(found[k : k + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(planes), 255):  # sums of so many bits fit a byte
            total += planes[j : j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(found), bitorder="little").view(np.uint64)[0]
