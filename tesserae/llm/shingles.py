"""Hashes of word shingles, shared by the operators on near copies and fingerprints."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Memo, words, worker_holds

WIDTH = 5
REMEMBERED = 100_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (splitmix64's)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, repeats included; of all words where a text has fewer; none of no words."""
    found = words(text.encode())
    if not found:
        return np.empty(0, _U)
    hashes = worker_holds("hashes", None, lambda: Memo(xxhash.xxh64_intdigest, REMEMBERED))
    hashes.trim()
    h = np.fromiter(map(hashes.__getitem__, found), _U, len(found))
    if len(h) < width:
        h = np.concatenate([h, np.zeros(width - len(h), _U)])
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out = out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
    return mix(out)
