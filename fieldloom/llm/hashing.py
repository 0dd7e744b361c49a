"""Hashes of the words of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE, STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift, twice."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_one(x: int) -> int:
    """mix of one number, modulo 2**64."""
    x &= (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & ((1 << 64) - 1)
    return x ^ (x >> 31)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values from starts to ends: the difference of running sums of value times power, brought back to power zero by the base's inverse."""
    up, down = _powers(1 << int(len(values)).bit_length())
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)])])
    return mix((total[ends] - total[starts]) * down[starts])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, BASE)), np.cumprod(np.full(n, inverse))


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, a line end after each; first byte of each text and the end of all)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    return np.frombuffer(b"\n".join(raw) + b"\n" * bool(raw), np.uint8), np.concatenate([[0], ends]).astype(np.int64)


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 64-bit hash) of every word, in order; words are runs between ASCII white space. With lower, A-Z count as a-z."""
    data, edges = joined_bytes(texts)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return np.searchsorted(edges[1:], starts, side="right"), run_hashes(data, starts, ends)


def word_runs(doc: np.ndarray, word: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 64-bit hash) of every run of `size` words, in order, of n documents; a document of fewer words, but one at least, has one run: all of it."""
    if len(word) == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    counts = np.bincount(doc, minlength=n)
    rank = np.arange(len(word)) - (np.cumsum(counts) - counts)[doc]
    at = np.flatnonzero(rank + size <= np.maximum(counts[doc], size * (rank == 0)))
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        inside = rank[at] + j < counts[doc[at]]
        h = h * STEP + np.where(inside, word[np.minimum(at + j, len(word) - 1)], np.uint64(0))
    return doc[at].astype(np.int64), mix(h)
