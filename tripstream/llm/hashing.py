"""Word and shingle hashes of many texts at once, on numpy arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (splitmix64), salted."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 77)


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    gap = _SPACES[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = gap[:-1]
    starts = np.flatnonzero(edge[:-1] & ~gap)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    edge[:-1] = gap
    ends = np.flatnonzero(edge[1:] & ~gap) + 1
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    inside = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max()), 0xC6A4A7935BD1E995 | 1, np.uint64))
        value = _BYTE[_LOWER[raw[~gap]]] * power[inside]
        return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64) * _STEP, 1), starts


def shingles(texts: list[str], k: int, chunk: int = 1_000_000) -> Iterator[np.ndarray]:
    """For each text, in order, the sorted distinct 64-bit hashes of its k-word shingles.

    Words are lower-cased in A-Z only. With fewer than k words the whole sequence is one shingle; with none,
    there is none. Texts are hashed together, about `chunk` bytes at a time.
    """
    some, size = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        some.append(b)
        size += len(b) + 1
        if size >= chunk:
            yield from _chunk(some, k)
            some, size = [], 0
    if some:
        yield from _chunk(some, k)


def _chunk(some: list[bytes], k: int) -> Iterator[np.ndarray]:
    words, starts = _word_hashes(np.frombuffer(b"\n".join([*some, b""]), np.uint8))
    ends = np.cumsum([len(b) + 1 for b in some])
    cuts = np.concatenate(([0], np.searchsorted(starts, ends)))
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        rolled = words[:n].copy()
        for j in range(1, k):
            rolled = mix(rolled * _STEP + words[j : n + j], j + 1)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo >= k:
                yield np.unique(rolled[lo : hi - k + 1])
            elif hi > lo:
                one = words[lo : lo + 1].copy()
                for j in range(1, hi - lo):
                    one = mix(one * _STEP + words[lo + j], j + 1)
                yield mix(one, 99 + int(hi - lo))
            else:
                yield np.empty(0, np.uint64)
