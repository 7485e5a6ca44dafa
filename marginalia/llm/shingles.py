"""Word shingles of whole texts as 64-bit hashes, in numpy over byte blocks."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
#: One random 64-bit value per byte.
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the end): words are runs of other bytes than ASCII white space, A-Z lower-cased."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    word = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | edge[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    powers = np.full(len(data), _P, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers, out=sums[1:])
    back = np.full(len(data), _P_INVERSE, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)), np.searchsorted(a, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Each row's distinct shingles of `words` words, sorted; fewer words are one shingle, no words are none."""
    h, first = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        runs = h.copy() if len(h) else h
        for k in range(1, words):
            runs = mix(runs[: len(h) - k] * np.uint64(0xD6E8FEB86659FD93) + h[k:]) if len(h) > k else h[:0]
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    value = mix(value * np.uint64(0xA0761D6478BD642F) + x)
            out.append(np.asarray([value], np.uint64))
        else:
            out.append(h[:0])
    return out


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per permutation x -> a * x + b (mod 2**32, a odd), the least value over the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (a[:, None] * x[None, i : i + 1024] + b[:, None]).min(axis=1), out=least)
    return least


def permutations(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)
