"""Hashed sets of word shingles, for batches of texts at once."""

from __future__ import annotations

import numpy as np

from gridlark.llm.common import mix64

WORDS = 5
_BASE = 0x9E3779B97F4A7C15F39CC0605CEDC835 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = _VALUE[_LOWER]


def powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    size, step = 1, base % (1 << 64)
    with np.errstate(over="ignore"):
        while size < n:
            out[size : 2 * size] = out[: min(size, n - size)] * np.uint64(step)
            size, step = 2 * size, step * step % (1 << 64)
    return out


class Shingler:
    """Texts -> sorted distinct 64-bit hashes of their shingles.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case. A word's hash is a polynomial in its bytes, taken
    from running sums over the whole batch; a shingle's hash mixes those of its words and their places.
    """

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.base = _BASE % (1 << 64)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)
        self.place = mix64(np.arange(1000, 1000 + words, dtype=np.uint64)) | np.uint64(1)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(x + b" " for x in raw), np.uint8)
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw)))
        if len(data) > len(self.up):
            self.up, self.down = powers(len(data), self.base), powers(len(data), self.inverse)
        inside = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
        begin, stop = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.r_[np.uint64(0), np.cumsum(_VALUE[data] * self.up[: len(data)], dtype=np.uint64)]
            word = mix64((total[stop] - total[begin]) * self.down[begin] + (stop - begin).astype(np.uint64))
            k = self.words
            if len(word) >= k:
                run = np.zeros(len(word) - k + 1, np.uint64)
                for i in range(k):
                    run += word[i : len(word) - k + 1 + i] * self.place[i]
                run = mix64(run)
            else:
                run = np.zeros(0, np.uint64)
        first = np.searchsorted(begin, np.r_[0, ends])
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(run[a : b - k + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    out.append(mix64(np.array([(word[a:b] * self.place[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)])))
            else:
                out.append(run[:0])
        return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())
