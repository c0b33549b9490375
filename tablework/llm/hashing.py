"""Vectorised 64-bit hashes of words, shingles and byte windows, the same on every machine."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit number (a bijection)."""
    x = x.astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Polynomial hashes of any byte range of a text from one running sum."""

    def __init__(self, seed: int) -> None:
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(BASE) + U64(seed))
        self.base = int(mix(np.array([seed + 77], dtype=U64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, base, dtype=U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums, one more than there are bytes."""
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of each window of so many bytes."""
        n = len(sums) - width
        return mix((sums[width:] - sums[:n]) * self.down[:n])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    white = np.ones(len(data) + 2, dtype=bool)
    white[1:-1] = WHITE[data]
    edges = np.flatnonzero(white[1:] != white[:-1])
    return edges[::2], edges[1::2]


def word_hashes(rolling: Rolling, text: bytes) -> np.ndarray:
    """A hash of each word, A-Z lower-cased."""
    data = np.frombuffer(text.translate(LOWER), dtype=np.uint8)
    start, end = word_bounds(data)
    return rolling.ranges(rolling.sums(data), start, end)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of runs of so many words, sorted; a shorter text is one run, an empty one has none."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    run = min(width, len(words))
    out = np.full(n, U64(run), dtype=U64)
    for k in range(run):
        out = out * U64(0xD6E8FEB86659FD93) + words[k : k + n]
    return np.unique(mix(out))
