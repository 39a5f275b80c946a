"""Hashes of words and of runs of words, for a whole batch of texts at once (numpy inside of tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes of text hashed at a time: few enough for the arrays to stay in a core's cache.
PART_BYTES = 1 << 17
WORDS = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
STEP = U(0xD1342543DE82EF95)
BACK = U(pow(0xD1342543DE82EF95, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = U(1)
    return np.multiply.accumulate(out)


class Powers:
    """Powers of STEP and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up, self.down = powers(STEP, 1), powers(BACK, 1)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(20, (n - 1).bit_length())
            self.up, self.down = powers(STEP, size), powers(BACK, size)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART_BYTES each; a longer text is alone."""
    first = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > PART_BYTES:
            yield first, k
            first, total = k, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its words (runs of bytes other than space and \\x09-\\x0D)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    up, down = POWERS.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * up[:-1], out=sums[1:])
    words = mixed((sums[end] - sums[start]) * down[start])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(words, np.searchsorted(start, ends[:-1]))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of n words in a row; of all words if they are fewer; empty for no words."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * STEP + words[k : len(words) - n + 1 + k]
    return np.unique(mixed(out))


def shingle_sets(texts: list[str], n: int = WORDS) -> Iterator[np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for a, b in parts(raw):
        for words in word_hashes(raw[a:b]):
            yield shingles(words, n)
