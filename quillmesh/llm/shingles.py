"""Sets of hashed word shingles, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
CHUNK = 1 << 18  # bytes of text hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as the longest chunk asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            for name, base in (("up", BASE), ("down", inverse)):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


def word_hashes(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word (a run without space, tab to carriage return) and its 64-bit hash."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = powers.get(len(b))
    inside = ~SPACE[b]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    h = (total[end] - total[start]) * down[start]
    return start, mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text, in lower case, its sorted distinct shingle hashes. A shorter text that has words is one shingle; without words the set is empty."""
    powers, at = Powers(), 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < CHUNK):
            group.append(texts[at].lower().encode("utf-8", "replace") + b" ")
            size += len(group[-1])
            at += 1
        start, h = word_hashes(b"".join(group), powers)
        bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum([len(g) for g in group]))))
        rolled = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
        for i in range(words):
            rolled = rolled * np.uint64(0xFF51AFD7ED558CCD) + h[i : i + len(rolled)] if len(rolled) else rolled
        rolled = mix(rolled)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            n = hi - lo
            if n >= words:
                yield np.unique(rolled[lo : hi - words + 1])
            elif n:
                one = np.array([n], dtype=np.uint64)
                for x in h[lo:hi]:
                    one = mix(one * np.uint64(0xFF51AFD7ED558CCD) + x)
                yield one
            else:
                yield np.zeros(0, dtype=np.uint64)
