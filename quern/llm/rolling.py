"""Hashes of byte ranges by prefix sums, and the words of texts by such hashes (operators 5, 7 and 9)."""

from __future__ import annotations

import numpy as np

from quern.llm.common import mix

_BASE = 0xD6E8FEB86659FD93


class _Powers:
    """Powers of the hash's base and of its inverse, made once in a process."""

    up = down = None

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            steps = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
            for x in steps:
                x[0] = 1
            cls.up, cls.down = (np.cumprod(x, dtype=np.uint64) for x in steps)
        return cls.up, cls.down


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Hashes:
    """Hashes of any ranges of data[start:stop], by the ranges' absolute ends."""

    def __init__(self, data: np.ndarray, start: int, stop: int):
        part = data[start:stop]
        self.start = start
        up, self.down = _Powers.of(max(len(part), 1 << 20))
        self.sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        s, e = starts - self.start, stops - self.start
        return mix((self.sums[e] - self.sums[s]) * self.down[s])


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_PIECE = 1 << 20  # bytes hashed at once


def words_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text by text, and how many words each text has. Words are cut at ASCII white space."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    counts = np.diff(np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    hashes = np.zeros(len(begin), np.uint64)
    first = 0
    while first < len(begin):
        low = begin[first]
        last = max(first + 1, int(np.searchsorted(end, low + _PIECE, side="right")))
        hashes[first:last] = Hashes(data, int(low), int(end[last - 1])).of(begin[first:last], end[first:last])
        first = last
    return hashes, counts.astype(np.int64)
