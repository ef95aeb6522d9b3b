"""Words, shingles and their hashes for many texts at once, over flat numpy arrays.

Words are maximal runs of bytes other than space and ``\\t`` to ``\\r``: ASCII bytes never occur
inside a longer UTF-8 sequence, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

U = np.uint64
_R = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_RI = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for i < n at least. Tables beyond 2**21 (32 MB) are not kept."""
    if len(_powers.get("p", ())) >= n:
        return _powers["p"], _powers["q"]
    out = {}
    for key, r in (("p", _R), ("q", _RI)):
        x = np.full(max(n, 1 << 19), r, dtype=U)
        x[0] = 1
        out[key] = np.multiply.accumulate(x)
    if n <= 1 << 21:
        _powers.update(out)
    return out["p"], out["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def encoded(texts) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def chunks(items: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Slices of ``items`` of about ``most`` bytes; a longer item is a slice of its own."""
    at, held = 0, 0
    for i, b in enumerate(items):
        if held and held + len(b) > most:
            yield at, i
            at, held = i, 0
        held += len(b) + 1
    if at < len(items):
        yield at, len(items)


class Words:
    """The words of some texts: ``start``/``end`` in ``buf``, ``hash``, and ``first[d] .. first[d + 1]`` for text d."""

    def __init__(self, items: list[bytes]):
        buf = np.frombuffer(b"\n".join([*items, b""]), dtype=np.uint8)
        inside = ~SPACE[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(buf) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.buf, self.start, self.end = buf, edge[0::2], edge[1::2]
        self.offset = np.concatenate([[0], np.cumsum([len(b) + 1 for b in items])]).astype(np.int64)
        self.first = np.searchsorted(self.start, self.offset)
        self.hash = self._hashes(buf.astype(U) + U(1))

    def _hashes(self, values: np.ndarray) -> np.ndarray:
        p, q = powers(len(values) + 1)
        total = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * p[: len(values)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * q[self.start] + (self.end - self.start).astype(U) * U(_RI))

    @cached_property
    def other(self) -> np.ndarray:
        """Second hashes of the words, from other values of the bytes: words that share ``hash`` by chance don't share these."""
        return self._hashes(mix(np.arange(256, 512, dtype=U))[self.buf])


def shingles(words: Words, d: int, width: int = 5) -> np.ndarray:
    """The distinct hashed runs of ``width`` words of text d, sorted; one run of all its words if it has fewer, none if it has no word."""
    h = words.hash[words.first[d] : words.first[d + 1]]
    if not len(h):
        return h
    n = min(width, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) + h[k : len(h) - n + 1 + k]
    return np.unique(mix(out + np.array([n], dtype=U)))
