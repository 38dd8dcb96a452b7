"""Hashes of the words of many texts at once.

A word's hash is the sum of a random 64-bit number for each of its characters
times powers of an odd base, modulo 2^64, mixed with the word's length. With
running sums over the joined texts a word costs two look-ups and no Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0xD1342543DE82EF95  # odd, and 5 modulo 8: its powers have the longest period
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_powers: list[np.ndarray] = []
PIECE = 1 << 19  # characters taken at a time


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def numbers(n: int) -> np.ndarray:
    """A random number for each of ``n`` characters."""
    return mixed((np.arange(n, dtype=np.uint64) + np.uint64(1)) * _MIX[0])


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1024)
        _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


class Sums:
    """Running sums over characters; ``of`` gives hashes of stretches of them."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _powers_to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * _MIX[0])


def edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values begin, and behind their ends."""
    padded = np.zeros(len(inside) + 2, bool)
    padded[1:-1] = inside
    at = np.flatnonzero(padded[1:] != padded[:-1])
    return at[::2], at[1::2]


def pieces(texts: list, blanks) -> Iterator[list[tuple[int, object]]]:
    """(index, part) of texts (str or bytes) in groups of about PIECE characters. A
    long text is cut at blanks, so no word is; one without blanks stays whole."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE:
            cut = max(text.rfind(b, at, at + PIECE) for b in blanks)
            if cut <= at:
                cut = min((c for b in blanks if (c := text.find(b, at + PIECE)) >= 0), default=len(text))
            if held:
                yield held
                held, size = [], 0
            yield [(i, text[at:cut])]
            at = cut
        part = text[at:] if at else text
        if held and size + len(part) > PIECE:
            yield held
            held, size = [], 0
        held.append((i, part))
        size += len(part) + 1
    if held:
        yield held
