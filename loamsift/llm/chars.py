"""Batches of texts as arrays of code points, with the word runs and hashes found in them.

Every operator of this subpackage that looks at characters works on blocks of at most
``BLOCK_CHARS`` code points (one text that is longer makes a block of its own), so memory follows
the longest text, not the Arrow batch.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

BLOCK_CHARS = 1_000_000
#: Bits of the class of a character.
LETTER, DIGIT, SPACE, UPPER, MARK = 1, 2, 4, 8, 16

_U64 = np.uint64


@functools.cache
def classes() -> np.ndarray:
    """The class bits of every code point, one byte each."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(0x40000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            table[c] = LETTER | (UPPER if kind in ("Lu", "Lt") else 0)
        elif kind == "Nd":
            table[c] = DIGIT
        elif kind[0] == "M":
            table[c] = MARK
        elif chr(c).isspace():
            table[c] = SPACE
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = np.asarray(x, _U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


@functools.cache
def _char_keys() -> np.ndarray:
    return mix(np.arange(1, sys.maxunicode + 2, dtype=_U64) * _U64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.ones(n, _U64)
        done, step = 1, base
        with np.errstate(over="ignore"):
            while done < n:
                k = min(done, n - done)
                out[done : done + k] = out[:k] * _U64(step)
                step = step * step & (1 << 64) - 1
                done += k
        return out

    return of(_BASE), of(_INVERSE)


class Block:
    """Some texts laid end to end: ``cp`` holds their code points, text k is cp[start[k]:start[k + 1]]."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.joined = "".join(texts)
        self.cp = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.start[1:])

    def runs(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text number of the longest runs of characters of the given classes within a text."""
        if not len(self.cp):
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = np.zeros(len(self.cp) + 1, bool)
        inside[:-1] = (classes()[self.cp] & bits) != 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        cuts = self.start[1:-1][self.start[1:-1] < len(self.cp)]
        opens[cuts] |= inside[cuts]
        begin = np.flatnonzero(opens)
        closes = np.zeros(len(self.cp) + 1, bool)
        closes[1:] = inside[:-1] & ~inside[1:]
        closes[cuts] |= inside[cuts] & inside[np.maximum(cuts - 1, 0)] & (cuts > 0)
        end = np.flatnonzero(closes)
        return begin, end, np.searchsorted(self.start, begin, "right") - 1

    @functools.cached_property
    def _prefix(self) -> np.ndarray:
        n = len(self.cp)
        sums = np.zeros(n + 1, _U64)
        with np.errstate(over="ignore"):
            np.cumsum(_char_keys()[self.cp] * _powers(_size(n))[0][:n], out=sums[1:])
        return sums

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span that depends on its characters only."""
        with np.errstate(over="ignore"):
            return mix((self._prefix[end] - self._prefix[begin]) * _powers(_size(len(self.cp)))[1][begin] + (end - begin).astype(_U64))


def _size(n: int) -> int:
    """Powers are kept for a few sizes only."""
    return max(2 * BLOCK_CHARS, 1 << (n + 1).bit_length())


def groups(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Position of the first text and texts of ``limit`` characters together, or one longer text, over all texts in order; null counts as empty."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if k > first and size + n > limit:
            yield first, [x or "" for x in texts[first:k]]
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, [x or "" for x in texts[first:]]


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, Block]]:
    """The groups of the texts as blocks."""
    for first, group in groups(texts, limit):
        yield first, Block(group)
