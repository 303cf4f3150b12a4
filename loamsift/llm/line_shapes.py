"""Counts over the lines of a block of texts, by array operations."""

from __future__ import annotations

import functools

import numpy as np

from .chars import DIGIT, LETTER, SPACE, Block, classes

# Characters that end a sentence or a quotation.
SENTENCE_ENDS = ".!?…。！？”’\"'"


@functools.cache
def _ends() -> np.ndarray:
    return np.array(sorted(map(ord, SENTENCE_ENDS)), np.uint32)


class LineShapes:
    """Counts of each line of a block, lines numbered through it as they follow one another in the texts."""

    def __init__(self, block: Block):
        n, cp = len(block.texts), block.cp
        breaks = np.flatnonzero(cp == 10)
        of = np.searchsorted(block.start, breaks, "right") - 1
        text, begin = np.concatenate((np.arange(n), of)), np.concatenate((block.start[:-1], breaks + 1))
        order = np.lexsort((begin, text))
        text, begin = text[order], begin[order]
        end = np.append(begin[1:] - 1, len(cp))
        last = np.append(text[1:] != text[:-1], True)
        end[last] = block.start[1:][text[last]]
        self.text, self.begin, self.end = text, begin, end
        self.first = np.searchsorted(text, np.arange(n))
        self.block = block

    # what each operator asks for is counted when it asks

    @functools.cached_property
    def _masks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = classes()[self.block.cp]
        return (kind & LETTER) != 0, (kind & DIGIT) != 0, (kind & SPACE) != 0

    def _count(self, mask: np.ndarray) -> np.ndarray:
        """Characters of a mask in each line, by the places where they stand."""
        at = np.flatnonzero(mask)
        return np.searchsorted(at, self.end) - np.searchsorted(at, self.begin)

    @functools.cached_property
    def _heads(self) -> np.ndarray:
        return self.block.start[:-1][self.block.start[:-1] < len(self.block.cp)]

    def _starts(self, mask: np.ndarray) -> np.ndarray:
        out = mask.copy()
        out[1:] &= ~mask[:-1]
        out[self._heads] = mask[self._heads]
        return out

    def _among(self, characters: str) -> np.ndarray:
        cp = self.block.cp
        return np.logical_or.reduce([cp == ord(c) for c in characters])

    @functools.cached_property
    def chars(self) -> np.ndarray:
        return self.end - self.begin

    @functools.cached_property
    def letters(self) -> np.ndarray:
        return self._count(self._masks[0])

    @functools.cached_property
    def digits(self) -> np.ndarray:
        return self._count(self._masks[1])

    @functools.cached_property
    def ink(self) -> np.ndarray:
        return self.chars - self._count(self._masks[2])

    @functools.cached_property
    def runs(self) -> np.ndarray:
        return self._count(self._starts(self._masks[0]))

    @functools.cached_property
    def tokens(self) -> np.ndarray:
        return self._count(self._starts(~self._masks[2]))

    @functools.cached_property
    def meet(self) -> np.ndarray:
        """Places where a letter and a digit touch."""
        letter, digit, _ = self._masks
        meet = np.zeros(len(letter), bool)
        meet[1:] = (letter[1:] & digit[:-1]) | (digit[1:] & letter[:-1])
        meet[self._heads] = False
        return self._count(meet)

    @functools.cached_property
    def hangul(self) -> np.ndarray:
        cp = self.block.cp
        return self._count((cp >= 0xAC00) & (cp <= 0xD7A3)) * 2 > self.letters

    @functools.cached_property
    def bars(self) -> np.ndarray:
        return self._count(self._among("|>»"))

    @functools.cached_property
    def signs(self) -> np.ndarray:
        return self._count(self._among("\t;={}/_<[]#@\\"))

    @functools.cached_property
    def _last(self) -> np.ndarray:
        """Where the last character of each line stands that is no white space."""
        at = np.flatnonzero(~self._masks[2])
        return np.append(at, len(self.block.cp))[np.maximum(np.searchsorted(at, self.end) - 1, 0)]

    def _at(self, place: np.ndarray) -> np.ndarray:
        return np.where(self.ink > 0, np.append(self.block.cp, np.uint32(0))[place], 0).astype(np.uint32)

    @functools.cached_property
    def head(self) -> np.ndarray:
        """The first character of each line that is no white space; 0 in blank lines."""
        at = np.flatnonzero(~self._masks[2])
        return self._at(np.append(at, len(self.block.cp))[np.searchsorted(at, self.begin)])

    @functools.cached_property
    def tail(self) -> np.ndarray:
        """The last character of each line that is no white space; 0 in blank lines."""
        return self._at(self._last)

    @functools.cached_property
    def before_tail(self) -> np.ndarray:
        return np.where(self.ink > 1, self._at(np.maximum(self._last - 1, 0)), 0).astype(np.uint32)

    @functools.cached_property
    def ended(self) -> np.ndarray:
        return np.isin(self.tail, _ends())

    @property
    def blank(self) -> np.ndarray:
        return self.ink == 0

    def units(self) -> np.ndarray:
        """Characters in the measure of Latin scripts; a Hangul syllable counts for two and a half."""
        return np.where(self.hangul, self.ink * 2.5, self.ink)
