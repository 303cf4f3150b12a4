"""Suffix arrays over numbered terms of records, with common prefixes and the counts of every n-gram.

All suffixes of a block of records are ordered by prefix doubling; a suffix ends with its record. The
common-prefix array holds how many terms a suffix shares with the one before it in that order. The
occurrences of an n-gram are an interval of the order within which all common prefixes have n terms or
more. Its records are its occurrences less the adjacencies within one record: of each two suffixes of a
record that follow one another in the order, the second is a duplicate for every n-gram as long as the
least common prefix between them.
"""

from __future__ import annotations

import functools

import numpy as np


class SuffixArray:
    """ids: term numbers from 0 in order of position; record: their records, ascending."""

    def __init__(self, ids: np.ndarray, record: np.ndarray):
        n = len(ids)
        self.record = record
        self.end = np.searchsorted(record, record, "right")  # of the record of each position
        levels = [ids.astype(np.int64) + 1]  # ranks of the first 1, 2, 4... terms; 0 is a record's end
        step, distinct = 1, -1
        while n:
            far = np.arange(n) + step
            inside = far < self.end
            if not inside.any():
                break
            second = np.zeros(n, np.int64)
            second[inside] = levels[-1][far[inside]]
            ranks = np.unique(levels[-1] * (n + 2) + second if levels[-1].max() < 2**31 else np.unique(levels[-1], return_inverse=True)[1] * (n + 2) + second, return_inverse=True)[1] + 1
            if ranks.max() == distinct:
                break  # what is equal so far ends alike
            distinct = ranks.max()
            levels.append(ranks)
            step *= 2
        self.levels = levels
        self.order = np.argsort(levels[-1], kind="stable")

    @functools.cached_property
    def common(self) -> np.ndarray:
        """By place in the order: terms shared with the suffix before, 0 at the first."""
        i, j = self.order[:-1], self.order[1:]
        rest = np.minimum(self.end[i] - i, self.end[j] - j)
        shared = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            open_ = np.flatnonzero(shared < rest)
            same = open_[self.levels[k][i[open_] + shared[open_]] == self.levels[k][j[open_] + shared[open_]]]
            shared[same] = np.minimum(shared[same] + (1 << k), rest[same])
        return np.concatenate(([0], shared)) if len(self.order) else shared

    @functools.cached_property
    def duplicate(self) -> np.ndarray:
        """By place in the order: the longest n-gram for which the suffix repeats an earlier one of its record, 0 for the record's first."""
        n = len(self.order)
        out = np.zeros(n, np.int64)
        if n < 2:
            return out
        record = self.record[self.order]
        by_record = np.lexsort((np.arange(n), record))
        follows = np.flatnonzero(record[by_record[1:]] == record[by_record[:-1]])
        before, here = by_record[follows], by_record[follows + 1]
        # least common prefix of the places before + 1 ... here, from minima over 1, 2, 4... places
        least, size = [self.common], 1
        while size * 2 <= n:
            least.append(np.minimum(least[-1][:-size], least[-1][size:]))
            size *= 2
        width = here - before
        level = np.floor(np.log2(width)).astype(np.int64)
        for k in range(len(least)):
            of = np.flatnonzero(level == k)
            out[here[of]] = np.minimum(least[k][before[of] + 1], least[k][here[of] - (1 << k) + 1])
        return out

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First position, occurrences and records of every n-gram."""
        whole = self.end[self.order] - self.order >= n
        heads = np.flatnonzero((self.common < n) & whole)
        if not len(heads):
            none = np.zeros(0, np.int64)
            return none, none, none
        # a suffix too short for n terms begins an interval of its own, which holds nothing
        starts = np.flatnonzero(self.common < n)
        sizes = np.diff(np.append(starts, len(self.order)))
        again = np.add.reduceat((self.duplicate >= n).astype(np.int64), starts)
        some = whole[starts]
        return self.order[starts[some]], sizes[some], sizes[some] - again[some]

    def intervals(self) -> list[tuple[int, int, int, int, int]]:
        """(first position, shortest, longest, occurrences, records) of every class of repeated n-grams, in one pass: n-grams of the lengths shortest to longest from there have the same occurrences.

        The interval of a class lies between two places whose common prefixes are shorter; those nested in
        it have longer n-grams. A duplicate within a record belongs to the smallest interval that holds
        it and its forerunner, and is handed on to those around it.
        """
        out, common, duplicate = [], self.common.tolist(), self.duplicate.tolist()
        stack: list[list[int]] = []  # open intervals: longest, left place, duplicates
        for at in range(1, len(common) + 1):
            height = common[at] if at < len(common) else 0
            left, again = at - 1, 0
            while stack and stack[-1][0] > height:
                longest, left, own = stack.pop()
                again += own
                around = max(height, stack[-1][0] if stack else 0)
                out.append((int(self.order[left]), around + 1, longest, at - left, at - left - again))
                if stack and stack[-1][0] >= height:
                    stack[-1][2] += again
                    again = 0
            if height and (not stack or stack[-1][0] < height):
                stack.append([height, left, again])
            if at < len(common) and duplicate[at]:
                for interval in reversed(stack):
                    if interval[0] <= duplicate[at]:
                        interval[2] += 1
                        break
        return out
