"""A logistic classifier of lines, body or furniture, fitted on the numbers of documents that hold them.

There are no labelled lines. Labels of a bounded sample of pages come from the collection itself: a
sentence that stands in no other document is body; a line that stands in very many is furniture,
unless wherever it recurs it stands between sentences, as headings and quotations do. The features are
hashed words and pairs of words, the line as a whole, its shape, place and neighbours, and, in one of
two fits, its count. The log odds are the terminal capacities of the cut in main_content.
"""

from __future__ import annotations

import numpy as np

from .chars import LETTER, Block, mix
from .least_cut import least_cut
from .line_shapes import LineShapes

_U64 = np.uint64
#: Size of the hashed part of the weights: 1 MB of 32-bit numbers, whatever the collection.
HASHED = 1 << 18
#: Pages that are fitted at most, in order of a seeded hash.
MAX_PAGES = 2000
#: Documents that hold a line: so few for one that is a page's own, so many for one that belongs to sites.
OWN, SHARED = 3, 200
_SHAPES = 1 << 14
_FIELDS = 16


def _hash_slot(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + _U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & _U64(HASHED - 1)).astype(np.int64)


def _bucket(x: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right")


class PageLines:
    """The non-blank lines of a block of pages, with what the classifier and the cut look at."""

    def __init__(self, block: Block, skip_title: bool, shapes: LineShapes | None = None):
        s = self.shapes = shapes or LineShapes(block)
        number = np.arange(len(s.chars)) - s.first[s.text]
        some = ~s.blank & ~(skip_title & (number == 0))
        self.at = np.flatnonzero(some)
        self.page, self.line_no = s.text[self.at], number[self.at]
        # runs of lines between blank ones
        self.part = np.cumsum(~some)[self.at] + self.page
        n = len(self.at)
        new = np.ones(n, bool)
        new[1:] = self.page[1:] != self.page[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        self.top = np.arange(n) - np.repeat(starts, sizes)
        self.bottom = np.repeat(sizes, sizes) - 1 - self.top
        self._words(block)
        self._shape_codes()

    @classmethod
    def joined(cls, parts: list[PageLines]) -> PageLines:
        """The lines of several blocks as one, for the fit; without the shapes of the blocks."""
        out = cls.__new__(cls)
        for name in ("line_no", "top", "bottom", "words", "key", "slots", "values", "long", "form", "prose", "ended", "kind", "fields", "before", "after", "between"):
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        out.at = np.arange(len(out.kind))
        for name, step in (("page", "page"), ("part", "part"), ("rows", "at")):
            shift, found = 0, []
            for p in parts:
                found.append(getattr(p, name) + shift)
                shift += len(p.at) if step == "at" else int(getattr(p, step)[-1]) + 1 if len(p.at) else 0
            setattr(out, name, np.concatenate(found))
        return out

    def _words(self, block: Block) -> None:
        begin, end, text = block.runs(LETTER)
        h = block.hashes(begin, end)
        line = np.cumsum(block.cp == 10)[begin] + text if len(begin) else text
        place = np.full(len(self.shapes.chars), -1)
        place[self.at] = np.arange(len(self.at))
        row = place[line]
        h, row = h[row >= 0], row[row >= 0]
        n = len(self.at)
        self.words = np.bincount(row, minlength=n)
        share = 1 / np.sqrt(np.maximum(1, self.words))
        pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
        key = np.zeros(n, _U64)
        with np.errstate(over="ignore"):
            pairs = mix(h[pair] * _U64(3) + mix(h[pair + 1])) if len(pair) else np.zeros(0, _U64)
            if len(h):
                heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                order = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))
                key[row[heads]] = np.add.reduceat(mix(h + order.astype(_U64)), heads)
        self.key = key
        whole = np.flatnonzero((self.words > 0) & (self.words <= 12))
        self.rows = np.concatenate((row, row[pair], whole))
        self.slots = np.concatenate((_hash_slot(h, 1), _hash_slot(pairs, 2), _hash_slot(key[whole], 3)))
        self.values = np.concatenate((share[row], share[row[pair]], np.ones(len(whole)))).astype(np.float32)

    def _shape_codes(self) -> None:
        s, at = self.shapes, self.at
        units = s.units()[at]
        self.long = _bucket(units, [5, 12, 25, 45, 70, 100, 160])
        ended, head, tail = s.ended[at], s.head[at], s.tail[at]
        self.ended = ended
        end = np.select([s.before_tail[at] == ord("."), tail == ord("»"), ended, (tail >= 48) & (tail <= 57), tail == ord(")"), tail == ord(":")], [1, 2, 3, 4, 5, 6], 0)
        end[(end == 1) & (tail != ord("."))] = np.where(ended, 3, 0)[(end == 1) & (tail != ord("."))]
        quote = np.isin(head, np.array([ord(c) for c in "“\"„«»'”"], np.uint32))
        begin = np.select([head == ord("*"), np.isin(head, np.array([ord(c) for c in "-–•+"], np.uint32)), (head >= 48) & (head <= 57), quote, head == ord("#"), head == ord("©")], [1, 2, 3, 4, 5, 6], 0)
        self.form = (begin * 7 + end) * 8 + self.long
        letters = _bucket(s.letters[at] / np.maximum(1, s.ink[at]), [0.3, 0.5, 0.7, 0.85, 0.95])
        bars, signs = np.minimum(s.bars[at], 4), np.minimum(s.signs[at], 3)
        words = np.minimum(s.runs[at], 15)
        self.prose = (self.long >= 5) & ended & (s.runs[at] >= 4)
        self.kind = begin * 2 + ended
        kind = self.page * 16 + self.kind
        new = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (self.long[1:] >= 5)))) if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(new, len(at)))
        alike = np.repeat(sizes, sizes)
        top, bottom = np.minimum(self.top, 6), np.minimum(self.bottom, 6)

        def beside(step: int) -> np.ndarray:
            """Shape of the line before or after, with whether blank lines lie between; 0 where there is none."""
            out = np.zeros(len(at), np.int64)
            here, there = (slice(1, None), slice(None, -1)) if step < 0 else (slice(None, -1), slice(1, None))
            same = self.page[here] == self.page[there]
            code = 1 + (np.minimum(self.long, 5)[there] * 3 + np.where(self.prose[there], 2, ended[there] * 1)) * 2 + (self.part[here] != self.part[there])
            out[here] = np.where(same, code, 0)
            return out

        self.before, self.after = beside(-1), beside(1)
        self.between = (self.before > 0) & ((self.before - 1) // 2 % 3 == 2) & (self.after > 0) & ((self.after - 1) // 2 % 3 == 2)
        short = np.minimum(self.long, 4)
        fields = [
            self.form,
            words * 2 + s.hangul[at],
            (letters * 5 + bars) * 4 + signs,
            top * 8 + np.minimum(self.long, 7),
            bottom * 8 + np.minimum(self.long, 7),
            self.before * 8 + self.long,
            self.after * 8 + self.long,
            (self.before * 40 + self.after) * 5 + short,
            np.minimum(bars, 3) * 16 + words,
            np.minimum(s.digits[at], 7) * 8 + self.long,
            _bucket(alike, [2, 3, 5, 8, 12, 20]) * 64 + begin * 8 + np.minimum(self.long, 7),
        ]
        self.fields = np.stack([f % _SHAPES for f in fields], axis=1) + np.arange(len(fields)) * _SHAPES + HASHED

    def count_fields(self, counts: np.ndarray) -> np.ndarray:
        """Features of the counts by line (nan where there is none): the count, and how it lies to that of the page's sentences."""
        c = np.log10(np.maximum(np.nan_to_num(counts, nan=1.0), 1))
        typical = self.typical(counts)
        a = _bucket(c, [0.1, 0.4, 0.6, 1, 1.5, 2, 2.5, 3, 3.5, 4, 4.5]) * 16 + self.long * 2 + self.ended
        b = (_bucket(c - typical, [-1, 0.1, 0.4, 0.7, 1, 1.5, 2, 2.5, 3, 4]) * 8 + self.long) * 7 + self.form // 8 % 7
        middle, size = _part_medians(self, counts)
        d = _bucket(np.log10(np.maximum(middle, 1)), [0.1, 0.6, 1, 1.5, 2, 2.5, 3, 4]) * 8 + _bucket(size, [2, 3, 5, 8, 12, 20])
        own = _bucket(c, [0.1, 0.6, 1.3, 2, 3])
        near = np.full((2, len(own)), 6)
        same = self.page[1:] == self.page[:-1]
        near[0, 1:] = np.where(same, own[:-1], 6)
        near[1, :-1] = np.where(same, own[1:], 6)
        e = ((near[0] * 7 + near[1]) * 6 + own) * 5 + np.minimum(self.long, 4)
        n = self.fields.shape[1]
        return np.stack([x % _SHAPES + (n + k) * _SHAPES for k, x in enumerate((a, b, d, e))], axis=1) + HASHED

    def all_fields(self, counts: np.ndarray) -> np.ndarray:
        return np.concatenate((self.fields, self.count_fields(counts)), axis=1)

    def typical(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the lower quartile of the counts of the sentences of a line's page, 0 where it has none: a page whose sentences mostly stand in many others is a copied one."""
        some = np.flatnonzero(self.prose & ~np.isnan(counts))
        pages = int(self.page[-1]) + 1 if len(self.page) else 0
        out = np.zeros(pages)
        if len(some):
            some = some[np.lexsort((counts[some], self.page[some]))]
            page = self.page[some]
            heads = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1])))
            sizes = np.diff(np.append(heads, len(some)))
            out[page[heads]] = np.log10(np.maximum(1, counts[some[heads + sizes // 4]]))
        return out[self.page]


def _occurrences(lines: PageLines, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By line, over all lines of the same words: how many, their median count, the share that stands between sentences, and the share at a page's end."""
    _, which, rows = np.unique(lines.key, return_inverse=True, return_counts=True)
    order = np.lexsort((counts, which))
    heads = np.concatenate(([0], np.cumsum(rows)[:-1]))
    known = np.bincount(which, ~np.isnan(counts), len(rows)).astype(np.int64)
    median = np.where(known > 0, counts[order[np.minimum(heads + np.maximum(known - 1, 0) // 2, len(order) - 1)]], 0)  # nan sorts last
    own = np.where(np.isnan(counts), np.inf, counts) <= 10 ** (lines.typical(counts) + 0.8)
    prose = lines.prose & own
    between = []
    for step in (-1, 1):
        near = np.zeros(len(prose), bool)
        here, there = (slice(1, None), slice(None, -1)) if step < 0 else (slice(None, -1), slice(1, None))
        near[here] = prose[there] & (lines.page[here] == lines.page[there])
        between.append(np.bincount(which, near, len(rows)) / rows)
    last = np.bincount(which, lines.bottom == 0, len(rows)) / rows
    return rows[which], median[which], np.minimum(*between)[which], last[which]


def weak_labels(lines: PageLines, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 body, 0 furniture, -1 not known, for each line of a sample; and how much each counts."""
    rows, median, between, last = _occurrences(lines, counts)
    typical = lines.typical(counts)
    log = np.log10(np.maximum(np.nan_to_num(counts, nan=1.0), 1))
    have = ~np.isnan(counts)
    label = np.full(len(counts), -1)
    weight = np.ones(len(counts))
    label[have & (log <= typical + 0.5) & ((lines.long >= 5) | lines.prose)] = 1
    shared = (rows >= 2) & (median >= SHARED)
    label[(have & (log >= np.maximum(2.3, typical + 1))) | shared] = 0
    # what stands between sentences wherever it recurs is a heading or a quotation
    label[(rows >= 4) & (between >= 0.5) & (last <= 0.1)] = 1
    # short lines of few documents: a list of a page's own lines is its own, others are like what is known beside them
    own = have & (log <= np.log10(OWN))
    soft = (label < 0) & have & (log <= 2)
    middle, size = _part_medians(lines, counts)
    among = np.bincount(lines.part, label == 0)[lines.part] > 0
    of_list = soft & (size >= 5) & (middle <= OWN) & ~among
    sides = []
    index = np.arange(len(label))
    for near in (np.maximum.accumulate(np.where(label >= 0, index, -1)), len(label) - 1 - np.maximum.accumulate(np.where(label[::-1] >= 0, index, -1))[::-1]):
        fine = (near >= 0) & (near < len(label)) & (np.abs(near - index) <= 3)
        fine[fine] &= lines.part[near[fine]] == lines.part[fine]
        out = np.full(len(label), -1)
        out[fine] = label[near[fine]]
        sides.append(out)
    before, after = sides
    agree = np.where(before < 0, after, np.where(after < 0, before, np.where(before == after, before, -1)))
    alone = soft & own & (rows == 1) & ((agree == 1) | ~among)
    label = np.where(of_list | alone, 1, np.where(soft, agree, label))
    weight[soft] = np.where(of_list | alone, 0.5, 0.3)[soft]
    return label, np.where(label < 0, 0, weight)


def _part_medians(lines: PageLines, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By line: the median count of the lines between the same blank lines (1 where none has a count), and how many they are."""
    _, which, size = np.unique(lines.part, return_inverse=True, return_counts=True)
    order = np.lexsort((counts, which))
    heads = np.concatenate(([0], np.cumsum(size)[:-1]))
    known = np.bincount(which, ~np.isnan(counts), len(size)).astype(np.int64)
    median = np.where(known > 0, counts[order[np.minimum(heads + np.maximum(known - 1, 0) // 2, len(order) - 1)]], 1.0)
    return median[which], size[which]


class LineModel:
    """Weights of the two fits: without and with counts."""

    def __init__(self, plain: np.ndarray, counted: np.ndarray, ties: np.ndarray):
        self.plain, self.counted, self.ties = plain, counted, ties

    @staticmethod
    def _odds(w: np.ndarray, lines: PageLines, fields: np.ndarray) -> np.ndarray:
        return np.bincount(lines.rows, w[lines.slots] * lines.values, len(lines.at)) + w[fields].sum(axis=1)

    def odds(self, lines: PageLines, counts: np.ndarray | None) -> np.ndarray:
        """Log odds of body against furniture; the fit without counts where a line has none."""
        if not len(lines.at):
            return np.zeros(0)
        if counts is None or np.isnan(counts).all():
            return self._odds(self.plain, lines, lines.fields)
        both = self._odds(self.counted, lines, lines.all_fields(counts))
        return np.where(np.isnan(counts), self._odds(self.plain, lines, lines.fields), both) if np.isnan(counts).any() else both

    @classmethod
    def neutral(cls) -> LineModel:
        """Where no page has counts to learn from every line is taken for body."""
        w = np.zeros(HASHED + _FIELDS * _SHAPES, np.float32)
        w[HASHED : HASHED + _SHAPES] = 1
        return cls(w, w, np.zeros((2, 2, 2)))

    @classmethod
    def fit(cls, lines: PageLines, counts: np.ndarray) -> LineModel:
        """Two rounds: labels that are no more than likely are replaced by what the first round's cut says of them."""
        label, weight = weak_labels(lines, counts)
        if not (label == 0).any() or not (label == 1).any():
            return cls.neutral()
        first = cls._weights(lines, lines.all_fields(counts), label, weight)
        odds = cls._odds(first, lines, lines.all_fields(counts))
        body = least_cut(odds, *edges(lines, _ties(lines, label, weight)))
        sure = weight == 1
        label = np.where(sure, label, body.astype(np.int64))
        weight = np.where(sure, 1.0, 0.7 * np.minimum(1, np.abs(odds) / 2))
        return cls(cls._weights(lines, lines.fields, label, weight), cls._weights(lines, lines.all_fields(counts), label, weight), _ties(lines, label, weight))

    @staticmethod
    def _weights(lines: PageLines, fields: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 40, penalty: float = 1e-6) -> np.ndarray:
        """Logistic regression by gradients over the whole sample, with step sizes that adapt to each weight."""
        total = HASHED + _FIELDS * _SHAPES
        w, sums = np.zeros(total), np.full(total, 1e-6)
        flat, owner = fields.ravel(), np.repeat(np.arange(len(fields)), fields.shape[1])
        share = weight / weight.sum()
        for _ in range(steps):
            z = np.bincount(lines.rows, w[lines.slots] * lines.values, len(label)) + w[fields].sum(axis=1)
            error = share * (label - 1 / (1 + np.exp(-z)))
            g = np.bincount(lines.slots, error[lines.rows] * lines.values, total) + np.bincount(flat, error[owner], total) - penalty * w
            sums += g * g
            w += 0.3 * g / np.sqrt(sums)
        return w.astype(np.float32)


def _ties(lines: PageLines, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Edge weights by distance (1, 2), whether blank lines lie between, and whether the shapes are alike: a quarter of the log odds that known neighbours have one label, for the features see the neighbours too."""
    out = np.zeros((2, 2, 2))
    for apart in (1, 2):
        a, b = np.arange(len(label) - apart), np.arange(apart, len(label))
        known = (weight[a] > 0) & (weight[b] > 0) & (lines.page[a] == lines.page[b])
        for split in (0, 1):
            for alike in (0, 1):
                of = known & ((lines.part[a] != lines.part[b]) == bool(split)) & ((lines.kind[a] == lines.kind[b]) == bool(alike))
                same = int((label[a] == label[b])[of].sum())
                out[apart - 1, split, alike] = max(0.0, 0.25 * np.log((same + 1) / (of.sum() - same + 1)))
    return out


def edges(lines: PageLines, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges between lines one and two apart, with their weights."""
    found = []
    i = np.arange(len(lines.at))
    for apart in (1, 2):
        a, b = i[:-apart], i[apart:]
        w = ties[apart - 1][(lines.part[a] != lines.part[b]).astype(np.int64), (lines.kind[a] == lines.kind[b]).astype(np.int64)]
        some = (lines.page[a] == lines.page[b]) & (w > 0)
        found.append((a[some], b[some], w[some]))
    return tuple(np.concatenate(x) for x in zip(*found))
