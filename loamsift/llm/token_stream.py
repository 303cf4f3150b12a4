"""Byte-level BPE as a streaming transducer, and the way back.

A text is first cut into pretokens, whose ends depend on one character beyond them, and then into
tokens. A sequence of tokens is what the merge list makes of its bytes exactly if each two neighbours
are: undoing the merges of both, latest first, never meets a pair that an earlier merge would have
joined. So the last token of a prefix of the input is the only one ending there that fits the last
token where it begins, and a table of the last tokens of the latest positions, one for each byte of
the longest token, is all the state there is. ``lookahead`` bounds, from the merge list, how many bytes
beyond a token can still change it; a token is sent on once so many bytes, and those of one more token,
have come after it, so what is kept is bounded by the merge list and not by the text.

Distinct pretokens of a block are transduced once and their ids laid out by array operations.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import list_array, map_batches
from .chars import BLOCK_CHARS, Block, groups

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Pretokens whose ids a worker keeps, and the longest that it keeps, in characters.
KEEP, KEEP_CHARS = 400_000, 64


@functools.cache
def byte_names() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    return names | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class Merges:
    """A merge list. Tokens are numbered by age here (bytes, then merges in order); ``ids`` has their numbers in the vocabulary."""

    def __init__(self, file: bytes):
        model = json.loads(file)["model"]
        byte = byte_names()
        raw = lambda name: bytes(map(byte.__getitem__, name))
        vocabulary = {raw(k): v for k, v in model["vocab"].items() if all(c in byte for c in k)}
        self.tokens = [bytes([b]) for b in range(256)]
        self.age = {t: k for k, t in enumerate(self.tokens)}
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.age[raw(left)], self.age[raw(right)]
            self.joined[a, b] = len(self.tokens)
            self.age.setdefault(raw(left) + raw(right), len(self.tokens))
            self.tokens.append(raw(left) + raw(right))
            self.parts.append((a, b))
        self.ids = [vocabulary[t] for t in self.tokens]
        self.longest = max(map(len, self.tokens))
        self.tails = {t[k:] for t in self.tokens for k in range(len(t))}
        self._fits: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave the bytes of a and b as these two tokens."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[a, b] = self._undo(a, b)
        return known

    def _undo(self, a: int, b: int) -> bool:
        joined, parts = self.joined, self.parts
        before = len(self.tokens)  # a pair joined by a merge older than this would have been joined
        while True:
            if joined.get((a, b), before) < before:
                return False
            if a < 256 and b < 256:
                return True
            # undo the younger of the two; of one that is undone its side at the seam stays
            if a > b:
                before, a = a, parts[a][1]
            else:
                before, b = b + 1, parts[b][0]

    @functools.cached_property
    def lookahead(self) -> int:
        """Bytes beyond a merge's right part that can keep it from being made.

        The right part, or a token on its right edge while it was built, may be taken by an older merge
        with what follows, which in turn may be prevented from further right. Each step is older, so the
        longest such chain is found in order of age.
        """
        taken: dict[int, list[tuple[int, int]]] = {}  # left token: (age of the merge, most bytes it and older ones look at)
        far = 0
        for age in range(256, len(self.tokens)):
            left, right = self.parts[age]
            reach, c, limit = 0, right, age
            while True:
                for other, bytes_seen in reversed(taken.get(c, ())):
                    if other < limit:
                        reach = max(reach, bytes_seen)
                        break
                if c < 256:
                    break
                limit, c = c, self.parts[c][1]
            far = max(far, reach)
            seen = taken.setdefault(left, [])
            seen.append((age, max(len(self.tokens[right]) + reach, seen[-1][1] if seen else 0)))
        return far


class Transducer:
    """Feeds of bytes in, ids out as soon as no later byte can change them."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.base = 0  # all before is sent
        self.kept = bytearray()
        self.last: list[tuple[int, int]] = [(-1, 0)]  # by position from base: last token and its begin, relative to base

    def feed(self, data: bytes) -> list[int]:
        m = self.m
        age, tails, longest, last = m.age, m.tails, m.longest, self.last
        out: list[int] = []
        for byte in data:
            self.kept.append(byte)
            n = len(self.kept)
            found = None
            for begin in range(n - 1, max(-1, n - longest - 1), -1):
                piece = bytes(self.kept[begin:n])
                if piece not in tails:
                    break
                token = age.get(piece)
                if token is not None and last[begin] is not None and (begin == 0 and last[0][0] < 0 or m.fits(last[begin][0], token)):
                    found = (token, begin)
                    break
            last.append(found)
            if n >= 4 * longest:
                out += self._settle()
                last = self.last
        return out

    def _settle(self) -> list[int]:
        """Send the tokens of the path to the end that are further from it than a later byte can reach."""
        fixed = len(self.kept) - self.m.lookahead - self.m.longest
        upto = len(self.kept)
        while upto > max(0, fixed):
            upto = self.last[upto][1]
        if not upto:
            return []
        out = self._path(upto)
        end_token = self.last[upto][0]
        self.last = [(end_token, 0)] + [(t, b - upto) if b >= upto else (t, -1) for t, b in self.last[upto + 1 :]]
        del self.kept[:upto]
        self.base += upto
        return out

    def _path(self, end: int) -> list[int]:
        tokens = []
        while end > 0:
            token, end = self.last[end]
            tokens.append(self.m.ids[token])
        return tokens[::-1]

    def finish(self) -> list[int]:
        out = self._path(len(self.kept))
        self.__init__(self.m)
        return out


def transduce(merges: Merges, data: bytes) -> list[int]:
    """All ids of one pretoken."""
    t = Transducer(merges)
    return t.feed(data) + t.finish()


class TextDecoder:
    """Bytes in any portions to text: holds back at most three bytes of an unfinished character; what is no UTF-8 becomes U+FFFD."""

    def __init__(self):
        self.need, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes, last: bool = False) -> str:
        out: list[str] = []
        need, value, low, high = self.need, self.value, self.low, self.high
        for b in data:
            if need:
                if low <= b <= high:
                    need, value, low, high = need - 1, value << 6 | b & 0x3F, 0x80, 0xBF
                    if not need:
                        out.append(chr(value))
                    continue
                out.append("�")
                need = 0
            low, high = 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                need, value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                need, value, low, high = 2, b & 0x0F, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                need, value, low, high = 3, b & 0x07, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        if last and need:
            out.append("�")
            need = 0
        self.need, self.value, self.low, self.high = need, value, low, high
        return "".join(out)


_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
# White_Space of Unicode, without the separators U+001C to U+001F.
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _kinds() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(0x40000):
        kind = unicodedata.category(chr(c))[0]
        table[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    table[_BLANKS] = _SPACE
    return table


def pretoken_starts(block: Block) -> np.ndarray:
    """Where pretokens begin: runs of letters, of numbers or of other characters, each with one blank before it; contractions; other white space."""
    cp, n = block.cp, len(block.cp)
    kind = _kinds()[cp]
    opens = np.zeros(n + 1, bool)  # the last is beyond the end
    opens[0] = True
    opens[1:n] = kind[1:] != kind[:-1]
    cuts = np.zeros(n + 1, bool)
    cuts[block.start] = True
    opens |= cuts
    space = kind == _SPACE
    # the last white space before something else: a blank joins it, others stand alone
    tail = np.flatnonzero(space[:-1] & ~space[1:] & ~cuts[1:n])
    opens[tail] = True
    opens[tail[cp[tail] == 32] + 1] = False
    # contractions, where a pretoken begins with the apostrophe
    p = np.flatnonzero(opens[:n] & (cp == 39))
    p = p[p + 1 < n]
    p = p[(kind[p + 1] == _LETTER) & ~cuts[p + 1]]
    one = np.isin(cp[p + 1], [ord(c) for c in "stmd"])
    q = np.minimum(p + 2, n - 1)
    two = (p + 2 < n) & ~cuts[p + 2] & np.logical_or.reduce([(cp[p + 1] == ord(a)) & (cp[q] == ord(b)) for a, b in ("re", "ve", "ll")])
    for at, size in ((p[one], 2), (p[two], 3)):
        opens[at + 1] = False
        opens[at + size] = True
    return np.flatnonzero(opens[:n])


@functools.cache
def _safe():
    import regex

    return regex.compile(r"(?<=\S) (?=\p{L})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def portions(text: str, size: int = BLOCK_CHARS):
    """A text cut where a pretoken begins whatever stands around: before a blank between a character that is none and a letter, and between letters and numbers."""
    begin = 0
    while len(text) - begin > size and (cut := _safe().search(text, begin + size)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


class Tokenizer:
    """Ids of whole texts."""

    def __init__(self, file: bytes):
        self.merges = Merges(file)
        self.known: dict[str, list[int]] = {}
        byte = {m: t for m, t in zip(self.merges.ids, self.merges.tokens)}
        self.bytes_of = [byte.get(k, b"") for k in range(max(byte) + 1)]

    def pretoken(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            ids = transduce(self.merges, text.encode("utf-8", "replace"))
            if len(text) <= KEEP_CHARS:
                if len(self.known) >= KEEP:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, their number by text, and the begin and number of tokens of each pretoken."""
        begin = pretoken_starts(block)
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(block.texts), np.int64), begin, begin
        end = np.append(begin[1:], len(block.cp))
        _, head, which = np.unique(block.hashes(begin, end), return_index=True, return_inverse=True)
        each = [self.pretoken(block.joined[a:b]) for a, b in zip(begin[head].tolist(), end[head].tolist())]
        sizes = np.array([len(x) for x in each])
        flat = np.array([i for x in each for i in x], np.int32)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        counts = sizes[which]
        at = np.repeat(first[which] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        text = np.searchsorted(block.start, begin, "right") - 1
        return flat[at], np.bincount(text, counts, len(block.texts)).astype(np.int64), begin, counts

    def encoded(self, texts: list[str | None]):
        """First text, ids laid end to end and their number by text, for groups of the texts; a long text goes through in portions."""
        for first, group in groups(texts):
            if len(group) == 1 and len(group[0]) > BLOCK_CHARS:
                ids = np.concatenate([self.block(Block([p]))[0] for p in portions(group[0])])
                yield first, ids, np.array([len(ids)], np.int64)
            else:
                yield first, *self.block(Block(group))[:2]

    def encode(self, text: str) -> list[int]:
        return [i for _, ids, _ in self.encoded([text]) for i in ids.tolist()]

    def decode(self, ids: list[int]) -> str:
        d = TextDecoder()
        return "".join(d.feed(self.bytes_of[i]) for i in ids) + d.feed(b"", last=True)


@functools.lru_cache(maxsize=2)
def _tokenizer(file: bytes) -> Tokenizer:
    return Tokenizer(file)


def ship_tokenizer(df: DataFrame, path: str):
    """A function that gives the tokenizer on any executor; the file (a few MB, whatever the data) is broadcast."""
    with open(path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: _tokenizer(sent.value)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """(id, ids) for every row. A null text and an empty one both have the empty list."""
    get = ship_tokenizer(docs, tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        t = get()

        def each(batch):
            for first, ids, counts in t.encoded(batch.column(1).to_pylist()):
                yield {"_id": batch.column(0).slice(first, len(counts)), "ids": list_array(ids, counts, pa.int32())}

        return each

    return map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), make, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns named by keep, tokens) for every row; null and empty texts have 0 tokens."""
    get = ship_tokenizer(docs, tokenizer)
    columns = [F.col(id_col).alias("_id"), *(F.col(c) for c in keep)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def make():
        t = get()

        def each(batch):
            for first, _, counts in t.encoded(batch.column(batch.num_columns - 1).to_pylist()):
                yield {batch.schema.names[k]: batch.column(k).slice(first, len(counts)) for k in range(batch.num_columns - 1)} | {"tokens": counts}

        return each

    return map_batches(docs.select(*columns, F.col(text_col).alias("_text")), make, f"{ddl}, tokens long").withColumnRenamed("_id", id_col)


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = BYTE_BPE) -> DataFrame:
    """(id, text) from ids; null ids give null."""
    get = ship_tokenizer(encoded, tokenizer)
    kind = encoded.schema[id_col].dataType.simpleString()

    def make():
        t = get()

        def each(batch):
            yield {"_id": batch.column(0), "text": [None if x is None else t.decode(x) for x in batch.column(1).to_pylist()]}

        return each

    return map_batches(encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")), make, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
