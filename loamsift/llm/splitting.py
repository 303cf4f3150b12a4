"""Cutting oversized texts at natural boundaries by recursive bisection, with overlaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .token_stream import BYTE_BPE, Tokenizer, ship_tokenizer

#: Strength of a cut: after a blank line, after a line end, after a sentence, at a blank, elsewhere, within a character.
BLANK_LINE, LINE, SENTENCE, BLANK, ANY, NEVER = 4, 3, 2, 1, 0, -1
#: A token can begin within a character of at most four bytes; an overlap begins up to so many tokens earlier then.
SLACK = 3
_ENDS = tuple(x.encode() for e in ".!?。！？…" for x in (e, e + '"', e + "'", e + "”", e + "’", e + ")"))
_WHITE = b" \t\r\n"


def strengths(data: bytes, at: np.ndarray) -> np.ndarray:
    """Of a cut at each byte offset, the first and last of which are the ends of the text."""
    out = np.full(len(at), NEVER, np.int8)
    for k, b in enumerate(at.tolist()):
        if b == 0 or b == len(data):
            out[k] = BLANK_LINE
        elif data[b] & 0xC0 == 0x80:
            continue
        elif data[b - 1] == 10 and data[b] != 10:
            out[k] = BLANK_LINE if data[max(0, b - 3) : b].replace(b"\r", b"").endswith(b"\n\n") else LINE
        elif data[b] in _WHITE and data[b] != 10 and data[max(0, b - 6) : b].endswith(_ENDS):
            out[k] = SENTENCE
        else:
            out[k] = BLANK if data[b] in b" \t" and data[b - 1] not in _WHITE else ANY
    return out


def bisect(strength: np.ndarray, room: int) -> list[int]:
    """Cuts, as token numbers: the strongest boundary of the middle half, of equals the nearest to the midpoint; again for parts of more than ``room`` tokens."""
    cuts, stack = [0, len(strength) - 1], [(0, len(strength) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= room:
            continue
        middle, reach = (lo + hi) / 2, max(1, (hi - lo) // 4)
        around = np.arange(max(lo + 1, int(middle - reach)), min(hi, int(middle + reach) + 1))
        if not (strength[around] >= 0).any():
            around = np.arange(lo + 1, hi)
            if not (strength[around] >= 0).any():
                continue  # one character of more tokens than fit
        best = around[np.lexsort((np.abs(around - middle), -strength[around]))[0]]
        cuts.append(int(best))
        stack += [(lo, int(best)), (int(best), hi)]
    return sorted(cuts)


def split_text(tokenizer: Tokenizer, text: str, max_tokens: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(first token, end token, tokens shared with the piece before, text) of each piece; one piece if the text fits."""
    ids = np.array(tokenizer.encode(text), np.int32)
    data = text.encode("utf-8", "replace")
    at = np.concatenate(([0], np.cumsum([len(tokenizer.bytes_of[i]) for i in ids.tolist()]))).astype(np.int64)
    if len(ids) <= max_tokens:
        return [(0, len(ids), 0, text)]
    strength = strengths(data, at)
    pieces = []
    cuts = bisect(strength, max_tokens - overlap - SLACK)
    for lo, hi in zip(cuts, cuts[1:]):
        begin = max(0, lo - overlap) if lo else 0
        while strength[begin] < 0:
            begin -= 1
        pieces.append((begin, hi, lo - begin, data[at[begin] : at[hi]].decode()))
    return pieces


def split_oversized(docs: DataFrame, max_tokens: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE) -> DataFrame:
    """(id, piece_no, pieces, first_token, end_token, overlap, text) of every row whose text has more than max_tokens tokens, pieces numbered from 1.

    No piece has more than max_tokens tokens. A piece begins ``overlap`` tokens before the end of the
    one before it, or up to three more if a character would be cut. Null and empty texts, and texts
    that fit, give no row. A text of no more bytes than max_tokens fits (a token has one byte at
    least) and is not sent to Python.
    """
    if not 0 <= overlap < max_tokens - SLACK - 1:
        raise ValueError("the overlap leaves no room for new tokens")
    get = ship_tokenizer(docs, tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        t = get()

        def each(batch):
            for _id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = split_text(t, text, max_tokens, overlap)
                if len(pieces) > 1:
                    yield {
                        "_id": [_id] * len(pieces),
                        "piece_no": list(range(1, len(pieces) + 1)),
                        "pieces": [len(pieces)] * len(pieces),
                        **{name: [p[k] for p in pieces] for k, name in enumerate(("first_token", "end_token", "overlap", "text"))},
                    }

        return each

    long = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.octet_length("_text") > max_tokens)
    return map_batches(long, make, f"_id {kind}, piece_no int, pieces int, first_token int, end_token int, overlap int, text string").withColumnRenamed("_id", id_col)
