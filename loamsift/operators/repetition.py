"""Repetition within documents, as columns: a document is measured where it lies, without a shuffle.

Words and segments come from built-in expressions as arrays. Counting equal n-grams of an array has no
built-in that is not quadratic or needs rows and an exchange for each word and n, so the arrays go to
Arrow functions that count a whole batch of documents by array operations: n-grams are numbered by
sorting pairs (number of the first n - 1 words, last word), which is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from ..functions.text import paragraphs, split_words

# The largest repeated share that passes.
SEGMENT_LIMITS = {"line_count": 0.3, "paragraph_count": 0.3, "line_chars": 0.2, "paragraph_chars": 0.2}
NGRAM_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16, 5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
_TOP = (2, 3, 4)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Numbers and lengths of the strings of all lists, the row of each, and how many rows; null lists are empty."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    encoded = lists.flatten().dictionary_encode()
    encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
    ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(encoded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, chars[ids] if len(ids) else ids, np.repeat(np.arange(len(sizes)), sizes), len(sizes)


def ngram_share_table(words: pa.Array, sizes: list[int]) -> np.ndarray:
    """Rows x sizes: repeated shares, nan where a row has fewer words."""
    ids, chars, row, rows = _flat(words)
    out = np.full((rows, len(sizes)), np.nan)
    if not len(ids):
        return out
    total = np.maximum(1, np.bincount(row, chars, rows))
    before = np.concatenate(([0], np.cumsum(chars)))
    rank, base = ids, int(ids.max()) + 1
    for n in range(1, max(sizes) + 1):
        if n > 1:
            m = len(ids) - n + 1
            if m <= 0:
                break
            at = np.flatnonzero(row[:m] == row[n - 1 :])
            grams, inverse, times = np.unique(rank[at] * base + ids[at + n - 1], return_inverse=True, return_counts=True)
            rank = np.zeros(len(ids), np.int64)
            rank[at] = inverse
        if n not in sizes or n < 2 or not len(at):
            continue
        # equal n-grams of different rows are different
        _, place, same = np.unique(row[at] * (len(grams) + 1) + rank[at], return_inverse=True, return_counts=True)
        times = same[place]
        of = row[at]
        heads = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        present = of[heads]
        most = np.maximum.reduceat(times, heads)
        if n in _TOP:
            length = before[at + n] - before[at]
            longest = np.maximum.reduceat(np.where(times == np.repeat(most, np.diff(np.append(heads, len(at)))), length, 0), heads)
            share = most * longest / total[present]
        else:
            edge = np.zeros(len(ids) + 1, np.int64)
            repeated = at[times > 1]
            np.add.at(edge, repeated, 1)
            np.add.at(edge, repeated + n, -1)
            share = np.bincount(row, np.where(np.cumsum(edge)[:-1] > 0, chars, 0), rows)[present] / total[present]
        out[present, sizes.index(n)] = np.where(most == 1, 0.0, share)
    return out


def segment_share_table(segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of segments of each row, and the shares of them and of their characters in those that occur more than once."""
    ids, chars, row, rows = _flat(segments)
    count = np.bincount(row, minlength=rows) if len(ids) else np.zeros(rows, np.int64)
    if not len(ids):
        return count, np.zeros(rows), np.zeros(rows)
    _, place, times = np.unique(row * (int(ids.max()) + 1) + ids, return_inverse=True, return_counts=True)
    again = times[place] > 1
    return count, np.bincount(row, again, rows) / np.maximum(1, count), np.bincount(row, again * chars, rows) / np.maximum(1, np.bincount(row, chars, rows))


def ngram_shares(words: Column, sizes: list[int]) -> Column:
    """The repeated share for each size, null for more words than there are.

    For sizes up to 4 the share of the word characters that the most frequent n-gram takes (of equals
    the longest), 0 if it occurs once; above, the share of them in words that any repeated n-gram covers.
    """

    @arrow_udf(ArrayType(DoubleType()))
    def shares(lists: pa.Array) -> pa.Array:
        table = ngram_share_table(lists, sizes)
        flat = pa.array(table.ravel(), pa.float64(), mask=np.isnan(table.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * len(sizes), pa.int32()), flat)

    return shares(words)


@arrow_udf(StructType([StructField("segments", DoubleType()), StructField("count_share", DoubleType()), StructField("char_share", DoubleType())]))
def segment_shares(segments: pa.Array) -> pa.Array:
    count, by_count, by_chars = segment_share_table(segments)
    return pa.StructArray.from_arrays([pa.array(count, pa.float64()), pa.array(by_count), pa.array(by_chars)], ["segments", "count_share", "char_share"])


def counted_words(text: Column, word_model: str = "split") -> Column:
    """The words whose n-grams are counted: those that begin with a letter or number."""
    return split_words(text, word_model, ignore_punctuation=True)


def segment_repetition(docs: DataFrame, end: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segments, count_share, char_share) of the non-blank segments. Documents without segments have no row."""
    found = docs.select(id_col, segment_shares(paragraphs(F.col(text_col), end)).alias("x")).where("x.segments > 0")
    return found.select(id_col, F.col("x.segments").cast("long").alias("segments"), "x.count_share", "x.char_share")


def ngram_repetition(docs: DataFrame, sizes: list[int], id_col: str = "doc_id", text_col: str = "text", word_model: str = "split") -> DataFrame:
    """(id, n, share) for documents of n words or more; see ngram_shares."""
    found = docs.select(id_col, ngram_shares(counted_words(F.col(text_col), word_model), sizes).alias("shares"))
    each = found.select(id_col, F.explode(F.arrays_zip(F.array(*map(F.lit, sizes)).alias("n"), F.col("shares").alias("share"))).alias("x"))
    return each.select(id_col, "x.n", "x.share").where("share is not null")


def _splitter(word_model: str):
    """A function from a text to the words whose n-grams are counted."""
    if word_model == "split":
        split = str.split
    elif word_model == "fasttext":
        import re

        split = re.compile("[ \n\r\t\x0b\f\x00]+").split
    elif word_model == "uniseg":
        import regex

        split = regex.compile(r"(?V1w)\b").split
    else:
        raise ValueError(f"no such word model: {word_model}")
    return lambda text: [w for w in split(text) if w and w[0].isalnum()]


def _lists(lists: list[list[str]]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array([w for x in lists for w in x], pa.string()))


def passes(text: Column, word_model: str = "uniseg", paragraphs_too: bool = True) -> Column:
    """Whether a text is within all limits for lines, paragraphs and n-grams of 2 to 10 words; null and empty texts are not.

    Only the text goes to Python, once; it is cut into lines, paragraphs and words there.
    """
    limits = np.array(list(NGRAM_LIMITS.values()))
    sizes = list(NGRAM_LIMITS)

    @arrow_udf(BooleanType())
    def pass_all(texts: pa.Array) -> pa.Array:
        words_of = _splitter(word_model)
        some = [t or "" for t in texts.to_pylist()]
        ok = np.array([t != "" for t in some], bool)
        for end in ("\n", "\n\n") if paragraphs_too else ("\n",):
            count, by_count, by_chars = segment_share_table(_lists([[x for x in t.split(end) if x.strip()] for t in some]))
            ok &= (count <= 1) | ((by_count <= SEGMENT_LIMITS["line_count"]) & (by_chars <= SEGMENT_LIMITS["line_chars"]))
        table = ngram_share_table(_lists([words_of(t) if good else [] for t, good in zip(some, ok)]), sizes)
        return pa.array(ok & (np.isnan(table) | (table <= limits)).all(axis=1))

    return pass_all(text)


def repetition_verdict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_model: str = "uniseg", paragraphs_too: bool = True) -> DataFrame:
    """(id, passes) for every document."""
    return docs.select(id_col, passes(F.col(text_col), word_model, paragraphs_too).alias("passes"))
