"""Whole pipelines: extraction of bodies from crawl records, and curation of extracted texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_data
from ..operators.dedup import drop_seen
from ..operators.heuristics import heuristics
from ..operators.lines import at_least, counted_lines, document_frequency
from ..operators.patterns import extracted, pld, ptf
from ..operators.quality import korean, with_quality
from ..sources.records import baseline


def english_baseline(records: DataFrame, is_english: Callable[[Column], Column]) -> DataFrame:
    """Conversion records in English, with normalized text."""
    return baseline(records).where(F.col("text") != "").where(is_english(F.col("text"))).withColumn("text", normalize_data(F.col("text")))


def korean_baseline(records: DataFrame) -> DataFrame:
    return korean(baseline(records))


def extraction(docs: DataFrame, scope: list[str], red: int = 1000, green: int = 1, k: int | None = 3, id_col: str = "doc_id") -> DataFrame:
    """(id, scope, text): lines counted over the scope, kept by both patterns; ``k`` None leaves out the second.

    A count of ``green`` or less colours a line as none does, so only the few lines of more documents are
    joined: most lines of a crawl stand in one.
    """
    frequency = at_least(document_frequency(docs, scope), green + 1)
    rows = pld(counted_lines(docs, frequency, scope, id_col), red, green)
    return extracted(rows if k is None else ptf(rows, k), id_col, *scope)


def archive_frequency(records: DataFrame, scope: list[str], is_english: Callable[[Column], Column] | None = None) -> DataFrame:
    """(scope, line_key, df) straight from crawl records, in English or, without a test for it, in Korean."""
    texts = korean_baseline(records) if is_english is None else english_baseline(records, is_english)
    return document_frequency(texts, scope)


def curation(docs: DataFrame, score: Callable[[Column], Column], threshold: float = 0.018112, id_col: str = "doc_id", word_model: str = "uniseg") -> DataFrame:
    """Heuristics, then removal of what was seen before, then the quality threshold."""
    return with_quality(drop_seen(heuristics(docs, word_model=word_model), id_col=id_col), score, threshold)
