"""A PySpark engine for curating web text into training corpora; operators are functions from DataFrames to DataFrames."""

from .operators.dedup import drop_seen
from .operators.heuristics import heuristics
from .operators.lines import count_info, document_frequency
from .operators.patterns import extracted, ld, pld, ptf
from .operators.quality import file_statistics, label_probability, scored_by, with_quality
from .operators.repetition import repetition_verdict
from .plans.pipelines import curation, english_baseline, extraction, korean_baseline
from .sources.records import read_json_lines, read_wet

__all__ = [
    "count_info", "curation", "document_frequency", "drop_seen", "english_baseline", "extracted", "extraction", "file_statistics", "heuristics", "korean_baseline", "label_probability", "ld", "pld", "ptf",
    "read_json_lines", "read_wet", "repetition_verdict", "scored_by", "with_quality",
]
