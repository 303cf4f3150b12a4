"""Documents as lines, and how many documents hold a line.

Counts go by the normalized line. A document counts once for each of its distinct lines, so the first
aggregation is by distinct line inside the document, without a shuffle (``array_distinct``), and the
second partly runs before the shuffle: a line that stands in a third of all documents costs each task
one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines_of, normalize_for_dedup, saturating


def explode_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 1, line); null and empty texts have no line."""
    some = docs.where(f"{text_col} is not null and {text_col} <> ''")
    return some.select(id_col, F.posexplode(lines_of(F.col(text_col))).alias("n", "line")).select(id_col, (F.col("n") + 1).alias("line_no"), "line")


def without_title(lines: Column) -> Column:
    """All lines but the first."""
    return F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))


def document_frequency(docs: DataFrame, scope: list[str], text_col: str = "text") -> DataFrame:
    """(scope, line_key, df): number of documents of the scope that hold the line; every row is a document."""
    some = docs.where(f"{text_col} is not null and {text_col} <> ''")
    keys = F.array_distinct(F.transform(lines_of(F.col(text_col)), normalize_for_dedup))
    return some.select(*scope, F.explode(keys).alias("line_key")).groupBy(*scope, "line_key").agg(F.count("*").alias("df"))


def occurrences(docs: DataFrame, scope: list[str], text_col: str = "text") -> DataFrame:
    """(scope, line_key, occurrences)."""
    some = docs.where(f"{text_col} is not null and {text_col} <> ''")
    return some.select(*scope, F.explode(F.transform(lines_of(F.col(text_col)), normalize_for_dedup)).alias("line_key")).groupBy(*scope, "line_key").agg(F.count("*").alias("occurrences"))


def merged(maps: DataFrame, scope: list[str], value: str = "df") -> DataFrame:
    """Maps of finer scopes as one of the coarser scope, saturated at 65535."""
    return maps.groupBy(*scope, "line_key").agg(saturating(F.sum(value)).alias(value))


def at_least(maps: DataFrame, n: int, value: str = "df") -> DataFrame:
    return maps.where(F.col(value) >= n)


def seen_more_than(maps: DataFrame, n: int = 1, value: str = "df") -> DataFrame:
    return maps.where(F.col(value) > n)


def counted_lines(docs: DataFrame, frequency: DataFrame, scope: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, scope, lines, counts): the lines after the title, and for each the df of its key in the scope, 0 where it has none, 65535 at most.

    Documents of one line have none left and are dropped. Only keys travel to the join; ids are unique.
    """
    some = docs.where(F.col(text_col).contains("\n")).select(id_col, *scope, without_title(lines_of(F.col(text_col))).alias("lines"))
    wanted = some.select(id_col, *scope, F.posexplode(F.transform("lines", normalize_for_dedup)).alias("line_no", "line_key"))
    # lines without a count do not travel on; the lines of a key that a third of the documents have are split
    # over tasks by adaptive execution (an inner join against one row), which costs the other keys nothing
    found = wanted.join(frequency, [*scope, "line_key"]).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("line_no", saturating(F.col("df"))))).alias("_found"))
    counts = F.transform("lines", lambda x, i: F.coalesce(F.element_at("_found", i), F.lit(0)))
    return some.join(found, id_col, "left").select(id_col, *scope, "lines", counts.alias("counts"))


def count_info(docs: DataFrame, frequency: DataFrame, scope: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """counted_lines as (id, scope, text, count)."""
    return counted_lines(docs, frequency, scope, id_col, text_col).select(id_col, *scope, F.array_join("lines", "\n").alias("text"), F.col("counts").alias("count"))


def ends_in_punctuation(line: Column) -> Column:
    from ..functions.text import strip

    return F.substring(strip(line), -1, 1).isin(".", "?", "!", '"', "'")
