"""Stages on streams of documents.

Everything here is a function of one row, or of one row and a table built in batch, so it runs on an
unbounded stream without state; counting lines in windows of event time is the one stage with state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines_of, normalize_data, normalize_for_dedup
from ..operators.heuristics import cheap_filters, modified, removal_ratio
from ..operators.patterns import counted, extracted, pld, ptf


def read_stream(spark: SparkSession, path: str, schema: str, files_each: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Filters and modifiers that look at one text alone, with the text normalized."""
    some = cheap_filters(docs, text_col).withColumn("_new", modified(F.col(text_col)))
    some = some.where(F.coalesce(removal_ratio(F.col(text_col), F.col("_new")) <= 0.05, F.lit(True)))
    return some.withColumn(text_col, normalize_data(F.col("_new"))).drop("_new")


def extracted_stream(rows: DataFrame, columns: list[str], red: int = 1000, green: int = 1, k: int = 3) -> DataFrame:
    """Line patterns over a stream of texts with counts."""
    return extracted(ptf(pld(counted(rows), red, green), k), *columns)


def windowed_frequency(docs: DataFrame, time_col: str, window: str = "1 day", late: str = "14 days", text_col: str = "text") -> DataFrame:
    """(window, line_key, df) of documents by the time they were crawled; rows later than ``late`` are not counted."""
    keys = F.array_distinct(F.transform(lines_of(F.col(text_col)), normalize_for_dedup))
    lines = docs.withWatermark(time_col, late).select(time_col, F.explode(keys).alias("line_key"))
    return lines.groupBy(F.window(time_col, window).alias("window"), "line_key").agg(F.count("*").alias("df"))
