"""Keeping lines by patterns over their colours, within a row: no shuffle, no regular expression that backtracks over a document.

A document's lines are coloured g, y or r. The colour string is cut into runs, each run is kept or
dropped as a whole, and the lines of the kept runs remain.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import experiment_name, lines_of, strip
from .lines import ends_in_punctuation


def colours(lines: Column, counts: Column, red: Column | int = 1000, green: Column | int = 1) -> Column:
    """r above red, y above green, else g, as a string; blank lines and single braces are y. Null counts are 0."""
    red, green = (x if isinstance(x, Column) else F.lit(x) for x in (red, green))

    def one(line, n):
        bare = strip(line)
        n = F.coalesce(n, F.lit(0))
        return F.when(bare.isin("", "{", "}"), "y").when(n > red, "r").when(n > green, "y").otherwise("g")

    return F.array_join(F.zip_with(lines, counts, one), "")


def ending_colours(lines: Column) -> Column:
    """g for lines that end in . ? ! " or ', else y."""
    return F.array_join(F.transform(lines, lambda x: F.when(ends_in_punctuation(x), "g").otherwise("y")), "")


def _mask(runs: Column, keep) -> Column:
    last = F.size(runs) - 1
    return F.array_join(F.transform(runs, lambda x, i: F.repeat(F.when(keep(x, i, last), "1").otherwise("0"), F.length(x))), "")


def pld_mask(colour: Column) -> Column:
    """1 for kept lines. Runs of two or more g are kept, and what lies between two such runs if it has no r, or no run of more than three lines that are not g."""
    pieces = F.split(F.regexp_replace(colour, "g{2,}", "|$0|"), "\\|", -1)  # at odd places the runs of g
    return _mask(pieces, lambda x, i, last: (i % 2 == 1) | ((i > 0) & (i < last) & (~x.contains("r") | ~x.rlike("[yr]{4}"))))


def ptf_mask(colour: Column, k: Column | int = 3) -> Column:
    """1 for kept lines: g, and runs of at most k others between two g."""
    k = k if isinstance(k, Column) else F.lit(k)
    runs = F.regexp_extract_all(colour, F.lit("g+|[^g]+"), F.lit(0))
    return _mask(runs, lambda x, i, last: x.startswith("g") | ((i > 0) & (i < last) & (F.length(x) <= k)))


def pattern_mask(colour: Column, *expressions: str) -> Column:
    """1 for the lines in a match of any of the caller's expressions over the colours (matches of one do not overlap)."""

    def one(expression: str) -> Column:
        pieces = F.split(F.regexp_replace(colour, expression, "|$0|"), "\\|", -1)  # at odd places the matches
        return F.array_join(F.transform(pieces, lambda x, i: F.repeat(F.when(i % 2 == 1, "1").otherwise("0"), F.length(x))), "")

    masks = [F.split(one(e), "(?!^)") for e in expressions]
    return F.array_join(functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)), masks), "")


def marked_lines(rows: DataFrame, colour: Callable[[Column, Column], Column], *expressions: str) -> DataFrame:
    """rows of ``counted`` with the lines in a match of an expression over a colouring of the caller's own, one letter a line."""
    return _with_lines(rows, kept(F.col("lines"), pattern_mask(colour(F.col("lines"), F.col("counts")), *expressions)))


def kept(lines: Column, mask: Column) -> Column:
    """Lines whose mask is 1."""
    pairs = F.zip_with(lines, F.split(mask, "(?!^)"), lambda x, m: F.struct(x.alias("line"), m.alias("keep")))
    return F.transform(F.filter(pairs, lambda z: z["keep"] == "1"), lambda z: z["line"])


def counted(rows: DataFrame, text_col: str = "text", count_col: str = "count") -> DataFrame:
    """Rows with ``lines`` and ``counts``: those whose text is not empty and whose counts are as many as its lines."""
    return rows.where(f"{text_col} is not null and {text_col} <> ''").withColumn("lines", lines_of(F.col(text_col))).where(F.size("lines") == F.size(count_col)).withColumn("counts", F.col(count_col))


def _with_lines(rows: DataFrame, lines: Column) -> DataFrame:
    """rows with other lines. Exploding an array of one is a barrier: the expression is evaluated once, not again in each later use of the column."""
    return rows.select(*(c for c in rows.columns if c != "lines"), F.explode(F.array(lines)).alias("lines"))


def ld(rows: DataFrame, threshold: int = 1) -> DataFrame:
    """Lines of at most ``threshold`` documents remain."""
    pairs = F.filter(F.arrays_zip("lines", "counts"), lambda z: F.coalesce(z["counts"], F.lit(0)) <= threshold)
    return _with_lines(rows, F.transform(pairs, lambda z: z["lines"]))


def pld(rows: DataFrame, red: Column | int = 1000, green: Column | int = 1) -> DataFrame:
    return _with_lines(rows, kept(F.col("lines"), pld_mask(colours(F.col("lines"), F.col("counts"), red, green))))


def ptf(rows: DataFrame, k: Column | int = 3) -> DataFrame:
    return _with_lines(rows, kept(F.col("lines"), ptf_mask(ending_colours(F.col("lines")), k)))


def grid(rows: DataFrame, red: list[int], green: list[int], k: list[int] | None = None) -> DataFrame:
    """One row for each document and combination of parameters (a few, written by hand), with red, green, k and the experiment's name."""
    names = ("red", "green", "k") if k is not None else ("red", "green")
    combined = [F.struct(*(F.lit(x).alias(n) for n, x in zip(names, values))) for values in itertools.product(red, green, *([k] if k is not None else []))]
    out = rows.withColumn("_grid", F.explode(F.array(*combined))).select(*rows.columns, *(F.col(f"_grid.{n}").alias(n) for n in names))
    return out.withColumn("experiment", experiment_name(*(F.col(n) for n in names)))


def extracted(rows: DataFrame, *columns: str) -> DataFrame:
    """The remaining lines as text; documents without any are dropped."""
    return rows.where(F.size("lines") > 0).select(*columns, F.array_join("lines", "\n").alias("text"))
