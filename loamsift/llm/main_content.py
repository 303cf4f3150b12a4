"""The main body of a page by minimum-cut labelling of its lines.

Every non-blank line is a node. A fitted classifier (line_classifier) turns words, shape, place and, where
it is known, the number of documents that hold the line into log odds, which are a capacity to the
source (body) or to the sink (furniture). Lines one and two apart are joined by edges whose weights are
fitted too: stronger within one block of lines and between lines of one shape, weaker across blank
lines, for a page's structure is lost in its text but for these. The minimum cut is the labelling of
least cost. Lines whose own evidence outweighs all their edges have the same label in every minimum
cut; they are fixed first, over a whole block of pages by array operations, and max-flow is left with
the few lines in doubt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .arrow import map_batches
from .chars import blocks
from .language_labels import plain
from .least_cut import least_cut
from .line_classifier import MAX_PAGES, LineModel, PageLines, edges

#: Longer pages are not sampled for the fit, so the sample's size has a bound.
MAX_SAMPLE_CHARS = 50_000


def body_mask(model: LineModel, lines: PageLines, counts: np.ndarray | None = None) -> np.ndarray:
    """True for the lines on the body's side of the least cut."""
    return least_cut(model.odds(lines, counts), *edges(lines, model.ties)) if len(lines.at) else np.zeros(0, bool)


def line_counts(lines: PageLines, counts: pa.ListArray) -> np.ndarray:
    """The count of each line, nan where there is none: null arrays, arrays of another length than the page has lines, and null elements."""
    counts = counts.combine_chunks() if isinstance(counts, pa.ChunkedArray) else counts
    have = np.bincount(lines.shapes.text, minlength=len(lines.shapes.first))
    sizes = counts.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = counts.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    fits = sizes == have
    every = np.full(len(lines.shapes.text), np.nan)
    every[np.repeat(fits, have)] = values[np.repeat(fits, np.maximum(sizes, 0))]
    return every[lines.at]


def latest_rows(rows: DataFrame, id_col: str, time_col: str, count_col: str = "count") -> DataFrame:
    """One row of each id, that of the latest time; of equal times one with counts is taken. Repeated rows go before the shuffle."""
    rest = [c for c in rows.columns if c != id_col]
    order = F.struct(F.col(time_col), F.col(count_col).isNotNull(), F.xxhash64(*(c for c in rest if not isinstance(rows.schema[c].dataType, MapType))))
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*rest), order).alias("_of_latest")).select(id_col, "_of_latest.*")


def fit_lines(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "count", max_pages: int = MAX_PAGES) -> LineModel:
    """The classifier of lines, fitted on at most max_pages pages in order of a seeded hash of their id, of at most MAX_SAMPLE_CHARS characters each.

    A page that comes more than once is taken once. Pages without counts, and those whose counts are
    not as many as their lines, are not taken.
    """
    order = F.xxhash64(F.col(id_col), F.lit(7))
    # so few rows are looked at that sorting them costs one task little, however many there are
    share = min(1.0, 2 * max_pages / max(1, rows.count()))
    fine = rows.where(F.pmod(order, F.lit(1 << 40)) <= int(share * (1 << 40))).where((F.length(text_col) <= MAX_SAMPLE_CHARS) & (F.size(F.split(text_col, "\n")) == F.size(count_col)))
    some = fine.select(order.alias("_order"), F.col(text_col).alias("_text"), F.col(count_col).cast("array<int>").alias("_count"))
    some = some.orderBy("_order", F.xxhash64("_text"), F.hash("_count")).limit(max_pages).toArrow()
    _, first = np.unique(some.column(0).to_numpy(), return_index=True)
    some = some.take(pa.array(first)).combine_chunks()
    if not len(some):
        return LineModel.neutral()
    counts = some.column(2).combine_chunks() if isinstance(some.column(2), pa.ChunkedArray) else some.column(2)
    parts = []
    for at, block in blocks([plain(t) for t in some.column(1).to_pylist()]):
        lines = PageLines(block, False)
        parts.append((lines, line_counts(lines, counts.slice(at, len(block.texts)))))
    return LineModel.fit(PageLines.joined([x for x, _ in parts]), np.concatenate([x for _, x in parts]))


def body_lines(pages: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "count", skip_title: bool = False) -> DataFrame:
    """(id, line_no) of the non-blank lines of each page's body, numbered from 1 by \\n.

    count_col: numbers of documents that hold the lines; a null array, one of another length than the
    lines, and null elements are passed over. Null and blank texts give no row. Rows with equal ids are
    labelled one by one. The model has a fixed size (some MB) and is broadcast.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def each(batch):
            for first, block in blocks([plain(t) for t in batch.column(1).to_pylist()]):
                n = len(block.texts)
                lines = PageLines(block, skip_title)
                body = body_mask(model, lines, line_counts(lines, batch.column(2).slice(first, n)))
                yield {"_id": batch.column(0).slice(first, n).take(pa.array(lines.page[body])), "line_no": lines.line_no[body] + 1}

        return each

    rows = pages.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (F.col(count_col).cast("array<int>") if count_col else F.lit(None).cast("array<int>")).alias("_count"))
    return map_batches(rows, make, f"_id {kind}, line_no long").withColumnRenamed("_id", id_col)
