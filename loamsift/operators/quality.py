"""Languages, scores and statistics of documents and files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.text import flat, words

#: A function that loads a model and returns one from a series of texts to a series of scores; it runs once a task.
Scorer = Callable[[], Callable[[pd.Series], pd.Series]]


def scored_by(load: Scorer) -> Callable[[Column], Column]:
    """A model as a column function; the model is loaded once a task, and null texts score 0."""

    @pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in texts:
            out = model(batch.fillna("")).astype("float64")
            yield out.where(batch.notna(), 0.0)

    return score


def label_probability(load: Callable[[], object], label: str = "__label__hq", k: int = 2) -> Callable[[Column], Column]:
    """The probability that a classifier gives a label, as a column function: 0 where the label is not among its k best.

    load gives an object whose ``predict(text, k=k)`` returns labels and probabilities; it runs once a task.
    Line ends are blanks for it.
    """

    def model():
        classifier = load()

        def one(text: str) -> float:
            labels, scores = classifier.predict(text.replace("\n", " ").replace("\r", " "), k=k)
            return next((float(s) for x, s in zip(labels, scores) if x == label), 0.0)

        return lambda texts: texts.map(lambda t: one(t) if t else 0.0)

    return scored_by(model)


def hangul_share(text: Column) -> Column:
    """Share of Hangul syllables among the characters; null for null and empty texts."""
    return F.regexp_count(text, F.lit("[가-힣]")) / F.nullif(F.length(text), F.lit(0))


def korean(docs: DataFrame, text_col: str = "text", least: float = 0.1) -> DataFrame:
    return docs.where(hangul_share(F.col(text_col)) >= least)


def lexicon_language(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score): the language whose frequent words a text holds most of, and its share of all such words; texts without any have no row.

    lexicon: (lang, word), a small fixed table. Of equals the first code in alphabetical order.
    """
    by_word = F.broadcast(lexicon.groupBy("word").agg(F.collect_set("lang").alias("langs")))  # a small fixed table
    found = docs.select(id_col, F.explode(words(F.lower(flat(F.col(text_col))))).alias("word")).join(by_word, "word")
    tally = found.select(id_col, F.explode("langs").alias("lang")).groupBy(id_col, "lang").agg(F.count("*").alias("n"))
    best = F.max_by("lang", F.struct("n", F.expr("-ascii(lang)"), F.expr("-ascii(substr(lang, 2))")))
    return tally.groupBy(id_col).agg(best.alias("lang"), (F.max("n") / F.sum("n")).alias("score"))


def in_language(docs: DataFrame, labels: DataFrame, lang: str = "en", least: float = 0.65, id_col: str = "doc_id") -> DataFrame:
    """Documents whose label is ``lang`` with a score of ``least`` or more."""
    return docs.join(labels.where((F.col("lang") == lang) & (F.col("score") >= least)).select(id_col), id_col, "left_semi")


def with_quality(docs: DataFrame, score: Callable[[Column], Column], threshold: float = 0.018112, text_col: str = "text", score_col: str = "fasttext_score") -> DataFrame:
    """Documents scored at the threshold or above, with their score; the text is scored with its line ends as blanks. Null and empty texts go."""
    some = docs.where(F.col(text_col) != "")
    return some.withColumn(score_col, score(flat(F.col(text_col)))).where(F.col(score_col) >= threshold)


def file_statistics(rows: DataFrame, by: str, kept: Column, score: Column | None = None, malformed: Column | None = None) -> DataFrame:
    """Total, kept and filtered rows of each file and, where ``by`` is null, of all; with averages of the scores of either part, and how many lines were malformed (they count as filtered)."""
    columns = [F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("filtered")]
    if score is not None:
        columns += [F.avg(F.when(kept, score)).alias("avg_score_kept"), F.avg(F.when(~F.coalesce(kept, F.lit(False)), score)).alias("avg_score_filtered")]
    if malformed is not None:
        columns.append(F.count_if(malformed).alias("malformed"))
    return rows.rollup(by).agg(*columns)


def baseline_statistics(rows: DataFrame, by: str, kept: Column, text_col: str = "text") -> DataFrame:
    """Records and characters of each file, and of those that are kept."""
    chars = F.length(text_col)
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(kept).alias("count"), F.coalesce(F.sum(chars), F.lit(0)).alias("total_chars"), F.coalesce(F.sum(F.when(kept, chars)), F.lit(0)).alias("saved_chars"))
