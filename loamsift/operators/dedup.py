"""Removing paragraphs and documents most of whose n-grams were seen before.

"Before" is the order of (document, paragraph), so the result does not depend on partitions; n-grams of
removed text count as seen. The first place of every n-gram is an aggregation that runs mostly before
its shuffle, and only n-grams of two places or more are joined with the places they stand in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count, words

def paragraph_ngrams(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", end: str | None = "\n", least: int = 1) -> DataFrame:
    """(id, p, ngrams, grams): number and hashes of the n-grams of words of each non-blank paragraph, repeated ones included.

    A paragraph of fewer than n words is one n-gram of all its words, and has none if it has fewer than
    ``least`` words. ``end`` None takes the whole text as one paragraph.
    """
    some = docs.where(F.col(text_col).isNotNull())
    parts = some.select(id_col, F.posexplode(F.split(F.col(text_col), end)).alias("p", "_part")) if end is not None else some.select(id_col, F.lit(0).alias("p"), F.col(text_col).alias("_part"))
    # exploding an array of one evaluates the words once, not again for each n-gram
    parts = parts.select(id_col, "p", F.explode(F.array(words(F.col("_part")))).alias("_w")).where(F.size("_w") >= max(1, least))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1)))
    return parts.select(id_col, "p", _ngrams(F.size("_w"), n, least).alias("ngrams"), F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, n))).alias("grams"))


def _ngrams(words_, n: int, least: int):
    return F.when(words_ >= max(1, least), F.greatest(words_ - n + 1, F.lit(1))).otherwise(0).cast("long")


def seen_ngrams(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", end: str | None = "\n", least: int = 1) -> DataFrame:
    """(id, p, seen): how many n-grams of each paragraph stand in an earlier paragraph, where some do."""
    parts = paragraph_ngrams(docs, n, id_col, text_col, end, least)
    place = F.struct(F.col(id_col), F.col("p"))
    once = parts.select(id_col, "p", F.explode(F.array_distinct("grams")).alias("gram"))
    first = once.groupBy("gram").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("gram", "first")
    every = parts.select(id_col, "p", F.explode("grams").alias("gram"))
    # the places of a hot n-gram are split over tasks by adaptive execution: the other side has one row of it
    return every.join(first, "gram").where(F.col("first") < place).groupBy(id_col, "p").agg(F.count("*").alias("seen"))


def seen_shares(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", end: str | None = "\n", least: int = 1) -> DataFrame:
    """(id, p, ngrams, seen): n-grams of each paragraph, and how many of them stand in an earlier paragraph."""
    parts = paragraph_ngrams(docs, n, id_col, text_col, end, least).select(id_col, "p", "ngrams")
    return parts.join(seen_ngrams(docs, n, id_col, text_col, end, least), [id_col, "p"], "left").select(id_col, "p", "ngrams", F.coalesce("seen", F.lit(0)).alias("seen"))


def _over(share, threshold: float, strict: bool):
    return share > threshold if strict else share >= threshold


#: What is removed: paragraphs, documents, or both, each by its share of n-grams seen before; exact: documents whose whole text was seen.
REMOVE = ("paragraph", "document", "both", "exact")


def drop_seen(
    docs: DataFrame, n: int = 13, threshold: float = 0.8, strict: bool = True, remove: str = "both", least: int = 1, id_col: str = "doc_id", text_col: str = "text", end: str = "\n"
) -> DataFrame:
    """docs without the paragraphs, and without the documents, more than ``threshold`` of whose n-grams were seen before.

    remove is one of REMOVE. Paragraphs of fewer than ``least`` words are passed over. Ids are unique;
    blank paragraphs stay; documents without a word stay as they are.
    """
    if remove not in REMOVE:
        raise ValueError(f"remove is none of {REMOVE}: {remove}")
    if remove == "exact":
        first = docs.where(F.col(text_col).isNotNull()).groupBy(F.xxhash64(text_col).alias("_h"), F.length(text_col).alias("_l"), F.sha1(text_col).alias("_s")).agg(F.min(id_col).alias(id_col)).select(id_col)
        return docs.where(F.col(text_col).isNotNull()).join(first, id_col, "left_semi").unionByName(docs.where(F.col(text_col).isNull()))
    seen = seen_ngrams(docs, n, id_col, text_col, end, least).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("p", "seen"))).alias("_seen"))
    joined = docs.join(seen, id_col, "left")
    # the n-grams of the paragraphs are counted again where the text is, for the documents that lose some
    ngrams = F.transform(F.split(F.col(text_col), end), lambda x: _ngrams(word_count(x), n, least))
    found = lambda i: F.coalesce(F.element_at("_seen", i), F.lit(0))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    lost = F.struct(F.transform(ngrams, lambda m, i: _over(found(i) / F.nullif(m, F.lit(0)), threshold, strict)).alias("parts"), (total(F.map_values("_seen")) / total(ngrams)).alias("share"))
    joined = joined.select(*docs.columns, F.explode(F.array(F.when(F.col("_seen").isNotNull(), lost))).alias("_lost"))
    if remove != "paragraph":
        joined = joined.where(F.col("_lost").isNull() | ~_over(F.col("_lost.share"), threshold, strict))
    if remove != "document":
        left = F.filter(F.split(F.col(text_col), end), lambda x, i: ~F.coalesce(F.get("_lost.parts", i), F.lit(False)))
        joined = joined.withColumn(text_col, F.when(F.exists("_lost.parts", lambda x: F.coalesce(x, F.lit(False))), F.array_join(left, end)).otherwise(F.col(text_col)))
    return joined.drop("_lost")
