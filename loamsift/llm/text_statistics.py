"""Statistics of documents against their language's distribution, by mergeable quantile sketches.

The share of running text in a body has two modes in a crawl, pages of prose and pages of lists, tables
and junk, so its lower tail is cut where the language's own distribution divides best (the split of the
sketch's quantiles with the largest variance between its parts), not at a number given beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statistics that profiles gives and that have a distribution in each language.
STATISTICS = ("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "prose")
#: Percentiles are read from the quantiles of these ranks.
_RANKS = [k / 100 for k in range(101)]
#: Share of a distribution's variance that lies between its two parts, above which it has two modes: a normal one has 0.64, an even one 0.75.
TWO_MODES = 0.8


def _at_most(value):
    return lambda x: x <= value


def quantile_sketches(rows: DataFrame, by: str, statistics: tuple[str, ...] = STATISTICS) -> DataFrame:
    """One KLL sketch of each statistic for each value of ``by``; sketches of parts of the data merge into that of the whole."""
    return rows.groupBy(by).agg(*(F.kll_sketch_agg_double(s).alias(s) for s in statistics), F.count("*").alias("documents"))


def merged_sketches(sketches: DataFrame, by: str | None = None, statistics: tuple[str, ...] = STATISTICS) -> DataFrame:
    """Sketches of several parts (days, sources, languages) as one for each value of ``by``, or one of all."""
    return sketches.groupBy(*([by] if by else [])).agg(*(F.kll_merge_agg_double(s).alias(s) for s in statistics), F.sum("documents").alias("documents"))


def _quantiles(sketches: DataFrame, statistics: tuple[str, ...]) -> list:
    ranks = F.array(*map(F.lit, _RANKS))
    return [F.kll_sketch_get_quantile_double(s, ranks).alias(f"_q_{s}") for s in statistics]


def _mean(values):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def two_mode_split(quantiles):
    """(share, cut, low, high): of all splits of evenly spaced quantiles the one with the largest variance between its parts, as a share of the whole variance; the midpoint between the means of the parts; and these means."""
    middle = _mean(quantiles)
    whole = F.aggregate(quantiles, F.lit(0.0), lambda a, x: a + (x - middle) * (x - middle)) / F.size(quantiles)

    def split(k):
        low, high = _mean(F.slice(quantiles, F.lit(1), k)), _mean(F.slice(quantiles, k + 1, F.size(quantiles) - k))
        p = k / F.size(quantiles)
        between = p * (1 - p) * (high - low) * (high - low)
        return F.struct(F.coalesce(between / F.nullif(whole, F.lit(0.0)), F.lit(0.0)).alias("share"), ((low + high) / 2).alias("cut"), low.alias("low"), high.alias("high"))

    return F.array_max(F.transform(F.sequence(F.lit(1), F.size(quantiles) - 1), split))


def cut_offs(sketches: DataFrame, by: str, statistic: str = "prose") -> DataFrame:
    """(by, cut_off): where the statistic divides in two in each language.

    A language that shows one mode only, or two on one side of where all languages together divide, is
    judged by these, and so is one of a handful of pages or without a page of the rarer kind. cut_off is
    null where neither divides.
    """
    one = lambda df: two_mode_split(_quantiles(df, (statistic,))[0])
    merged = merged_sketches(sketches.select(statistic, "documents"), None, (statistic,)).where("documents > 0")
    of_all = merged.select(one(merged).alias("x")).first()  # one row, whatever the documents
    every = F.lit(of_all.x.cut if of_all and of_all.x.share >= TWO_MODES else None).cast("double")
    x = F.col("_x")
    apart = every.isNull() | every.between(x["low"], x["high"])
    return sketches.select(by, one(sketches).alias("_x")).select(by, F.coalesce(F.when((x["share"] >= TWO_MODES) & apart, x["cut"]), every).alias("cut_off"))


def against_distribution(rows: DataFrame, sketches: DataFrame, by: str, statistics: tuple[str, ...] = STATISTICS) -> DataFrame:
    """rows with cut_off, and for each statistic s s_percentile (0 to 1) and s_z: distance from the median in units of its spread.

    The spread of either side is the distance from the median to the tenth or ninetieth percentile,
    / 1.2816; where that is 0 the further percentiles take its place, and z is 0 where all are equal.

    sketches has a row for each value of ``by`` and is broadcast: the values are languages.
    """
    table = sketches.select(F.col(by).alias("_by"), *_quantiles(sketches, statistics))
    cuts = cut_offs(sketches, by).withColumnRenamed(by, "_by_cut")
    table = table.join(cuts, table["_by"].eqNullSafe(cuts["_by_cut"])).drop("_by_cut")
    joined = rows.join(F.broadcast(table), rows[by].eqNullSafe(table["_by"]), "left")
    columns = {}
    for s in statistics:
        q = F.col(f"_q_{s}")
        spread = lambda side: F.coalesce(*(F.nullif(F.abs(q[50] - q[side(d)]), F.lit(0.0)) / z for d, z in ((40, 1.2816), (45, 1.6449), (49, 2.3263), (50, 3.0))))  # noqa: B023, E731
        below, above = spread(lambda d: 50 - d), spread(lambda d: 50 + d)
        away = F.col(s) - q[50]
        columns[f"{s}_z"] = F.coalesce(F.when(away < 0, away / below).when(away > 0, away / above), F.lit(0.0))
        columns[f"{s}_percentile"] = F.size(F.filter(q, _at_most(F.col(s)))) / len(_RANKS)
    return joined.withColumns(columns).drop("_by", *(f"_q_{s}" for s in statistics))


def not_prose(rows: DataFrame, spam: float = 0.5) -> DataFrame:
    """Rows of against_distribution in the lower mode of the share of running text of their language, and spam pages (see spam_pages).

    Where no distribution has two modes there is no tail, and spam pages are left.
    """
    return rows.where(F.coalesce(F.col("prose") < F.col("cut_off"), F.lit(False)) | (F.col("keywords") + F.col("listed") >= spam))
