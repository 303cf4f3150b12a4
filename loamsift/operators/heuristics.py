"""Document filters and line modifiers, as expressions; a filter is true for a document to keep."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, lines_of, strip, token_word_count, word_count, words
from .repetition import passes

# Words, marks and nouns that the filters look for.
STOP_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with"]
SYMBOLS = ["#", "...", ". . .", "…"]
BULLETS = ["●", "•", "*", "-"]
ELLIPSES = ["...", ". . .", "…"]
COUNTED = "likes|shares|comments|retweets|reposts|quotes|bookmarks|upvotes|downvotes|downloads|views|followers"
REMOVED = [("items in cart", "any"), ("Read more...", "suffix"), ("Sign-in", "prefix")]
#: Characters that are digits without being decimal ones: superscripts, subscripts, circled and parenthesized digits and the like.
OTHER_DIGITS = r"\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def page_length(text: Column, least: int = 50, most: int = 100_000) -> Column:
    return token_word_count(text).between(least, most)


def mean_word_length(text: Column) -> Column:
    """Characters for each word; null without words."""
    return F.length(F.regexp_replace(text, WS, "")) / F.nullif(word_count(text), F.lit(0))


def word_length(text: Column, least: float = 3, most: float = 10) -> Column:
    return F.coalesce(mean_word_length(text).between(least, most), F.lit(False))


def symbol_ratio_value(text: Column) -> Column:
    """Symbols for each word; null without words."""
    found = sum(((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s) for s in SYMBOLS), F.lit(0.0))
    return found / F.nullif(word_count(text), F.lit(0))


def symbol_ratio(text: Column, most: float = 0.1) -> Column:
    return F.coalesce(symbol_ratio_value(text) <= most, F.lit(False))


def _line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _bullet_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?<![^\n])[" + "".join(map(re.escape, BULLETS)) + "]"))


def bullet_share(text: Column) -> Column:
    return _bullet_lines(text) / _line_count(text)


def bullet_ratio(text: Column, most: float = 0.9) -> Column:
    return _bullet_lines(text) <= F.lit(most) * _line_count(text)


def _ellipsis_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?:" + "|".join(map(re.escape, ELLIPSES)) + r")(?![^\n])"))


def ellipsis_share(text: Column) -> Column:
    return _ellipsis_lines(text) / _line_count(text)


def ellipsis_ratio(text: Column, most: float = 0.3) -> Column:
    return _ellipsis_lines(text) <= F.lit(most) * _line_count(text)


def non_alphabetic_share(text: Column) -> Column:
    """Share of words without a letter; null without words."""
    return F.size(F.filter(words(text), lambda w: ~w.rlike(r"^[a-zA-Z]|\p{L}"))) / F.nullif(word_count(text), F.lit(0))


def alphabetic_words(text: Column, most: float = 0.2) -> Column:
    return F.coalesce(non_alphabetic_share(text) <= most, F.lit(False))


def stop_word_count(text: Column, unique: bool = False) -> Column:
    found = F.filter(words(F.lower(text)), lambda w: w.isin(STOP_WORDS))
    return F.size(F.array_distinct(found) if unique else found)


def stop_words(text: Column, least: int = 2, unique: bool = False) -> Column:
    return stop_word_count(text, unique) >= least


def _lines_where(text: Column, test) -> Column:
    return F.array_join(F.filter(lines_of(text), test), "\n")


def collapse_newlines(text: Column, most: int = 2) -> Column:
    return F.regexp_replace(text, f"\n{{{most + 1},}}", "\n" * most)


def _uppercase(line: Column, most: float = 0.5) -> Column:
    return F.regexp_count(line, F.lit(r"\p{IsUppercase}")) / F.length(line) > most


def _numeric(line: Column, most: float = 0.999999) -> Column:
    return F.regexp_count(line, F.lit(rf"[\p{{Nd}}{OTHER_DIGITS}]")) / F.length(line) > most


def _counter(line: Column) -> Column:
    return F.lower(line).rlike(rf"^[^\p{{L}}\p{{N}}_]*\p{{Nd}}(?:,|\.|\p{{Nd}})*(?:k|m|b)?{WS}+(?:{COUNTED})[^\p{{L}}\p{{N}}_]*\z")


def _of_words(line: Column, least: int = 2, most: int | None = None) -> Column:
    n = word_count(line)
    return n >= least if most is None else n.between(least, most)


def drop_uppercase_lines(text: Column, most: float = 0.5) -> Column:
    return _lines_where(text, lambda x: (x == "") | ~_uppercase(x, most))


def drop_numeric_lines(text: Column, most: float = 0.999999) -> Column:
    return _lines_where(text, lambda x: (x == "") | ~_numeric(x, most))


def drop_counter_lines(text: Column) -> Column:
    return _lines_where(text, lambda x: ~_counter(x))


def drop_short_lines(text: Column, least: int = 2, most: int | None = None) -> Column:
    """Lines of less than ``least`` or more than ``most`` words go; empty lines stay."""
    return _lines_where(text, lambda x: (x == "") | _of_words(x, least, most))


def _without_substring(lines: Column, substrings: str | list[str], location: str, max_words: int | None = 10, only_substring: bool = True, case_sensitive: bool = False) -> Column:
    found = "(?:" + "|".join(re.escape(s) for s in ([substrings] if isinstance(substrings, str) else substrings)) + ")"
    pattern = {"prefix": rf"^{found}{WS}?", "suffix": rf"{WS}?{found}\z", "any": rf"{WS}?{found}"}[location]
    pattern = pattern if case_sensitive else f"(?iu){pattern}"
    short = (lambda x: F.lit(True)) if max_words is None else lambda x: word_count(x) <= max_words
    # each array is named once: an expression named twice in a chain of these would be evaluated eight times
    hit = lambda x: x.rlike(pattern) & short(x)
    if not only_substring:
        return F.filter(lines, lambda x: ~hit(x))
    changed = F.transform(lines, lambda x: F.struct(x.alias("old"), F.when(hit(x), F.regexp_replace(x, pattern, "")).otherwise(x).alias("new")))
    stay = F.filter(changed, lambda z: (z["old"] == "") | ~z["new"].rlike(rf"^{WS}*\z") | ~short(z["old"]))
    return F.transform(stay, lambda z: z["new"])


def remove_substring(text: Column, substrings: str | list[str], location: str = "any", max_words: int | None = 10, only_substring: bool = True, case_sensitive: bool = False) -> Column:
    """Cut substrings, with one white space beside them, out of short lines; lines left blank by that go. With only_substring=False lines that hold one go as a whole."""
    return F.array_join(_without_substring(lines_of(text), substrings, location, max_words, only_substring, case_sensitive), "\n")


def modified(text: Column) -> Column:
    """All modifiers in their order, in one pass over the lines."""
    lines = F.filter(lines_of(collapse_newlines(text)), lambda x: (x == "") | (_of_words(x) & ~_uppercase(x) & ~_numeric(x) & ~_counter(x)))
    for substring, location in REMOVED:
        lines = _without_substring(lines, substring, location)
    return F.array_join(lines, "\n")


def removal_ratio(before: Column, after: Column) -> Column:
    """Share of the token words that are gone; null where there were none."""
    n = token_word_count(before)
    return (n - token_word_count(after)) / F.nullif(n, F.lit(0))


def cheap_filters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The filters that need one pass over a text, cheapest first."""
    t = F.col(text_col)
    return docs.where(has_text(t) & bullet_ratio(t) & ellipsis_ratio(t) & page_length(t) & word_length(t) & symbol_ratio(t) & alphabetic_words(t) & stop_words(t))


def heuristics(docs: DataFrame, text_col: str = "text", word_model: str = "uniseg") -> DataFrame:
    """Documents that pass all filters, with the text as the modifiers leave it, without those that lose more than a twentieth of their words or all text.

    Nothing is shuffled. The costly repetition test sees what the cheap filters leave.
    """
    some = cheap_filters(docs, text_col).where(passes(F.col(text_col), word_model))
    # exploding an array of one evaluates the modifiers once, for the test and the result
    stays = F.filter(
        F.array(F.struct(F.col(text_col).alias("old"), modified(F.col(text_col)).alias("new"))),
        lambda x: F.coalesce(removal_ratio(x["old"], x["new"]) <= 0.05, F.lit(True)) & (strip(x["new"]) != ""),
    )
    others = [c for c in docs.columns if c != text_col]
    return some.select(*others, F.explode(stays).alias("_x")).select(*(F.col("_x.new").alias(text_col) if c == text_col else c for c in docs.columns))
