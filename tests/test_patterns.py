"""Line patterns against masks of the published patterns and against Python's re on random colours."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loamsift.operators import patterns

# Colours and the lines kept.
PLD = {
    "g": ".", "gg": "KK", "gyg": "...", "ggyg": "KK..", "ggygg": "KKKKK", "ggyyyyygg": "KKKKKKKKK", "ggrrrgg": "KKKKKKK", "yrgg": "..KK",
    "ggrrrrgg": "KK....KK", "ggygrrrrgg": "KK......KK", "ggygygg": "KKKKKKK", "ggyyyyygrgg": "KK.......KK", "ggyyyyygygg": "KKKKKKKKKKK",
    "gggygyygrgggyyyyyrgg": "KKKKKKKKKKKK......KK", "ggyyyyrgg": "KK.....KK", "rrrr": "....",
}
PTF = {
    "y": (".", ".", "."), "gyg": ("KKK", "KKK", "KKK"), "gyyg": ("K..K", "KKKK", "KKKK"), "gyyyyg": ("K....K", "K....K", "KKKKKK"),
    "ygyyygy": (".K...K.", ".KKKKK.", ".KKKKK."), "gyyyyyyg": ("K......K",) * 3, "gygyyyyg": ("KKK....K", "KKK....K", "KKKKKKKK"),
}


def masks(spark, colours, make):
    rows = spark.createDataFrame([(c,) for c in colours], "c string").select("c", make(F.col("c")).alias("m")).collect()
    return {r.c: r.m.replace("1", "K").replace("0", ".") for r in rows}


def spans(colours, expressions):
    kept = ["."] * len(colours)
    for e in expressions:
        for m in re.finditer(e, colours):
            kept[m.start() : m.end()] = "K" * (m.end() - m.start())
    return "".join(kept)


def test_published_masks(spark):
    assert masks(spark, PLD, patterns.pld_mask) == PLD
    for k, at in ((1, 0), (3, 1), (5, 2)):
        assert masks(spark, PTF, lambda c, k=k: patterns.ptf_mask(c, k)) == {c: m[at] for c, m in PTF.items()}


def test_random_colours(spark):
    rng = random.Random(1)
    some = {"".join(rng.choices("gyr", (5, 3, 2), k=rng.randint(1, 40))) for _ in range(3000)}
    assert masks(spark, some, patterns.pld_mask) == {c: spans(c, ["g{2,}", "g{2,}(y+g{1,})+g", "g{2,}([yr]{0,3}g{1,})+g"]) for c in some}
    two = {c.replace("r", "y") for c in some}
    for k in (1, 3, 7):
        assert masks(spark, two, lambda c, k=k: patterns.ptf_mask(c, k)) == {c: spans(c, ["g+", "g+([yr]{0,%d}g+)+" % k]) for c in two}


def test_long_documents_do_not_recurse(spark):
    long = "gg" + "ygr" * 40_000 + "gg"
    assert masks(spark, [long], patterns.pld_mask)[long].startswith("KK")


def test_colours(spark):
    rows = spark.createDataFrame([(["{", " } ", "", "a", "b", "c", "d"], [0, 10_000, 2, 1000, 1001, 1, None])], "lines array<string>, n array<int>")
    assert rows.select(patterns.colours(F.col("lines"), F.col("n"))).first()[0] == "yyyyrgg"


@pytest.mark.parametrize("lines, counts, left", [(["a.", "b", "c!"], [1, 5, 1], "a.\nb\nc!"), (["x", "y"], [1, 1], None)])
def test_both_patterns(spark, lines, counts, left):
    rows = spark.createDataFrame([(1, "\n".join(lines), counts)], "doc_id int, text string, count array<int>")
    out = patterns.extracted(patterns.ptf(patterns.ld(patterns.counted(rows), 100)), "doc_id").collect()
    assert [r.text for r in out] == ([left] if left else [])


def test_rows_that_do_not_match_are_passed_over(spark):
    rows = spark.createDataFrame([(1, None, [1]), (2, "", []), (3, "a\nb", [1]), (4, "a", None), (5, "a", [1])], "doc_id int, text string, count array<int>")
    assert [r.doc_id for r in patterns.counted(rows).collect()] == [5]


def test_masks_of_the_callers_own(spark):
    mask = lambda colours, *expressions: spark.createDataFrame([(colours,)], "c string").select(patterns.pattern_mask(F.col("c"), *expressions).alias("m")).first().m
    for colours in ("", "r", "rrr", "grrrrgyyg", "yyrrrgg", "ggyrgg"):
        for expressions in (("r{3,}",), ("r{3,}", "y{2,}"), ("g+[yr]*g+",)):
            want = ["0"] * len(colours)
            for e in expressions:
                for m in re.finditer(e, colours):
                    want[m.start() : m.end()] = "1" * (m.end() - m.start())
            assert mask(colours, *expressions) == "".join(want), (colours, expressions)
