"""Statistics of bodies and spam pages on pages made here."""

import random

import pytest

from loamsift.llm import spam_pages as sp
from loamsift.llm import text_statistics as ts
from loamsift.llm.chars import Block
from loamsift.llm.line_classifier import LineModel
from loamsift.llm.line_shapes import LineShapes

PRODUCTS = ["yoga mat", "winter jacket", "desk lamp", "phone case"]
ADS = ["cheap", "best", "low price", "free shipping"]
NOUNS = ["bridge", "garden", "teacher", "river", "engine", "letter", "window", "market"]


def pages():
    rng = random.Random(6)
    prose = lambda: ". ".join(f"The {rng.choice(NOUNS)} of the old {rng.choice(NOUNS)} was seen by a {rng.choice(NOUNS)} in {rng.randint(1900, 2000)}" for _ in range(8)) + "."
    out = []
    for i in range(60):
        out.append((i, f"h{i % 30}", "en", "Title\n" + "\n".join(prose() for _ in range(3))))
    for i in range(60, 80):
        row = lambda: " ".join(f"{rng.choice(ADS)} Brand{chr(97 + i % 20)}ova {rng.choice(PRODUCTS)}" for _ in range(12))
        out.append((i, f"s{i}", "en", "Title\n" + "\n".join(row() for _ in range(5))))
    out.append((80, "x", "en", "Links\n" + "\n".join(f"http://site{k}.test/page?id={k}" for k in range(20))))
    out.append((81, "x", "en", "Links\n" + "\n".join(f"Page {k} (http://site{k}.test/p): The {rng.choice(NOUNS)} of the town was closed again." for k in range(9))))
    out.append((82, "x", "en", "Tags\n" + "\n".join(" ".join(f"#best{rng.choice(NOUNS)}shop" for _ in range(9)) for _ in range(5))))
    out.append((83, "x", "en", "Figures\n" + "\n".join(" ".join(str(rng.randint(0, 9999)) for _ in range(8)) for _ in range(12))))
    out.append((84, "x", "en", "List\n" + "\n".join(f"- the {rng.choice(NOUNS)} number {k}" for k in range(20))))
    out.append((85, "x", "en", "Code\n" + "\n".join(f"var x{k} = y[{k}];\nif (a != null) {{ f(a); }}" for k in range(12))))
    out.append((86, "x", "en", "Prose\nyoga mat, desk lamp: " + prose() + "\n" + prose()))
    return out


@pytest.fixture(scope="module")
def profiled(spark):
    df = spark.createDataFrame(pages(), "doc_id long, host string, lang string, text string").repartition(4)
    return sp.profiles(df, LineModel.neutral(), sp.advertising_phrases(df), {"en": {"the", "of", "was", "a", "by", "in"}}, keep=("lang",)).cache()


def test_spam(profiled):
    assert {r.doc_id for r in sp.spam_pages(profiled).collect()} == {*range(60, 80), 80, 82}


def hashes(text):
    block = Block([text])
    return set(sp.Phrases(block, LineShapes(block)).hash.view("int64").tolist())


@pytest.mark.parametrize("hosts", [3, 10, 100, 1000])
def test_rings_of_hosts_among_others(spark, hosts):
    """A campaign of few or many hosts among 1000 others, the pages of which have rows of their own."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows = [(i, f"h{i}", "\n".join(" ".join(word() for _ in range(8)) for _ in range(3))) for i in range(1000)]
    rows += [(1000 + i, f"s{i}", "\n".join(f"cheap {word()} yoga mat best {word()} desk lamp" for _ in range(3))) for i in range(hosts)]
    rows += [(5000 + i, "one", f"only one host has these words {i % 2}") for i in range(9)]
    found = {r.phrase for r in sp.advertising_phrases(spark.createDataFrame(rows, "doc_id long, host string, text string")).collect()}
    assert hashes("cheap xx yoga") & found and hashes("best xx desk") & found
    assert not hashes("only one host has these words") & found


def test_ordinary_phrases_do_not_advertise(spark):
    row = "a view over the harbour wall at night"
    rows = [(i, f"h{i}", f"{row}\n{row} again and again") for i in range(5)] + [(10 + i, f"h{i}", f"There was {row}. It was seen by all.") for i in range(20)]
    assert not {r.phrase for r in sp.advertising_phrases(spark.createDataFrame(rows, "doc_id long, host string, text string")).collect()} & hashes(row)


def test_short_lines_that_repeat_are_read_as_one():
    menu = "\n".join(["home", "about us", "news today", "our shop", "contact form", "search", "archive", "help", "sign in"])
    keywords = "\n".join(f"{a} yoga mat" for a in ("cheap", "best", "buy", "new", "top", "sale", "online", "pink", "blue"))
    for text, rows in ((menu, 0), (keywords, 9), (keywords.replace("mat", "mat!"), 0)):
        block = Block([text])
        assert sp.Phrases(block, LineShapes(block)).rows.sum() == rows


def test_filter_lets_through_all_it_was_made_of(spark):
    import numpy as np

    from loamsift.llm import filters

    values = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)
    bits = filters.filter_of(spark.createDataFrame([(int(v),) for v in values], "h long"), "h")
    assert filters.maybe_in(bits, values.view(np.uint64)).all()
    assert filters.maybe_in(bits, np.random.default_rng(4).integers(0, 2**63 - 1, 5000).astype(np.uint64)).mean() < 0.01
    assert not filters.filter_of(spark.createDataFrame([], "h long"), "h").any()


def test_not_prose(profiled):
    flagged = ts.not_prose(ts.against_distribution(profiled, ts.quantile_sketches(profiled, "lang"), "lang"))
    assert {r.doc_id for r in flagged.collect()} == {*range(60, 80), 80, 82, 83, 84, 85}


def distribution(spark, rows):
    """rows: (doc_id, lang, prose, keywords, listed)."""
    names = ("doc_id", "lang", "prose", "keywords", "listed", *(s for s in ts.STATISTICS if s != "prose"))
    ddl = ", ".join(f"{n} {'long' if n == 'doc_id' else 'string' if n == 'lang' else 'double'}" for n in names)
    df = spark.createDataFrame([(*r, *[1.0] * 5) for r in rows], ddl)
    return ts.against_distribution(df, ts.quantile_sketches(df, "lang"), "lang")


def test_not_prose_where_most_of_a_language_is_not(spark):
    rows = [(i, "de", 0.0 if i < 70 else 1.0, 0.0, 0.0) for i in range(100)] + [(100 + i, "en", p, 0.0, 0.0) for i, p in enumerate([0.7, 0.85, 0.95] * 20 + [0.3])]
    flagged = ts.not_prose(distribution(spark, [*rows, (200, "en", 0.6, 0.3, 0.2)]))
    assert {r.doc_id for r in flagged.collect()} == {*range(70), 160, 200}


def test_a_language_has_its_own_cut(spark):
    cut = lambda low, high: {r.lang: r.cut_off for r in distribution(spark, [(i, lang, a if i % 4 == 0 else b, 0.0, 0.0) for lang, (a, b) in {"en": (0.05, 0.95), "de": (low, high)}.items() for i in range(200)]).collect()}
    one, two = cut(0.05, 0.95), cut(0.3, 0.9)
    assert abs(one["en"] - 0.5) < 0.01 and abs(two["en"] - 0.5) < 0.01
    assert abs(one["de"] - 0.5) < 0.01 and abs(two["de"] - 0.6) < 0.01
    assert {r.cut_off for r in distribution(spark, [(i, "en", 0.9, 0.0, 0.0) for i in range(50)]).collect()} == {None}


def test_statistics(profiled, spark):
    row = {r.doc_id: r for r in profiled.collect()}
    assert row[0].prose == 1 and row[0].common_words > 0.3 and 3 < row[0].mean_word_length < 6 and row[0].punctuated_lines == 1
    assert row[83].words == 0 and row[83].other == 1
    both = ts.merged_sketches(ts.quantile_sketches(profiled.where("doc_id < 30"), "lang").unionByName(ts.quantile_sketches(profiled.where("doc_id >= 30"), "lang")), "lang")
    got = ts.against_distribution(profiled, both, "lang").collect()
    ordered = sorted(r.words for r in got)
    for r in got:
        assert abs(r.words_percentile - sum(x <= r.words for x in ordered) / len(ordered)) < 0.05


def test_line_counts():
    block = Block(["ab 1c\n\nx  y\n", "", "z9\n가나", "다 1", "x"])
    c = LineShapes(block)
    assert c.first.tolist() == [0, 4, 5, 7, 8]
    assert c.chars.tolist() == [5, 0, 4, 0, 0, 2, 2, 3, 1]
    assert c.letters.tolist() == [3, 0, 2, 0, 0, 1, 2, 1, 1] and c.tokens.tolist() == [2, 0, 2, 0, 0, 1, 1, 2, 1]
    assert c.runs.tolist() == [2, 0, 2, 0, 0, 1, 1, 1, 1] and c.meet.tolist() == [1, 0, 0, 0, 0, 1, 0, 0, 0]
    assert c.hangul.tolist()[-3:] == [True, True, False]
    assert c.ended.tolist() == [False] * 9 and [chr(x) for x in c.head if x] == list("axz가다x") and [chr(x) for x in c.tail if x] == list("cy9나1x")
