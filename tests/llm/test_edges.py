"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from loamsift.llm import confusables, language_labels, main_content, near_duplicates, source_mixing, spam_pages, splitting, term_frequency, text_statistics, token_stream

SCHEMA = "doc_id long, text string, lang string, source string, host string, snapshot string, _id long, _text string, class string, bands string, tokens int, term string, n int, records int, label string, found int, words int, _x int"
LONG = ("Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 40 + "\n") * 40 + "x" * 9000


def rows():
    rest = ("en", "s", "h", "2031", 1, "t", "c", "b", 1, "t", 1, 1, "l", 1, 1, 1)
    texts = [None, "", " \n\t ", "\x00\x07", "a", "two words", "same text of many words here\nand a second line.", "same text of many words here\nand a second line.", LONG, "한국어 문장이 여기에 있습니다.\n", "👩‍🔧 ❤️\r\nx", "한​ ﬁ Ａ"]
    return [(i, t, *rest) for i, t in enumerate(texts)] + [(6, texts[6], *rest), (None, texts[6], *rest), (99, "no other value at all", *[None] * len(rest))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def operators(spark, docs):
    samples = spark.createDataFrame([("en", "the cat sat on the mat"), ("ko", "고양이가 매트 위에 앉았다"), (None, "x"), ("en", None)], "lang string, text string")
    lexicon = spark.createDataFrame([("en", "the"), (None, "x"), ("en", None)], "lang string, word string")
    model = language_labels.fit_from_tables(samples, lexicon)
    labelled = language_labels.label_languages(docs, model)
    targets = spark.createDataFrame([("s", 0.5, 3), ("none", 0.5, 2), (None, 0.1, 1), ("t", None, None)], "source string, target_share double, max_repeats int")
    counted = docs.withColumn("count", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(None))))
    lines = main_content.fit_lines(counted)
    profiles = spam_pages.profiles(docs, lines, spam_pages.advertising_phrases(docs), {"en": {"the"}, "xx": set()}, keep=("lang",))
    sketches = text_statistics.quantile_sketches(profiles, "lang")
    return {
        "pairs": near_duplicates.near_duplicate_pairs(docs, words=3, threshold=0.6),
        "groups": near_duplicates.near_duplicate_groups(docs),
        "look": confusables.look_alike_pairs(docs),
        "classes": confusables.look_alike_classes(docs),
        "forms": confusables.consistent_texts(docs),
        "terms": term_frequency.text_term_counts(docs, lengths=(1, 2, 3)),
        "values": term_frequency.value_term_counts(counted, "doc_id", "count"),
        "body": main_content.body_lines(counted, lines),
        "languages": language_labels.wrong_labels(labelled),
        "unlabelled": language_labels.label_languages(docs, language_labels.fit_from_tables(samples.where("false"))),
        "profiles": profiles,
        "spam": spam_pages.spam_pages(profiles),
        "statistics": text_statistics.against_distribution(profiles, sketches, "lang"),
        "merged": text_statistics.merged_sketches(sketches.unionByName(sketches), "lang"),
        "ids": token_stream.encode_texts(docs),
        "decoded": token_stream.decode_ids(token_stream.encode_texts(docs)),
        "selection": source_mixing.mix_sources(docs, targets)[0],
        "shares": source_mixing.mix_sources(docs, targets)[1],
        "pieces": splitting.split_oversized(docs, 200, 20),
    }


def test_odd_rows(spark, odd):
    got = {name: df.collect() for name, df in operators(spark, odd).items()}
    # row 6 stands three times, once without an id; row 7 has its text
    assert {(r.id_a, r.id_b) for r in got["pairs"]} == {(6, 7)}
    assert len(got["groups"]) == 6 and {r.links for r in got["groups"]} == {0}
    assert got["look"] == [] and len(got["forms"]) == len(rows())
    assert {r.doc_id: r.ids for r in got["ids"] if r.doc_id in (0, 1)} == {0: [], 1: []}
    texts = {i: t for i, t, *_ in rows() if i is not None}
    assert all(r.text == (texts[r.doc_id] or "") for r in got["decoded"] if r.doc_id is not None)
    assert all(r.doc_id not in (0, 1, 2) for r in got["body"] + got["profiles"] + got["languages"])
    assert got["unlabelled"] == []
    terms = {(r.n, r.term): (r.occurrences, r.records) for r in got["terms"]}
    assert terms[1, "second"] == (4, 4) and terms[2, "two words"] == (1, 1) and terms[1, "of"][1] == 4
    assert {(r.term, r.occurrences, r.records) for r in got["values"]} == {("1", 7, 6)}
    assert {r.doc_id for r in got["pieces"]} == {8} and all(r.end_token - r.first_token <= 200 for r in got["pieces"])
    shares = {r.source: r for r in got["shares"]}
    assert shares["s"].reached_share == 1.0 and shares["none"].reached_tokens == 0 and shares["t"].reached_tokens == 0
    assert all(0 < r.repeats <= 3 for r in got["selection"])
    assert {r.documents for r in got["merged"]} == {2 * 11, 2}


def test_empty_tables(spark, none):
    for name, df in operators(spark, none).items():
        assert df.count() == (3 if name == "shares" else 0), name
