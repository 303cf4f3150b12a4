"""Text functions and modifiers on hand-made texts that the tables do not hold."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loamsift.functions import text as T
from loamsift.operators import heuristics as H
from loamsift.operators import quality


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_every_character_of_the_table(spark):
    everything = "".join(T.PUNCTUATION)
    assert one(spark, everything, T.replace_punctuation) == "".join(T.PUNCTUATION.values())
    assert one(spark, f"a{everything}b\x07\x85", T.normalize_for_dedup) == "a0b"  # the wide 1 is a digit first
    assert one(spark, "a\t　​￼\x84b\nc", T.normalize_data) == "a     b\nc"


def test_white_space_is_pythons(spark):
    spaces = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
    assert one(spark, f"{spaces}a{spaces}b{spaces}", T.strip) == f"a{spaces}b"
    assert one(spark, spaces.join("abc"), T.words) == ["a", "b", "c"]


@pytest.mark.parametrize("language", ["en", "de", "cs", "pt"])
@pytest.mark.parametrize("text", ['(x). "y", 3 % « z » 1 2', "`a'' (b )–c… nº 5 :", '"so." he said. "no..." x', ""])
def test_spacing(spark, text, language):
    assert one(spark, text, lambda t: T.spacing_for_tokenizer(t, language)) is not None
    if text.startswith("(x)"):
        out = one(spark, text, lambda t: T.spacing_for_tokenizer(t, language))
        assert out.startswith(" (x\\).") and ("1,2" if language in ("de", "cs") else "1.2") in out


def test_hash_and_accents(spark):
    line = "Ünïcode line"
    assert int(one(spark, line, T.line_hash)) == int.from_bytes(hashlib.sha1(line.encode()).digest()[:8], "little")
    assert one(spark, "Éàñ한", T.strip_accents) == "Ean" + unicodedata.normalize("NFD", "한")
    assert one(spark, None, T.strip_accents) is None


def test_word_segments(spark):
    assert one(spark, "t—stop, foo-bar 3.14 can't", lambda t: T.split_words(t, "uniseg", ignore_punctuation=True)) == ["t", "stop", "foo", "bar", "3.14", "can't"]


@pytest.mark.parametrize("line, gone", [("3 likes", True), ("1.2K shares", True), ("(100 comments)", True), ("3 likes it", False), ("likes", False), ("5 views\r", True)])
def test_counters(spark, line, gone):
    assert one(spark, line, H.drop_counter_lines) == ("" if gone else line)


@pytest.mark.parametrize("line, gone", [("2020", True), ("²³", True), ("①", True), ("20a", False), ("", False)])
def test_numeric_lines(spark, line, gone):
    assert one(spark, f"x\n{line}", H.drop_numeric_lines) == ("x" if gone else f"x\n{line}")


def test_other_modifiers(spark):
    assert one(spark, "HELLO World\nok\n\n", H.drop_uppercase_lines) == "ok\n\n"
    assert one(spark, "a\na b\n \n\n", H.drop_short_lines) == "a b\n\n"
    assert one(spark, "a\n\n\n\n\nb\n\nc", H.collapse_newlines) == "a\n\nb\n\nc"
    long = "one two three four five six seven eight nine ten items in cart"
    assert one(spark, f"2 items in cart\nITEMS IN CART\n\n{long}", lambda t: H.remove_substring(t, "items in cart")) == f"2\n\n{long}"
    assert one(spark, "Foo Read more...\nread more... Foo", lambda t: H.remove_substring(t, "Read more...", "suffix")) == "Foo\nread more... Foo"
    assert one(spark, "Sign-in now\nnow Sign-in", lambda t: H.remove_substring(t, "Sign-in", "prefix")) == "now\nnow Sign-in"
    assert one(spark, "a b\nc items in cart", lambda t: H.remove_substring(t, "items in cart", only_substring=False)) == "a b"


def test_filters_at_their_limits(spark):
    assert one(spark, "가" + "a" * 9, lambda t: quality.hangul_share(t) >= 0.1) is True
    assert one(spark, "가" + "a" * 10, lambda t: quality.hangul_share(t) >= 0.1) is False
    assert one(spark, "", quality.hangul_share) is None
    assert one(spark, "\n".join(["- x"] * 9 + ["x"]), H.bullet_ratio) is True
    assert one(spark, "\n".join(["- x"] * 10), H.bullet_ratio) is False
    assert one(spark, "\n".join(["x..."] * 3 + ["x"] * 7), H.ellipsis_ratio) is True
    assert one(spark, "\n".join(["x. . ."] * 4 + ["x"] * 6), H.ellipsis_ratio) is False
    assert one(spark, "abc " * 10 + "#", H.symbol_ratio) is True
    assert one(spark, " ", H.symbol_ratio) is False and one(spark, " ", H.word_length) is False
    assert one(spark, "the, the of", H.stop_words) is True
    assert one(spark, " ".join(["w"] * 49), H.page_length) is False and one(spark, " ".join(["w"] * 50), H.page_length) is True


def test_token_words_agree(spark):
    text = "a,b (c) 1x\x0b-d\x00e .f\n½ 한"
    want = [w for w in re.split("[ \n\r\t\x0b\x0c\x00]+", text) if w and w[0].isalnum()]
    assert one(spark, text, T.token_words) == want and one(spark, text, T.token_word_count) == len(want)


def test_model_scores(spark):
    loads = quality.scored_by(lambda: lambda texts: texts.str.len() / 10)
    docs = spark.createDataFrame([(1, "abcde\nfghij"), (2, ""), (3, None), (4, "x")], "doc_id int, text string")
    assert [(r.doc_id, r.fasttext_score) for r in quality.with_quality(docs, loads, threshold=0.5).collect()] == [(1, 1.1)]


def test_strip_accents_of_all_documents(spark, small):
    import unicodedata

    from loamsift.plans.queries import QUERIES

    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        want[r.doc_id] = r.text and "".join(c for c in unicodedata.normalize("NFD", r.text) if unicodedata.category(c) != "Mn")
    got = QUERIES["strip_accents_all"](spark, small).collect()
    assert len(got) == len(want) and {r.doc_id: r.text for r in got} == want
    assert any(t and any("\u1100" <= c <= "\u11ff" for c in t) for t in want.values()) and None in want.values()


def test_probability_of_a_label(spark):
    def load():
        class Classifier:
            def predict(self, text, k):
                assert "\n" not in text and k == 2
                labels = ["__label__hq", "__label__lq"] if "good" in text else ["__label__lq", "__label__other"]
                return labels, [0.75, 0.25]

        return Classifier()

    df = spark.createDataFrame([("a good\ntext",), ("bad",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(quality.label_probability(load)(F.col("t")).alias("x")).collect()] == [0.75, 0.0, 0.0, 0.0]


def test_spans(spark):
    assert one(spark, "a\nb\nc", lambda t: T.spans(T.lines_of(t), 2)) == ["a\nb", "b\nc"]
    assert one(spark, "a", lambda t: T.spans(T.lines_of(t), 2)) == [] and one(spark, "a\nb", lambda t: T.spans(T.lines_of(t))) == ["a", "b"]


@pytest.mark.parametrize("text", ["", " ", "a b", "  x\u3000y  ", "a\n\nb ...\n* c ... \n● d…", "1 2 x9 . , —", "The THE and\tthat of", "\x1cа\x85b", "••\n-\n..."])
def test_counts_without_arrays(spark, text):
    """The filters' counts against Python's."""
    words, lines = text.split(), text.split("\n")
    assert one(spark, text, T.word_count) == len(words)
    assert one(spark, text, H.bullet_share) == pytest.approx(sum(x[:1] in H.BULLETS for x in lines) / len(lines))
    assert one(spark, text, H.ellipsis_share) == pytest.approx(sum(x.endswith(tuple(H.ELLIPSES)) for x in lines) / len(lines))
    assert one(spark, text, H.stop_word_count) == sum(w in H.STOP_WORDS for w in text.lower().split())
    got = one(spark, text, H.non_alphabetic_share)
    assert got is None if not words else got == pytest.approx(sum(not any(c.isalpha() for c in w) for w in words) / len(words))


def test_modifiers_in_one_pass_are_those_in_turn(spark, small):
    def in_turn(t):
        out = H.drop_short_lines(H.drop_counter_lines(H.drop_numeric_lines(H.drop_uppercase_lines(H.collapse_newlines(t)))))
        for substring, location in H.REMOVED:
            out = H.remove_substring(out, substring, location)
        return out

    docs = spark.read.parquet(f"{small}/documents.parquet").select("text").union(spark.createDataFrame([("3 likes\nA B C\n\n2020\nx",), ("items in cart\n \nSign-in",), ("",), ("a\n\n\n\n\nFoo Read more...\n2 ITEMS IN CART y",)], "text string"))
    rows = docs.where("text is not null").select(H.modified(F.col("text")).alias("one"), in_turn(F.col("text")).alias("turns"))
    assert rows.where("one <> turns").count() == 0
