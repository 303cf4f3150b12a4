"""Tokens against the tokenizers library; mixing and splitting by their definitions."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamsift.llm import source_mixing, splitting
from loamsift.llm import token_stream as ts

pytestmark = pytest.mark.skipif(not os.path.exists(ts.BYTE_BPE), reason="no vocabulary here")


@pytest.fixture(scope="module")
def ours():
    with open(ts.BYTE_BPE, "rb") as f:
        return ts.Tokenizer(f.read())


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(ts.BYTE_BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "\n", "'s", "it''s 'tis we'll I'LL can't x're  y", "  a   b \n\n c\t d ", "a'", " 's", "<|endoftext|> hi", "\x1c\x1d a", "é  ò", "½ ²x 12", "a" * 700, " " * 900, "ab" * 500, "한" * 300, "👩‍🔧❤️", " 　x"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(ours, theirs, text):
    assert ours.encode(text) == theirs(text)
    assert ours.decode(ours.encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("ab's tre \n\t12.,é한'll-_　👩"), max_size=60))
def test_random_texts(ours, theirs, text):
    assert ours.encode(text) == theirs(text)


def test_documents(ours, theirs, spark, small):
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = ours.encode(r.text or "")
        assert ids == theirs(r.text or "")
        assert ours.decode(ids) == (r.text or "")


def test_portions_and_memory(ours):
    data = ("the quickly moving" * 300 + "ㅁㅏ한국" * 200).encode()
    t, got, most = ts.Transducer(ours.merges), [], 0
    for i in range(0, len(data), 37):
        got += t.feed(data[i : i + 37])
        most = max(most, len(t.kept))
    assert got + t.finish() == ts.transduce(ours.merges, data)
    assert most <= 4 * ours.merges.longest and ours.merges.lookahead + 2 * ours.merges.longest < 4 * ours.merges.longest


@settings(max_examples=60, deadline=None)
@given(text=st.text(st.sampled_from("aehinorst한국어é"), min_size=200, max_size=900))
def test_what_is_sent_is_never_taken_back(ours, theirs, text):
    """Tokens leave the transducer while bytes still come in; together they are those of the whole."""
    data, t = text.encode(), ts.Transducer(ours.merges)
    sent = [t.feed(data[i : i + 50]) for i in range(0, len(data), 50)]
    ids = [i for part in sent for i in part]
    whole = ts.transduce(ours.merges, data)
    assert ids == whole[: len(ids)] and ids + t.finish() == whole == theirs(text)


@settings(max_examples=100, deadline=None)
@given(data=st.binary(max_size=40), cut=st.integers(0, 40))
def test_decoder_agrees_with_the_codec(data, cut):
    d = ts.TextDecoder()
    out = d.feed(data[:cut]) + d.feed(data[cut:], last=True)
    try:
        assert out == data.decode()
    except UnicodeDecodeError:
        assert "�" in out


def test_water_filling():
    fill = source_mixing.water_fill({"a": 100, "b": 10, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.1}, {"a": 2, "b": 3, "c": 1, "d": 9}, 300)
    assert fill["b"] == 30 and fill["d"] == 0 and abs(sum(fill.values()) - 300) < 1e-9
    assert abs(fill["a"] / fill["c"] - 2.5) < 1e-9
    full = source_mixing.water_fill({"a": 10}, {"a": 1.0}, {"a": 2}, 1000)
    assert full == {"a": 20}


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(1, 30)), rng.choice(["News", "news ", "web", "web", "web", "tiny" if i < 40 else "web"])) for i in range(3000)] + [(5000, "x", None), (5001, "", "web"), (5002, None, "web"), (5003, "y", "unnamed")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("news", 0.5, 2), ("web", 0.3, 1), ("tiny", 0.2, 4)], "source string, target_share double, max_repeats int")
    selection, shares = source_mixing.mix_sources(docs, targets, total_tokens=20000)
    picked = selection.collect()
    assert len({r.doc_id for r in picked}) == len(picked) and all(r.repeats <= {"news": 2, "web": 1, "tiny": 4}[r.source] for r in picked)
    for r in shares.collect():
        assert abs(r.reached_tokens - r.allotted_tokens) <= 30
        assert r.reached_tokens == sum(x.tokens * x.repeats for x in picked if x.source == r.source)
    again = source_mixing.mix_sources(docs.repartition(7), targets, total_tokens=20000)[0].collect()
    assert {(r.doc_id, r.repeats) for r in again} == {(r.doc_id, r.repeats) for r in picked}


def test_pieces(ours):
    rng = random.Random(2)
    text = "\n\n".join(" ".join(rng.choice(["alpha", "beta,", "gamma", "delta."]) for _ in range(rng.randint(5, 90))) for _ in range(30)) + "한글" * 200
    pieces = splitting.split_text(ours, text, 150, 20)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(ours.encode(text))
    for (_, end, _, _), (begin, _, shared, _) in zip(pieces, pieces[1:]):
        assert 20 <= shared <= 23 and end - begin == shared
    assert all(len(ours.encode(p[3])) <= 150 for p in pieces)
    ids = ours.encode(text)
    assert all(p[3] == ours.decode(ids[p[0] : p[1]]) for p in pieces)
    assert any(p[3].endswith("\n\n") for p in pieces[:-1])
    assert splitting.split_text(ours, "short", 150, 20) == [(0, 1, 0, "short")]


def test_long_texts_go_through_in_portions(ours, theirs):
    rng = random.Random(8)
    text = "".join(rng.choice(["word", " and", "  two", "\n", " 12", "'s", " x", ".", " 한글"]) for _ in range(20000))
    parts = list(ts.portions(text, 500))
    assert "".join(parts) == text and len(parts) > 50
    assert [i for p in parts for i in ours.encode(p)] == theirs(text)
    assert list(ts.portions("ab" * 3000, 500)) == ["ab" * 3000]
    mixed = "ab12" * 3000
    assert len(list(ts.portions(mixed, 500))) > 20 and [i for p in ts.portions(mixed, 500) for i in ours.encode(p)] == theirs(mixed)
    assert list(ts.portions("a" * 900 + " b" + "c" * 700 + "  d", 500)) == ["a" * 900, " b" + "c" * 700 + "  d"]
