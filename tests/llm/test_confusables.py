import pytest

from loamsift.llm import confusables as c


@pytest.mark.parametrize(
    "a, b",
    [("café", "café"), ("ABC １２", "Ａ​BC 12"), ("раураl", "paypal"), ("a b", "a b"), ("a　b", "a\tb"), ("x\r\ny", "x\ny"), ("ﬁn", "fin"), ("한국", "한국"), ("non‑stop", "non-stop"), ("soft­hyphen", "softhyphen"), ("Ⅳ 𝐀", "IV A"), ("x y", "x\ny"), ("ΑΒ", "AB")],
)
def test_same_look(a, b):
    assert c.skeleton(a) == c.skeleton(b)
    assert c.skeleton(c.skeleton(a)) == c.skeleton(a)


@pytest.mark.parametrize("a, b", [("resume", "résumé"), ("Ab", "ab"), ("a b", "ab"), ("a b", "a  b"), ("a\nb", "a b"), ("x²", "x2"), ("O0", "OO"), ("Il", "ll"), ("👩‍🔧", "👩🔧"), ("“a”", '"a"'), ("①", "1"), ("a-b", "a–b")])
def test_other_look(a, b):
    assert c.skeleton(a) != c.skeleton(b)


def test_pairs(spark):
    rows = [(1, "café au lait"), (2, "café au lait"), (3, "café au lait"), (4, "ca​fé au lait"), (5, "cafe au lait"), (6, "​"), (7, " ­"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id_a, r.id_b) for r in c.look_alike_pairs(df).collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert {(r.doc_id, r.class_id, r.variants) for r in c.look_alike_classes(df).collect()} == {(i, 1, 3) for i in (1, 2, 3, 4)} | {(5, 5, 1)}


def test_letters_of_other_alphabets(spark):
    """What ICU's data add to the short table: other alphabets only, case kept, no letter taken from Latin."""
    more = c._confusable_letters()
    assert len(more) > 100 and all(len(b) == 1 and b.isascii() and a.isupper() == b.isupper() and not a.isascii() for a, b in more.items())
    of = c.Skeletons(more)
    assert of("Ꮤorld") == "World" and of("раураl") == "paypal"
    for a, b in (("I", "l"), ("O", "0"), ("rn", "m"), ("ı", "i"), ("é", "e")):
        assert of(a) != of(b)
    assert all(of(of(x)) == of(x) for x in more)
