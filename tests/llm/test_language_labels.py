import numpy as np
import pytest

from loamsift.llm import language_labels as ll
from loamsift.llm.chars import Block


@pytest.fixture(scope="module")
def samples(spark, small):
    return [(r.lang, r.text) for r in spark.read.parquet(f"{small}/lang_samples.parquet").orderBy("sample_id").collect()]


@pytest.fixture(scope="module")
def lexicon(spark, small):
    out = {}
    for r in spark.read.parquet(f"{small}/common_words.parquet").collect():
        out.setdefault(r.word, []).append(r.lang)
    return {w: " ".join(x) for w, x in out.items()}


def test_held_out_accuracy(samples, lexicon):
    model = ll.LanguageModel.fit([s for k, s in enumerate(samples) if k % 4], lexicon)
    held = [s for k, s in enumerate(samples) if k % 4 == 0]
    block = Block([ll.plain(t) for _, t in held])
    gamma, text, _, _ = ll.word_labels(model, ll._Scorer(model), block)
    main = np.stack([np.bincount(text, g, len(held)) for g in gamma.T], axis=1).argmax(axis=1)
    assert np.mean([model.langs[m] == lang for m, (lang, _) in zip(main, held)]) >= 0.97


def test_forward_backward_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    scores, a, b = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first, length = np.array([0, 4]), np.array([4, 3])
    gamma, logs, pairs = ll.forward_backward(scores, first, length, a, b)
    expected = np.zeros((3, 3))
    for f, n in zip(first, length):
        weight, marginal, z = {}, np.zeros((n, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            s = np.exp(b[path[0]] + sum(scores[f + t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
            z += s
            for t, y in enumerate(path):
                marginal[t, y] += s
            weight[path] = s
        assert np.allclose(gamma[f : f + n], marginal / z)
        assert np.isclose(logs[f : f + n].sum(), np.log(z))
        for path, s in weight.items():
            for x, y in zip(path, path[1:]):
                expected[x, y] += s / z
    assert np.allclose(pairs, expected)


def test_a_line_is_one_chain(samples, lexicon):
    """A line of 600 words whose language shows in its first words only: the names after them follow it to the end."""
    model = ll.LanguageModel.fit(samples[:60], lexicon)
    block = Block([ll.plain("der die und " + " ".join(f"{a}{b}" for a in ("xq", "zj", "qw", "vx") for b in ("zz", "qq", "jx", "vq", "wx")) * 8)])
    begin, end, _ = block.runs(1)
    assert len(begin) > 150
    score = ll._Scorer(model)
    scores = score(block, begin, end).astype(np.float64)
    gamma, text, _, _ = ll.word_labels(model, score, block)
    whole = ll.forward_backward(scores, np.array([0]), np.array([len(begin)]), model.transitions, model.begin)[0]
    own = np.exp(scores - scores.max(axis=1, keepdims=True))
    k = len(model.langs)
    weight = ((1 / own.sum(axis=1) - 1 / k) / (1 - 1 / k)) ** 2
    assert np.allclose(gamma, whole * weight[:, None])


def test_documents_and_lines(spark, small, samples, lexicon):
    of = lambda lang, n=6: "\n".join([t for x, t in samples if x == lang and len(t.split()) >= 8][:n])
    other = next(t for x, t in samples if x == "fr" and len(t.split()) >= 9)
    rows = [(1, "de-DE", of("de")), (2, "en", of("es")), (3, None, of("ko")), (4, "und", of("pt")), (5, "EN", of("en") + f"\n\n{other}\n"), (6, "en", "12 34"), (7, "en", None), (8, "it", of("fr"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = ll.LanguageModel.fit(samples, lexicon)
    got = {(r.doc_id, r.line_no, r.lang) for r in ll.wrong_labels(ll.label_languages(df, model)).collect()}
    line = rows[4][2].split("\n").index(other) + 1
    assert got == {(2, 0, "es"), (3, 0, "ko"), (4, 0, "pt"), (5, line, "fr"), (8, 0, "fr")}


@pytest.mark.parametrize("text, words", [("see www.example.org/path now", ["see", "now"]), ("x9y ok", ["ok"]), ("a_b c", ["c"]), ("“Hallo,” sagt", ["hallo", "sagt"]), ("fin. Le", ["fin", "le"])])
def test_words_that_count(text, words):
    block = Block([ll.plain(text)])
    from loamsift.llm.chars import LETTER

    begin, end, _ = block.runs(LETTER)
    fine = ll._natural(block, begin, end)
    assert [block.joined[a:b] for a, b, f in zip(begin, end, fine) if f] == words


def test_a_text_does_not_see_the_one_before():
    from loamsift.llm.chars import LETTER

    block = Block([ll.plain(t) for t in ("Ends here.", "The next", "x1", "2y z")])
    begin, end, _ = block.runs(LETTER)
    assert [block.joined[a:b] for a, b, f in zip(begin, end, ll._natural(block, begin, end)) if f] == ["ends", "here", "the", "next", "z"]
