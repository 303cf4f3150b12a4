import itertools
import random

import numpy as np
import pytest

from loamsift.llm import least_cut as lc
from loamsift.llm import main_content as mc
from loamsift.llm.line_classifier import LineModel


def test_least_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        cost = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0.1, 1.5)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        price = lambda body: sum(c for b, c in zip(body, cost) if not b and c > 0) + sum(-c for b, c in zip(body, cost) if b and c < 0) + sum(w for i, j, w in edges if body[i] != body[j])
        best = min(price(b) for b in itertools.product([False, True], repeat=n))
        a, b, w = (np.array([e[k] for e in edges], np.int64 if k < 2 else float) for k in range(3))
        assert abs(price(lc.least_cut(np.array(cost), a, b, w).tolist()) - best) < 1e-9
        assert abs(price(lc.max_flow_labels(cost, edges)) - best) < 1e-9


def test_one_long_row_in_doubt():
    """A page of 20000 lines none of which outweighs its edges: the flow stays local."""
    rng = np.random.default_rng(3)
    n = 20_000
    cost = rng.uniform(-1, 1, n)
    i = np.arange(n)
    a, b = np.concatenate((i[:-1], i[:-2])), np.concatenate((i[1:], i[2:]))
    label = lc.least_cut(cost, a, b, np.full(len(a), 0.7))
    assert 0 < label.sum() < n


WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "tu", "ve") for b in ("ra", "so", "ti", "vu", "wo") for c in ("bel", "dan", "fir", "gos", "hul")]
MENU = ["Start page", "About these people", "Write to us", "Old numbers", "Find something", "Your basket", "House rules", "Who we are"]
HEADS = ["In short", "What went before", "How to begin"]


def pages(n, seed):
    """(id, text, counts, body's line numbers): pages of sites with a menu, a notice, headings, a list, links to other pages under a head, and a foot."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        site, lines = f"Site{rng.randrange(40)}", []
        sentence = lambda: " ".join(rng.choices(WORDS, k=rng.randint(14, 30))).capitalize() + "."
        add = lambda text, count, body: lines.append((text, count, body))
        add(f"{site} - tales from the hills", rng.randint(200, 700), False)
        for entry in rng.sample(MENU, rng.randint(4, 8)):
            add(rng.choice(["{}", "* {}", "{} »"]).format(entry), rng.randint(5000, 65535), False)
        if rng.random() < 0.5:
            add("This site keeps small files on your machine to know you again.", rng.randint(2000, 65535), False)
        for k in range(rng.randint(3, 7)):
            if k and rng.random() < 0.5:
                add(rng.choice(HEADS), rng.randint(2000, 9000), True)
            add(sentence(), 1, True)
            if rng.random() < 0.2:
                for _ in range(rng.randint(5, 9)):
                    add(f"- {' '.join(rng.choices(WORDS, k=2))}", rng.randint(1, 2), True)
        if rng.random() < 0.7:
            add("Others were reading", rng.randint(5000, 65535), False)
            for _ in range(rng.randint(3, 20)):
                add(f"The {rng.choice(WORDS)} of {rng.choice(WORDS)} {rng.randint(1, 99)}", rng.randint(8, 60), False)
        add(f"{site} is made by its readers and takes no unasked mail.", rng.randint(200, 700), False)
        out.append((i, "\n".join(x for x, _, _ in lines), [c for _, c, _ in lines], [k for k, (_, _, b) in enumerate(lines, 1) if b]))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, c) for i, t, c, _ in pages(400, 1)]
    return mc.fit_lines(spark.createDataFrame(rows + rows[:20], "doc_id long, text string, count array<int>"))


@pytest.mark.parametrize("counts", [True, False])
def test_bodies_of_other_pages(spark, model, counts):
    made = pages(80, 2)
    df = spark.createDataFrame([(i, t, c if counts else None) for i, t, c, _ in made], "doc_id long, text string, count array<int>")
    got = {(r.doc_id, r.line_no) for r in mc.body_lines(df, model).collect()}
    want = {(i, k) for i, _, _, body in made for k in body}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got), (len(got), len(want), len(got & want))


def test_odd_counts(spark, model):
    _, text, counts, body = pages(1, 5)[0]
    rows = [(1, text, counts), (2, text, None), (3, text, counts[:-1]), (4, "", []), (5, None, [1]), (6, text, [None] * len(counts))]
    got = {}
    for r in mc.body_lines(spark.createDataFrame(rows, "doc_id long, text string, count array<int>"), model).collect():
        got.setdefault(r.doc_id, []).append(r.line_no)
    assert set(got) == {1, 2, 3, 6} and got[2] == got[3] == got[6]


def test_long_lists_and_long_notes(spark, model):
    """Twenty links under one head, and a notice of 900 characters that many documents hold, are furniture."""
    sentence = " ".join(WORDS[:25]).capitalize() + "."
    note = ("This site keeps small files on your machine to know you again. " * 15).strip()
    lines = [("Start page", 60000), (note, 30000), (sentence, 1), (sentence[::-1].capitalize() + ".", 1), ("Others were reading", 40000), *[(f"The {w} of {w[::-1]} {k}", 20) for k, w in enumerate(WORDS[:20])], ("House rules", 60000)]
    df = spark.createDataFrame([(1, "\n".join(x for x, _ in lines), [c for _, c in lines])], "doc_id long, text string, count array<int>")
    assert {r.line_no for r in mc.body_lines(df, model).collect()} == {3, 4}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, count array<int>")
    model = mc.fit_lines(empty)
    df = spark.createDataFrame([(1, "One line\n\nanother", None)], "doc_id long, text string, count array<int>")
    assert {r.line_no for r in mc.body_lines(df, model).collect()} == {1, 3}
    assert mc.body_lines(empty, LineModel.neutral()).count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, "2031-01-01", "a", [1]), (1, "2031-02-01", "a", [2]), (1, "2031-02-01", "a", None), (2, None, "b", [1])], "doc_id long, loaded_at string, text string, count array<int>")
    assert {(r.doc_id, tuple(r["count"])) for r in mc.latest_rows(df, "doc_id", "loaded_at").collect()} == {(1, (2,)), (2, (1,))}
