import itertools
import random

import numpy as np

from loamsift.llm import near_duplicates as nd
from loamsift.llm.chars import mix


def shingles(text, n):
    import re

    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def texts():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    out = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(5, 120))
        out.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[len(w) // 4 :] + w[: len(w) // 4]
            out.append(", ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    return out + ["", None, "a b", "a b c", "A, b; C!"]


def test_against_all_pairs(spark):
    docs = list(enumerate(texts()))
    sets = {i: shingles(t or "", 3) for i, t in docs}
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if x and y and len(x & y) / len(x | y) >= 0.6}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.id_a, r.id_b) for r in nd.near_duplicate_pairs(df, words=3, threshold=0.6).collect()} == want
    # groups are the connected parts of the links
    parent = {i: i for i, x in sets.items() if x}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        parent[find(a)] = find(b)
    groups = {}
    for r in nd.near_duplicate_groups(df, words=3, threshold=0.6).collect():
        groups.setdefault(r.group, set()).add(r.doc_id)
    by_root = {}
    for i in parent:
        by_root.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by_root.values()))


def test_bands_and_classes_in_blocks(spark, monkeypatch):
    """The same links where every band of more than four classes is joined block by block, and every class of more than two pairs is spread."""
    docs = list(enumerate(texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    links = lambda: {tuple(sorted((r.class_a, r.class_b))) for r in nd.near_duplicate_classes(df, words=3, threshold=0.4)[1].collect()}
    whole = links()
    monkeypatch.setattr(nd, "HOT", 4)
    monkeypatch.setattr(nd, "PAIRS", 2)
    assert links() == whole and len(whole) > 50


def test_near_copies_of_a_third_of_the_texts(spark):
    rng = random.Random(8)
    base = [f"base{i}" for i in range(90)]
    docs = []
    for i in range(600):
        w = list(base) if i % 3 == 0 else [f"own{i}_{j}" for j in range(90)]
        for at in rng.sample(range(90), rng.randint(2, 6)):
            w[at] = f"edit{i}x{at}"
        docs.append((i, " ".join(w)))
    sets = {i: shingles(t, 3) for i, t in docs}
    want = {(a, b) for a, b in itertools.combinations(range(0, 600, 3), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert 3000 < len(want) < 19900
    found = {(r.id_a, r.id_b) for r in nd.near_duplicate_pairs(spark.createDataFrame(docs, "doc_id long, text string"), words=3, threshold=0.6).collect()}
    assert found <= want and len(found) >= 0.999 * len(want), (len(found), len(want))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    universe = mix(np.arange(1, 601, dtype=np.uint64))
    weight = rng.choice([1.0, 0.3, 0.02], 600)
    a, b = np.arange(0, 400), np.arange(150, 600)
    darts, held = nd.dart_minhash(np.concatenate((universe[a], universe[b])), np.concatenate((weight[a], weight[b])), np.array([len(a), len(b)]), 4000)
    both = held.all(axis=0)
    assert both.mean() > 0.99
    want = weight[np.intersect1d(a, b)].sum() / weight.sum()
    assert abs((darts[0] == darts[1])[both].mean() - want) < 0.03


def test_packed_sets():
    s = np.array([5, 2**40 + 7, 9, 3], np.uint64)
    one, two = nd._pack(s, np.array([2, 2]))
    assert len(one) == 10 and nd.jaccard(one, two) == 0 and nd.jaccard(one, one) == 1 and nd.jaccard(b"", b"") == 0


def test_bands():
    import inspect

    assert inspect.signature(nd.near_duplicate_classes).parameters["bands"].default == 40
