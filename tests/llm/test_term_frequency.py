import random
import re
from collections import Counter

import numpy as np

from loamsift.llm import term_frequency as tf
from loamsift.llm.suffix_array import SuffixArray


def test_intervals_against_counting():
    rng = random.Random(2)
    for _ in range(60):
        docs = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 6))]
        ids, record = np.array([x for d in docs for x in d]), np.array([k for k, d in enumerate(docs) for _ in d])
        ids = np.unique(ids, return_inverse=True)[1]
        suffixes = SuffixArray(ids, record)
        assert all(tuple(ids[a : suffixes.end[a]]) <= tuple(ids[b : suffixes.end[b]]) for a, b in zip(suffixes.order, suffixes.order[1:]))
        classes = {}
        for at, shortest, longest, o, r in suffixes.intervals():
            for n in range(shortest, longest + 1):
                classes[tuple(ids[at : at + n])] = (o, r)
        repeated = {}
        for n in range(1, 14):
            occurrences, records = Counter(), Counter()
            at = 0
            for d in docs:
                grams = [tuple(ids[at + i : at + i + n]) for i in range(len(d) - n + 1)]
                occurrences.update(grams)
                records.update(set(grams))
                at += len(d)
            first, o, r = suffixes.counts(n)
            got = {tuple(ids[i : i + n]): (a, b) for i, a, b in zip(first, o, r)}
            assert got == {g: (occurrences[g], records[g]) for g in occurrences}
            repeated |= {g: c for g, c in got.items() if c[0] > 1}
        assert classes == repeated


def test_tables(spark):
    texts = ["Le chat, le CHIEN_3x", "chat chat", "", None, "ß ǅ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want, in_records = Counter(), Counter()
    for t in filter(None, texts):
        w = re.findall(r"[^\W\d_]+", t.lower())
        want.update(w)
        in_records.update(set(w))
    assert {r.term: (r.occurrences, r.records) for r in tf.text_term_counts(df).collect()} == {w: (want[w], in_records[w]) for w in want}


def test_values_of_a_hot_record(spark):
    rows = [(1, [5, 5, None]), (1, [5, 7]), (2, None), (2, [7]), (3, [])] + [(9, [k % 50, 5]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, count array<int>").repartition(5)
    got = {r.term: (r.occurrences, r.records) for r in tf.value_term_counts(df, "doc_id", "count").collect()}
    assert got["5"] == (3 + 3000 + 60, 2) and got["7"] == (1 + 1 + 60, 3) and got["8"] == (60, 1)


def test_marks(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 3), ("c", 30), ("d", 25)], "term string, records long")
    assert {r.term: r.mark for r in tf.marked(counts, 100).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}
