"""Sources, sinks, removal of seen text, samples and streams on files made here."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamsift.functions.text import lines_of
from loamsift.operators import dedup, lines, repetition, sampling
from loamsift.plans import pipelines
from loamsift.sources import records, sinks
from loamsift.streaming import stages


def wet(*bodies):
    out = []
    for kind, body in bodies:
        payload = body.encode()
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a.test/x:y\r\nwarc-identified-content-language: eng\r\nContent-Length: {len(payload)}\r\n\r\n"
        out.append(gzip.compress(head.encode() + payload + b"\r\n\r\n"))
    return b"".join(out)  # a member for each record


def test_wet(spark, tmp_path):
    (tmp_path / "a.warc.wet.gz").write_bytes(wet(("warcinfo", "software"), ("conversion", "Title\nline one.\n"), ("conversion", "둘째")))
    rows = records.read_wet(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.rec_type, r.text) for r in rows] == [(1, "warcinfo", "software"), (2, "conversion", "Title\nline one.\n"), (3, "conversion", "둘째")]
    df = records.read_wet(spark, str(tmp_path))
    assert df.select(records.header(F.col("headers"), "warc-target-uri").alias("u")).first().u == "http://a.test/x:y"
    assert records.baseline(df).count() == 2
    assert [r.text for r in pipelines.korean_baseline(df).collect()] == ["둘째"]
    assert pipelines.english_baseline(df, lambda t: t.contains("line")).count() == 1


def test_wet_records_end_by_their_length(spark, tmp_path):
    inner = "a page\r\n\r\nWARC/1.0\r\nWARC-Type: conversion\r\n\r\nthat shows a record\r\nWARC/1.0\r\nof an archive"
    files = {"a": [("conversion", inner), ("conversion", "next")], "b": [("conversion", f"text {k}") for k in range(1500)], "c": [("warcinfo", "")]}
    for name, bodies in files.items():
        (tmp_path / f"{name}.warc.wet.gz").write_bytes(wet(*bodies))
    cut = b"WARC/1.0\r\nWARC-Type: conversion\r\nContent-Length: 99\r\n\r\nbroken off"
    (tmp_path / "d.warc.wet.gz").write_bytes(gzip.compress(cut + b"\r\n\r\nWARC/1.0\r\nWARC-Type: x"))
    df = records.read_wet(spark, str(tmp_path))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(df.collect(), key=lambda r: r.idx):
        got.setdefault(r.wet_path[-len("a.warc.wet.gz") :][0], []).append((r.idx, r.rec_type, r.text, r.error))
    assert got["a"] == [(1, "conversion", inner, None), (2, "conversion", "next", None)]
    assert got["b"] == [(k + 1, "conversion", f"text {k}", None) for k in range(1500)] and got["c"] == [(1, "warcinfo", "", None)]
    assert got["d"][0][3] == "short" and got["d"][0][2].startswith("broken off")


def test_json_lines(spark, tmp_path):
    good = [{"text": "a", "n": 1}, {"n": 2}, {"text": None}]
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write("\n".join([json.dumps(good[0]), "", "not json", "[1]", *map(json.dumps, good[1:])]))
    assert [r.text for r in records.read_json_lines(spark, str(tmp_path)).collect()] == ["a", None, None]
    flagged = records.read_json_lines(spark, str(tmp_path), mode="flagged")
    assert flagged.where("malformed").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_json_lines(spark, str(tmp_path), mode="strict").collect()
    assert records.all_json(spark.read.text(str(tmp_path)).where("value <> ''")).first().malformed == 2


def test_lists_and_maps(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" b \n\na\n")
    assert [(r.place, r.wet_path) for r in records.read_list(spark, str(tmp_path / "list.txt"), "wet_path").collect()] == [(0, "b"), (1, "a")]
    np.save(tmp_path / "m.npy", np.array([(2**64 - 1, 65535), (3, 1)], dtype=[("k", "u8"), ("v", "u2")]))
    assert {(int(r.k), r.v) for r in records.read_hash_map(spark, str(tmp_path / "m.npy")).collect()} == {(2**64 - 1, 65535), (3, 1)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("e1", 1, "é"), ("e2", 2, "b")], "experiment string, id int, text string")
    sinks.write_json_lines(rows, f"{tmp_path}/out", by=["experiment"])
    assert "é" in gzip.open(next((tmp_path / "out/experiment=e1").glob("*.gz")), "rt").read()
    done = spark.read.json(f"{tmp_path}/out")
    sinks.write_new(spark.createDataFrame([(2, "again"), (3, "c")], "id int, text string"), f"{tmp_path}/new", done, "id")
    assert [r.id for r in spark.read.json(f"{tmp_path}/new").collect()] == [3]
    sinks.write_log(rows, f"{tmp_path}/log")
    assert spark.read.option("header", True).csv(f"{tmp_path}/log").count() == 2
    paths = spark.createDataFrame([("s", i, f"p{i}") for i in range(20)], "snapshot string, place long, wet_path string")
    split = sampling.split_shards(paths, ["snapshot"], 5, 2)
    sinks.write_manifest(split, f"{tmp_path}/manifest")
    made = spark.read.json(f"{tmp_path}/manifest").first()
    assert made.train[0] == ["p0", "p1"] and len(made.train) == 8 and made.valid == [["p16", "p17"], ["p18", "p19"]]
    frequency = lines.document_frequency(spark.createDataFrame([("s", "a\nb\na"), ("s", "a"), ("t", None)], "snapshot string, text string"), ["snapshot"])
    sinks.write_frequency(frequency, f"{tmp_path}/df", ["snapshot"])
    assert {(r.line_key, r.df) for r in spark.read.parquet(f"{tmp_path}/df").collect()} == {("a", 2), ("b", 1)}


def test_seen_before(spark):
    p = " ".join(f"w{i}" for i in range(20))
    near = p.replace("w19", "x19")
    docs = spark.createDataFrame([(1, f"{p}\nshort one"), (2, f"{near}\nshort one"), (3, f"new\n{p}\nold\n \nmore words here"), (4, None), (5, "")], "doc_id int, text string")
    left = {r.doc_id: r.text for r in dedup.drop_seen(docs).collect()}
    assert left == {1: f"{p}\nshort one", 3: "new\nold\n \nmore words here", 4: None, 5: ""}
    # 7 of 8 n-grams of the near copy are old; at a higher threshold it stays
    kept = {r.doc_id: r.text for r in dedup.drop_seen(docs, threshold=0.95, remove="paragraph").collect()}
    assert kept[2] == near


def test_what_is_removed(spark):
    docs = spark.createDataFrame([(1, "a b c d\nx y"), (2, "a b c d\nq r s t"), (3, "a b c d\nx y"), (4, "x y"), (5, None)], "doc_id int, text string")
    of = lambda **how: {r.doc_id: r.text for r in dedup.drop_seen(docs, 3, 0.5, **how).collect()}
    assert of(remove="paragraph") == {1: "a b c d\nx y", 2: "q r s t", 3: "", 4: "", 5: None}
    assert set(of(remove="document")) == {1, 2, 5} and set(of(remove="exact")) == {1, 2, 4, 5}
    assert of(remove="paragraph", least=3)[4] == "x y" and of(remove="paragraph", least=3)[3] == "x y"
    with pytest.raises(ValueError):
        dedup.drop_seen(docs, remove="none")


def test_repetition_by_word_boundaries(spark, small):
    """Against the definition, counted in Python text by text."""
    from collections import Counter

    import regex

    def passes(text):
        if not text:
            return False
        for end in ("\n", "\n\n"):
            parts = [p for p in text.split(end) if p.strip()]
            counts = Counter(parts)
            again = {p: n for p, n in counts.items() if n > 1}
            if len(parts) > 1 and (sum(again.values()) / len(parts) > 0.3 or sum(n * len(p) for p, n in again.items()) / max(1, sum(map(len, parts))) > 0.2):
                return False
        w = [x for x in regex.split(r"(?V1w)\b", text) if x and regex.match(r"[\p{L}\p{N}]", x)]
        total = max(1, sum(map(len, w)))
        for n, most in repetition.NGRAM_LIMITS.items():
            counts = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            if not counts or max(counts.values()) == 1:
                continue
            if n <= 4:
                best = max(counts.values())
                share = best * max(sum(map(len, g)) for g, c in counts.items() if c == best) / total
            else:
                inside = {j for i in range(len(w) - n + 1) if counts[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
                share = sum(len(w[j]) for j in inside) / total
            if share > most:
                return False
        return True

    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.passes for r in repetition.repetition_verdict(docs).collect()}
    assert got == {r.doc_id: passes(r.text) for r in docs.collect()} and len(set(got.values())) == 2


def test_repetition_edges(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "one line only"), (4, "a b\n\na b"), (5, " \n ")], "doc_id int, text string")
    got = {r.doc_id: r.passes for r in repetition.repetition_verdict(docs).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True}


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat and that dog of mine. " * 3 + "\n" + " ".join(f"word{i}" for i in range(60)), "2031-01-01 00:00:00")], "doc_id int, text string, at string").withColumn("at", F.to_timestamp("at"))
    docs.write.parquet(f"{tmp_path}/in")
    source = stages.read_stream(spark, f"{tmp_path}/in", "doc_id int, text string, at timestamp")
    for name, df, mode in (("c", stages.cleaned(source), "append"), ("w", stages.windowed_frequency(source, "at"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("c").count() == 1
    assert spark.table("w").agg(F.sum("df")).first()[0] == docs.select(F.size(lines_of(F.col("text")))).first()[0]


def test_curation(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = pipelines.curation(docs, lambda t: F.length(t) / F.length(t), threshold=0.5)
    assert 0 < out.count() < docs.count()
