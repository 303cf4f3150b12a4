"""The command line, step after step, on a small corpus."""

import json

import pytest
from pyspark.sql import functions as F

from loamsift.__main__ import main


def score(text):
    return F.length(text) / F.lit(100)


def is_english(text):
    return text.contains("the ")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    words = [a + b + c for a in ("ka", "lo", "mi", "ne") for b in ("ra", "so", "tu", "vi", "wo") for c in ("bel", "dan", "fir", "gos")]
    body = "\n".join(f"The {' '.join(words[8 * i : 8 * i + 4])} of {' '.join(words[8 * i + 4 : 8 * i + 8])} house." for i in range(10))
    with open(d / "docs.jsonl", "w") as f:
        for i in range(4):
            f.write(json.dumps({"doc_id": i, "snapshot": "s", "text": f"Title {i}\nHome\n{body if i else body.replace('house', 'hut')}\nEnd."}) + "\n")
    return d


def test_steps(spark, corpus):
    d = str(corpus)
    main(["count-lines", "--in", f"{d}/docs.jsonl", "--out", f"{d}/df", "--scope", "snapshot"])
    assert {r.df for r in spark.read.json(f"{d}/df").where("line_key = 'home'").collect()} == {4}
    main(["merge-counts", "--in", f"{d}/df", "--out", f"{d}/all"])
    main(["count-info", "--in", f"{d}/docs.jsonl", "--out", f"{d}/counted", "--counts", f"{d}/df", "--scope", "snapshot"])
    main(["extract", "--in", f"{d}/counted", "--out", f"{d}/bodies", "--red", "10", "--green", "2", "3", "--k", "3"])
    out = spark.read.json(f"{d}/bodies")
    assert {r.experiment for r in out.select("experiment").distinct().collect()} == {"pld-r10-g2-ptf-3", "pld-r10-g3-ptf-3"}
    main(["heuristics", "--in", f"{d}/docs.jsonl", "--out", f"{d}/clean"])
    assert spark.read.json(f"{d}/clean").count() == 4
    main(["dedup", "--in", f"{d}/clean", "--out", f"{d}/once", "--ngram", "5"])
    assert [r.doc_id for r in spark.read.json(f"{d}/once").collect()] in ([0, 1], [0], [1, 0])
    main(["quality", "--in", f"{d}/once", "--out", f"{d}/good", "--scorer", "test_cli:score", "--threshold", "1"])
    main(["pipeline", "--in", f"{d}/docs.jsonl", "--out", f"{d}/whole", "--scorer", "test_cli:score"])
    assert spark.read.json(f"{d}/good").count() > 0 and spark.read.json(f"{d}/whole").count() > 0
    main(["heuristics", "--in", f"{d}/docs.jsonl", "--out", f"{d}/clean", "--skip-existing", "doc_id"])
    assert spark.read.json(f"{d}/clean").count() == 4


def test_split(spark, corpus):
    (corpus / "paths").write_text("\n".join(f"crawl-data/{i}.warc.wet.gz" for i in range(100)))
    main(["split", "--in", f"{corpus}/paths", "--out", f"{corpus}/split", "--shards", "10", "--pieces", "2", "--seed", "4"])
    rows = spark.read.json(f"{corpus}/split")
    assert rows.count() == 100 and rows.where("split = 'valid'").count() == 10


def test_wrong_arguments(corpus):
    for args in (["heuristics"], ["baseline", "--lang", "en", "--in", "x", "--out", "y"], ["dedup", "--in", "x", "--out", "y", "--remove", "all"]):
        with pytest.raises(SystemExit):
            main(args)


def test_rows_without_ids(spark, corpus):
    """Ids given here are the same wherever the rows are read again."""
    d = str(corpus)
    with open(f"{d}/bare.jsonl", "w") as f:
        for i in range(30):
            f.write(json.dumps({"text": f"one two three four five {i // 3}\nown words of number {i} here"}) + "\n")
    main(["dedup", "--in", f"{d}/bare.jsonl", "--out", f"{d}/bare_once", "--ngram", "5", "--remove", "exact"])
    assert spark.read.json(f"{d}/bare_once").count() == 30
    main(["dedup", "--in", f"{d}/bare.jsonl", "--out", f"{d}/bare_first", "--ngram", "5", "--remove", "paragraph", "--limit", "12"])
    rows = spark.read.json(f"{d}/bare_first").collect()
    assert len(rows) == 12 and len({r.doc_id for r in rows}) == 12 and sum("one two" in r.text for r in rows) >= 4


def test_shards_of_count_info(spark, corpus):
    d = str(corpus)
    rows = [(i, "s", "train" if i < 6 else "valid", i % 6, f"Title\nline {i}\nHome") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, snapshot string, split string, shard_idx long, text string").write.mode("overwrite").parquet(f"{d}/sharded")
    spark.createDataFrame([("s", "home", 8)], "snapshot string, line_key string, df int").write.mode("overwrite").parquet(f"{d}/sharded_df")
    main(["count-info", "--format", "parquet", "--in", f"{d}/sharded", "--out", f"{d}/sharded_out", "--counts", f"{d}/sharded_df", "--scope", "snapshot", "--train", "1", "3", "--valid", "0", "1"])
    got = {r.doc_id: r["count"] for r in spark.read.parquet(f"{d}/sharded_out").collect()}
    assert got == {1: [0, 8], 2: [0, 8], 6: [0, 8]}


def test_baseline(spark, corpus):
    import gzip

    from test_sources import wet

    (corpus / "x.warc.wet.gz").write_bytes(wet(("warcinfo", "x"), ("conversion", "the text of a page"), ("conversion", "한국어 글")))
    main(["baseline", "--lang", "en", "--in", f"{corpus}/x.warc.wet.gz", "--out", f"{corpus}/en", "--english", "test_cli:is_english"])
    main(["baseline", "--lang", "ko", "--in", f"{corpus}/x.warc.wet.gz", "--out", f"{corpus}/ko"])
    assert [r.text for r in spark.read.json(f"{corpus}/en").collect()] == ["the text of a page"]
    assert [r.text for r in spark.read.json(f"{corpus}/ko").collect()] == ["한국어 글"]
    assert gzip.open(next((corpus / "ko").glob("*.gz")), "rt").read().count("\n") == 1
