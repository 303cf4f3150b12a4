"""Command line: python -m loamsift STEP --in PATH... --out PATH [options].

Input and output are JSON lines or Parquet by --format; a step reads what the one before it wrote.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dedup, heuristics, lines, patterns, quality, sampling
from .plans import pipelines
from .session import shared_folder, ship_package
from .sources import records, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamsift", description=__doc__)
    steps = p.add_subparsers(dest="step", required=True)

    def step(name: str, help_: str) -> argparse.ArgumentParser:
        s = steps.add_parser(name, help=help_)
        s.add_argument("--in", dest="source", nargs="+", required=True)
        s.add_argument("--out", required=True)
        s.add_argument("--format", choices=["json", "parquet"], default="json")
        s.add_argument("--file-pattern", default=None)
        s.add_argument("--limit", type=int, default=0, help="first rows for a trial run; 0 for all")
        s.add_argument("--skip-existing", metavar="KEY", default=None, help="append only rows whose KEY is not in --out")
        return s

    s = step("baseline", "documents of WET files in one language")
    s.add_argument("--lang", choices=["en", "ko"], required=True)
    s.add_argument("--english", default=None, metavar="MODULE:FUNCTION", help="a function from the text column to a boolean one; needed for en")
    s = step("count-lines", "in how many documents each line occurs")
    s.add_argument("--scope", nargs="*", default=[])
    s = step("merge-counts", "counts of finer scopes as one")
    s.add_argument("--scope", nargs="*", default=[])
    s = step("count-info", "texts without title with the counts of their lines")
    s.add_argument("--counts", required=True)
    s.add_argument("--scope", nargs="*", default=[])
    s.add_argument("--train", type=int, nargs=2, metavar=("FROM", "TO"), default=None, help="shard_idx of the train split to take, TO not included")
    s.add_argument("--valid", type=int, nargs=2, metavar=("FROM", "TO"), default=None)
    s = step("extract", "lines kept by the patterns; several values make a grid")
    for name, default in (("--red", [1000]), ("--green", [1])):
        s.add_argument(name, type=int, nargs="+", default=default)
    s.add_argument("--k", type=int, nargs="*", default=[3], help="without a value only the first pattern")
    s = step("heuristics", "document filters and line modifiers")
    s.add_argument("--shard-id", type=int, default=0)
    s.add_argument("--total-shards", type=int, default=1)
    s.add_argument("--word-model", choices=["split", "fasttext", "uniseg"], default="uniseg")
    s = step("dedup", "without what was seen before")
    s.add_argument("--ngram", type=int, default=13)
    s.add_argument("--min-words", type=int, default=1, help="paragraphs of fewer words are passed over")
    s.add_argument("--threshold", type=float, default=0.8)
    s.add_argument("--remove", choices=dedup.REMOVE, default="both")
    s = step("quality", "documents a scorer rates at the threshold or above")
    s.add_argument("--threshold", type=float, default=0.018112)
    s.add_argument("--scorer", required=True, metavar="MODULE:FUNCTION", help="a function from the text column to a score")
    s = step("pipeline", "heuristics, dedup and quality in one plan")
    s.add_argument("--threshold", type=float, default=0.018112)
    s.add_argument("--scorer", required=True, metavar="MODULE:FUNCTION")
    s = step("split", "file lists as train and valid shards")
    s.add_argument("--shards", type=int, default=1001)
    s.add_argument("--pieces", type=int, default=5)
    s.add_argument("--valid", type=int, default=1)
    s.add_argument("--seed", type=int, default=0)
    return p


def _function(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.format == "parquet":
        rows = spark.read.parquet(*a.source)
    else:
        reader = spark.read.option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED")
        rows = (reader.option("pathGlobFilter", a.file_pattern) if a.file_pattern else reader).json(a.source)
    if a.limit > 0:
        rows = rows.limit(a.limit)
    if "doc_id" in rows.columns or "text" not in rows.columns:
        return rows
    # ids by place differ between two scans, so they are written once for the steps that join the rows with themselves
    written = f"{shared_folder(spark)}/rows"
    rows.withColumn("doc_id", F.monotonically_increasing_id()).write.parquet(written)
    return spark.read.parquet(written)


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.step == "baseline":
        wet = records.read_wet(spark, a.source)
        return (pipelines.korean_baseline(wet) if a.lang == "ko" else pipelines.english_baseline(wet, _function(a.english))).drop("error")
    if a.step == "split":
        paths = records.read_list(spark, a.source[0], "wet_path").withColumn("snapshot", F.lit(""))
        return sampling.split_shards(sampling.shuffled(paths, ["snapshot"], seed=a.seed), ["snapshot"], a.shards, a.pieces, a.valid).drop("snapshot")
    rows = _read(spark, a)
    if a.step == "count-lines":
        return lines.document_frequency(rows, a.scope)
    if a.step == "merge-counts":
        return lines.merged(rows, a.scope)
    if a.step == "count-info":
        if a.train or a.valid:
            rows = sampling.sliced(rows, tuple(a.train or (0, 0)), tuple(a.valid or (0, 0)))
        counts = spark.read.parquet(a.counts) if a.format == "parquet" else spark.read.json(a.counts)
        return lines.count_info(rows, counts, a.scope)
    if a.step == "extract":
        k = a.k or None
        grid = patterns.grid(patterns.counted(rows.withColumn("count", F.col("count").cast("array<int>"))), a.red, a.green, k)
        kept = patterns.pld(grid, F.col("red"), F.col("green"))
        return patterns.extracted(patterns.ptf(kept, F.col("k")) if k else kept, "experiment", "doc_id")
    if a.step == "heuristics":
        if a.total_shards > 1:
            rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(a.total_shards)) == a.shard_id)
        return heuristics.heuristics(rows, word_model=a.word_model)
    if a.step == "dedup":
        return dedup.drop_seen(rows, a.ngram, a.threshold, remove=a.remove, least=a.min_words)
    score = _function(a.scorer)
    return quality.with_quality(rows, score, a.threshold) if a.step == "quality" else pipelines.curation(rows, score, a.threshold)


def main(args: list[str]) -> None:
    p = parser()
    a = p.parse_args(args)
    if a.step == "baseline" and a.lang == "en" and not a.english:
        p.error("baseline --lang en needs --english, which tells English texts from others")
    spark = SparkSession.builder.appName(f"loamsift {a.step}").getOrCreate()
    ship_package(spark)
    rows = result(spark, a)
    if a.skip_existing:
        try:
            done = spark.read.json(a.out) if a.format == "json" else spark.read.parquet(a.out)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        if a.format == "json":
            return sinks.write_new(rows, a.out, done, a.skip_existing)
        rows = rows if done is None else rows.join(done.select(a.skip_existing).distinct(), a.skip_existing, "left_anti")
        return rows.write.mode("append").parquet(a.out)
    by = ["experiment"] if a.step == "extract" else None
    if a.format == "json":
        sinks.write_json_lines(rows, a.out, by)
    else:
        (rows.write.partitionBy(*by) if by else rows.write).parquet(a.out)


if __name__ == "__main__":
    main(sys.argv[1:])
