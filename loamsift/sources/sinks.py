"""Writing results; Spark's committer renames finished files into place, so a lost task leaves no half file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(rows: DataFrame, path: str, by: list[str] | None = None, compressed: bool = True, mode: str = "error") -> None:
    """JSON lines, in one folder for each value of the columns ``by`` (snapshot, experiment)."""
    writer = rows.write.mode(mode).option("compression", "gzip" if compressed else "none")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_new(rows: DataFrame, path: str, done: DataFrame | None, key: str) -> None:
    """Append the rows whose key is not among those done: a restart goes on where the last run ended."""
    write_json_lines(rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti"), path, mode="append")


def write_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_frequency(maps: DataFrame, path: str, scope: list[str]) -> None:
    """Line counts as Parquet by scope, in key order so that lookups skip row groups."""
    maps.repartition(*scope).sortWithinPartitions("line_key").write.mode("overwrite").partitionBy(*scope).parquet(path)


def write_manifest(split: DataFrame, path: str, path_col: str = "wet_path") -> None:
    """One JSON row with the lists of paths of each piece of the train and valid split; a list of files is small."""
    pieces = split.groupBy("split", "shard_idx").agg(F.sort_array(F.collect_list(path_col)).alias("paths"))
    of = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("split") == s, F.struct("shard_idx", "paths")))), lambda x: x["paths"])
    pieces.agg(of("train").alias("train"), of("valid").alias("valid")).coalesce(1).write.mode("overwrite").json(path)
