"""Order, shards and samples of file lists.

Lists of files are small beside their contents, yet nothing here collects them: numbers come from
windows within a snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / b)


def numbered(paths: DataFrame, by: list[str], order: list, name: str = "idx") -> DataFrame:
    """paths with their place from 0 within ``by``."""
    return paths.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def shuffled(paths: DataFrame, by: list[str], path_col: str = "wet_path", seed: int = 0) -> DataFrame:
    """paths with ``place``, their number in an order drawn from the seed."""
    return numbered(paths, by, [F.xxhash64(F.lit(seed), F.col(path_col)), path_col], "place")


def split_shards(placed: DataFrame, by: list[str], shards: int, pieces: int = 1, valid: int = 1) -> DataFrame:
    """Shuffled paths with ``piece``, its number in the split, and split = train or valid.

    The paths of a snapshot are cut into ``shards`` equal runs (the last may be shorter), each into
    ``pieces``; the last ``valid`` shards are for validation.
    """
    total = F.count("*").over(Window.partitionBy(*by))
    size = F.greatest(ceil_div(total, shards * pieces), F.lit(1))
    piece = F.floor(F.col("place") / size)
    first_valid = (shards - valid) * pieces
    return placed.withColumn("piece", piece).withColumn("split", F.when(F.col("piece") >= first_valid, "valid").otherwise("train")).withColumn("shard_idx", F.when(F.col("piece") >= first_valid, F.col("piece") - first_valid).otherwise(F.col("piece")))


def chunks(placed: DataFrame, size: int, place_col: str = "file_idx") -> DataFrame:
    """Consecutive runs of ``size`` files."""
    return placed.withColumn("chunk", F.floor(F.col(place_col) / size))


def shard(placed: DataFrame, shard_id: int, total: int, place_col: str = "file_idx") -> DataFrame:
    return placed.where(F.pmod(F.col(place_col), F.lit(total)) == shard_id)


def sliced(split: DataFrame, train: tuple[int, int], valid: tuple[int, int]) -> DataFrame:
    """Paths of the train and valid shards from the first number up to, not including, the second."""
    return split.where(((F.col("split") == "train") & F.col("shard_idx").between(train[0], train[1] - 1)) | ((F.col("split") == "valid") & F.col("shard_idx").between(valid[0], valid[1] - 1)))


def first_rows(rows: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each file; all for 0 and less."""
    if limit <= 0:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= limit).drop("_n")


def allowed(files: DataFrame, listed: DataFrame, path_col: str = "wet_path") -> DataFrame:
    return files.join(listed.select(path_col), path_col, "left_semi")


def pending(files: DataFrame, done: DataFrame, path_col: str = "wet_path") -> DataFrame:
    return files.join(done.select(path_col), path_col, "left_anti")


def scope_blocks(paths: DataFrame, files: int = 1000, place_col: str = "file_idx") -> DataFrame:
    """paths with ``block``: consecutive files of a snapshot whose lines are counted together."""
    return paths.withColumn("block", F.floor(F.col(place_col) / files))
