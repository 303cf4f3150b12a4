"""Crawl archives, JSON lines and lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

LANGUAGE_HEADER = "WARC-Identified-Content-Language"


def read_wet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(wet_path, idx from 1, rec_type, headers, text, error) of gzipped WET files, without a shuffle.

    A gzipped file cannot be split, so one task reads it from its first record to its last, record by
    record, and numbers them as they come. A record begins after the blank lines that end the one before
    it; where its Content-Length says that it is longer, what follows belongs to it, whatever it looks
    like. Headers keep the first of several of a name. A record without a blank line after its headers
    has a null text and error ``no body``; one that ends before its Content-Length has error ``short``,
    and what there is of its text. Files that are not gzipped are read whole by one task each.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.option("lineSep", _RECORD_END + _RECORD_BEGIN).text(paths).select(F.input_file_name().alias("wet_path"), "value")
    return rows.mapInArrow(_wet_records, "wet_path string, idx long, rec_type string, headers map<string,string>, text string, error string")


_RECORD_BEGIN, _RECORD_END = "WARC/1.0\r\n", "\r\n\r\n"
#: Records that are sent on together.
_WET_ROWS = 512


def _wet_record(piece: str) -> tuple[str | None, list[tuple[str, str]], str | None, int | None]:
    """Type, headers, body and stated length of a record."""
    head, blank, body = piece.partition(_RECORD_END)
    headers: dict[str, str] = {}
    for line in head.split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            headers.setdefault(name.strip(), value.strip())
    by_name = {name.lower(): value for name, value in reversed(headers.items())}
    length = by_name.get("content-length", "")
    return by_name.get("warc-type"), list(headers.items()), body if blank else None, int(length) if length.isdigit() else None


def _wet_records(batches):
    import pyarrow as pa

    schema = pa.schema([("wet_path", pa.string()), ("idx", pa.int64()), ("rec_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("error", pa.string())])
    out: list[tuple] = []
    at, number, held = None, 0, None  # the record at hand waits for what may belong to it

    def close():
        nonlocal held, number
        if held is not None:
            number += 1
            kind, headers, body, length = held
            size = None if body is None else len(body.encode("utf-8", "surrogatepass"))
            if body is not None and size > (length or 0) and body.endswith(_RECORD_END):
                body = body[: -len(_RECORD_END)]  # the last record of a file
            error = "no body" if body is None else "short" if length is not None and size < length else None
            out.append((at, number, kind, headers, body, error))
        held = None

    def batch():
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for rows in batches:
        for path, piece in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if path != at:
                close()
                at, number = path, 0
                piece = piece.removeprefix(_RECORD_BEGIN)
                if not piece.strip():
                    continue
            elif held is not None and held[2] is not None and held[3] is not None and len(held[2].encode("utf-8", "surrogatepass")) + len(_RECORD_END + _RECORD_BEGIN) <= held[3]:
                held = (*held[:2], held[2] + _RECORD_END + _RECORD_BEGIN + piece, held[3])
                continue
            close()
            held = _wet_record(piece)
            if len(out) >= _WET_ROWS:
                yield batch()
    close()
    if out:
        yield batch()


def header(headers: Column, name: str) -> Column:
    """A header's value without regard to case; null where it is missing."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())), F.lit(0))


def conversions(records: DataFrame) -> DataFrame:
    return records.where(F.col("rec_type") == "conversion")


def baseline(records: DataFrame) -> DataFrame:
    """Conversion records without the header that names their language."""
    return conversions(records).withColumn("headers", F.map_filter("headers", lambda k, v: k != LANGUAGE_HEADER))


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str = "text string", mode: str = "tolerant", recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """Documents of JSON-lines files, gzipped by their suffix.

    mode ``tolerant`` passes over blank and malformed lines and lines that are no object, ``strict``
    fails on them, ``flagged`` keeps them with ``malformed`` true and all fields null.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if mode == "strict":
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    lines = reader.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"), F.col("value").rlike(r"^\s*\{").alias("object"))
    good = F.col("x").isNotNull() & F.col("x._bad").isNull() & F.col("object")
    if mode == "flagged":
        return parsed.select("x.*", (~good).alias("malformed")).drop("_bad")
    return parsed.where(good).select("x.*").drop("_bad")


def read_list(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(place from 0, name): stripped lines of a text file in file order; the file is small and read whole."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.transform(F.split("value", "\n"), strip), lambda x: x != "")
    return whole.select(F.posexplode(lines).alias("place", name))


def read_hash_map(spark: SparkSession, path: str) -> DataFrame:
    """(k decimal(20,0), v int) of .npy files of structured arrays of uint64 keys and uint16 values."""
    import io
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import decimal

        import numpy as np

        for batch in batches:
            for raw in batch["content"]:
                a = np.load(io.BytesIO(raw))
                yield pd.DataFrame({"k": [decimal.Decimal(int(k)) for k in a["k"]], "v": a["v"].astype("int32")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "k decimal(20,0), v int")


def existing_or_raw(spark: SparkSession, files: DataFrame, extracted: DataFrame, path_col: str = "wet_path") -> tuple[DataFrame, DataFrame]:
    """files split into those with an extracted copy and those to be read raw."""
    return files.join(extracted.select(path_col), path_col, "left_semi"), files.join(extracted.select(path_col), path_col, "left_anti")


def rewritten(path: Column, base: str, suffix: str = ".json.gz") -> Column:
    """Where a WET file's extract lies under ``base``."""
    return F.replace(F.replace(path, F.lit("crawl-data"), F.lit(base)), F.lit(".warc.wet.gz"), F.lit(suffix))


def all_json(rows: DataFrame, text_col: str = "value") -> DataFrame:
    """One row: how many lines are no JSON object."""
    return rows.agg(F.count_if(F.from_json(F.col(text_col), "map<string,string>").isNull()).alias("malformed"))
