"""Running functions over Arrow batches of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import ship_package

#: Rows sent to Python at once: texts are handled in blocks anyway, so larger batches only hold memory.
ROWS = 2048


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else _parse_datatype_string(ddl))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], ddl: str) -> DataFrame:
    """``make()`` runs once a task and gives a function from a batch to dicts of columns named by ``ddl``."""
    ship_package(df.sparkSession)
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                for columns in each(batch.slice(k, ROWS)):
                    yield to_batch(columns, schema)
        for columns in getattr(each, "finish", lambda: ())():
            yield to_batch(columns, schema)

    return df.mapInArrow(run, ddl)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def list_array(values, counts, kind: pa.DataType) -> pa.ListArray:
    """Lists of the given lengths, cut from one flat array."""
    import numpy as np

    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
