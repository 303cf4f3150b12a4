"""Filters of fixed size, made of a table of 64-bit hashes, that spare tasks what an exact join after them would drop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U64 = np.uint64
#: 8 MB, whatever the collection. A table of very many hashes fills it, and it lets more through.
FILTER_BITS = 1 << 26


def filter_of(rows: DataFrame, column: str) -> np.ndarray:
    """A bit set for each hash of a column, as 64-bit words; FILTER_BITS / 64 rows come to the driver at most."""
    bit = F.col(column).bitwiseAND(FILTER_BITS - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    words = rows.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, _U64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(_U64)
    return out


def maybe_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the table the filter was made of; never False for one that is."""
    at = hashes & _U64(FILTER_BITS - 1)
    return (bits[(at >> _U64(6)).astype(np.int64)] >> (at & _U64(63))) & _U64(1) != 0
