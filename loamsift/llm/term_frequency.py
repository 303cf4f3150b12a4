"""Occurrences and records of every term, by suffix arrays.

Each block of records gets one suffix array over its terms (see suffix_array), from which n-grams of any
length are read: their occurrences are intervals of common prefixes, their records these less the
adjacencies within one record. A record lies in one block, hence the counts of blocks add up: Spark sums
(term, occurrences, records) after a first summing inside each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .chars import LETTER, blocks
from .suffix_array import SuffixArray

#: Terms a task keeps before it sends its sums on.
KEEP = 200_000


class _Sums:
    """Counts of a task, by n and term."""

    def __init__(self):
        self.counts: dict[tuple[int, str], list[int]] = {}

    def add(self, n: int, terms: list[str], occurrences: np.ndarray, records: np.ndarray):
        for t, o, r in zip(terms, occurrences.tolist(), records.tolist()):
            if c := self.counts.get((n, t)):
                c[0] += o
                c[1] += r
            else:
                self.counts[n, t] = [o, r]
        if len(self.counts) > KEEP:
            yield self.out()

    def out(self) -> dict:
        counts, self.counts = self.counts, {}
        return {"n": [k[0] for k in counts], "term": [k[1] for k in counts], "occurrences": [c[0] for c in counts.values()], "records": [c[1] for c in counts.values()]}


_DDL = "n int, term string, occurrences long, records long"


def _summed(partial: DataFrame) -> DataFrame:
    return partial.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def text_term_counts(texts: DataFrame, text_col: str = "text", lengths: tuple[int, ...] = (1,)) -> DataFrame:
    """(n, term, occurrences, records) of all n-grams of the given lengths in words, words being the longest runs of letters of the lower-cased text, n-grams written with single blanks.

    Every row is a record; null and empty texts hold no term. Repeated rows count again.
    """

    class Count(_Sums):
        def __call__(self, batch):
            for _, block in blocks(batch.column(0).to_pylist()):
                begin, end, record = block.runs(LETTER)
                if not len(begin):
                    continue
                _, head, ids = np.unique(block.hashes(begin, end), return_index=True, return_inverse=True)
                words = [block.joined[a:b] for a, b in zip(begin[head].tolist(), end[head].tolist())]
                suffixes = SuffixArray(ids, record)
                for n in lengths:
                    at, occurrences, records = suffixes.counts(n)
                    terms = [words[i] for i in ids[at].tolist()] if n == 1 else [" ".join(words[j] for j in ids[a : a + n].tolist()) for a in at.tolist()]
                    yield from self.add(n, terms, occurrences, records)

        def finish(self):
            if self.counts:
                yield self.out()

    return _summed(map_batches(texts.select(F.lower(text_col).alias("_text")).where("_text <> ''"), Count, _DDL))


def value_term_counts(rows: DataFrame, record_col: str, values_col: str, salts: int = 4) -> DataFrame:
    """(n = 1, term, occurrences, records) of the elements of an array column, written as strings; a record is all rows of one value of record_col.

    Null arrays and null elements count nothing; rows with a null record are one record.
    """
    rows = rows.select(F.col(record_col).cast("string").alias("_record"), F.filter(F.transform(values_col, lambda x: x.cast("string")), lambda x: x.isNotNull()).alias("_values")).where("size(_values) > 0")
    # a record's equal terms meet in one task; the terms of a hot record spread over several
    share = lambda s: F.struct(s.alias("salt"), F.filter("_values", lambda x: F.pmod(F.hash(x), F.lit(salts)) == s).alias("values"))
    rows = rows.select("_record", F.explode(F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), share)).alias("part")).where("size(part.values) > 0")
    rows = rows.repartition("_record", "part.salt").sortWithinPartitions("_record").select("_record", F.col("part.values").alias("_values"))

    class Count(_Sums):
        """Counts a record once the next one begins; of the one at hand only its distinct terms are kept."""

        def __init__(self):
            super().__init__()
            self.record, self.terms = (), {}

        def __call__(self, batch):
            values = batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1)
            flat = values.flatten().dictionary_encode()
            ids = flat.indices.to_numpy(zero_copy_only=False)
            words = flat.dictionary.to_pylist()
            names = batch.column(0).to_pylist()
            owner, k = [], -1
            last = object()
            for name in names:
                if name != last:
                    last, k = name, k + 1
                owner.append(k)
            record = np.repeat(owner, values.value_lengths().to_numpy(zero_copy_only=False))
            # the records that touch the batch's ends may go on in other batches
            edges = {0: names[0], owner[-1]: names[-1]}
            inner = ~np.isin(record, list(edges))
            for k, name in edges.items():
                if self.record != (name,):
                    yield from self.close()
                    self.record = (name,)
                if k == 0 and inner.any():
                    yield from self.take(ids[record == 0], words)
                    yield from self.close()
                    at, occurrences, records = SuffixArray(ids[inner], record[inner]).counts(1)
                    yield from self.add(1, [words[i] for i in ids[inner][at].tolist()], occurrences, records)
                else:
                    yield from self.take(ids[record == k], words)

        def take(self, ids, words):
            for i, n in zip(*(x.tolist() for x in np.unique(ids, return_counts=True))):
                self.terms[words[i]] = self.terms.get(words[i], 0) + n
            return ()

        def close(self):
            terms, self.terms, self.record = self.terms, {}, ()
            if terms:
                yield from self.add(1, list(terms), np.array(list(terms.values())), np.ones(len(terms), np.int64))

        def finish(self):
            yield from self.close()
            if self.counts:
                yield self.out()

    return _summed(map_batches(rows, Count, _DDL))


def marked(counts: DataFrame, total: int, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """counts with ``mark``: rare in fewer than rare_below records, common in more than the share common_above of the total records, else null."""
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total, "common"))
