"""Labelled rows, for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(key).cast("string")) % folds


def chosen(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest hashes of doc_id."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def text_key() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def mapped(rows: DataFrame, function, schema: str, kinds: dict[str, pa.DataType]) -> DataFrame:
    """Apply ``function`` (lists of columns in, an iterable of row tuples out) to each batch."""

    def run(batches):
        for batch in batches:
            out = list(function(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))

    return in_arrow(rows, run, schema)
