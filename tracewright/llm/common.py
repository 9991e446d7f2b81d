"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import new_folder, removed, shared_folder

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch that a Python worker gets at once; a single longer row makes a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: any executor may be lost afterwards."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """Checkpointed rows for the next round of a loop, without the size that was estimated for them.

    A checkpoint keeps that estimate, and a join's is the product of its sides': carried from round to round the number's
    digits multiply, until the driver's memory holds little else.
    """
    saved = checkpointed(df)
    session = saved.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(saved._jdf.queryExecution().toRdd(), saved._jdf.schema(), False), session)


def partitions_for(units: int | float | None, per_partition: int, least: int = 12) -> int:
    """A partition count that grows with the data, so that one partition stays of bounded size."""
    return max(least, -(-int(units or 0) // per_partition))


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; batches that Python workers get of them are bounded by bytes, not by rows alone."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def give_back() -> None:
    """Workers live on between tasks: return what this one's batches took to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_arrow(rows: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow in batches of bounded bytes, by workers that don't keep the memory they took."""

    def run(batches):
        yield from function(batches)
        give_back()

    return bounded(rows).mapInArrow(run, schema)


__all__ = ["BATCH_BYTES", "WORD", "bounded", "checkpointed", "give_back", "in_arrow", "new_folder", "partitions_for", "removed", "table", "unsized"]
