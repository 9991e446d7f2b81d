"""The same analyses over logs that are still being written.

Files of a directory are read as they appear.  Windows of event time close by watermark, so the lists that exact
percentiles need are bounded by a window.  A stream can't number lines: ``line_no`` is where a split begins, and
nothing here depends on the order of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyses import error_events
from ..operators.classify import classified
from ..operators.documents import parsed, staged
from ..operators.metrics import derived, p95, percent, planning, ranked_values, vocabulary
from ..sources.lines import with_shard
from ..sources.rules import FilterRules


def read_stream(spark: SparkSession, directory: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.load(directory).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("line_no"), "value")
    return with_shard(rows)


def live_documents(lines: DataFrame, rules: FilterRules | None = None, late: str = "10 minutes") -> DataFrame:
    docs = parsed(staged(lines, rules).filter("stage = 'kept'"))
    return docs.withColumn("t", F.timestamp_millis("t_ms")).withWatermark("t", late)


def _by_window(rows: DataFrame, keys: list[str], window: str, slide: str | None, aggregates: list, percentiles: dict) -> DataFrame:
    lists = [F.coalesce(p95(v), F.lit(0.0)).alias(name) for name, v in percentiles.items()]
    return derived(rows.groupBy(F.window("t", window, slide), *keys).agg(*aggregates, *lists))


def _operations(docs: DataFrame, namespaces: list[str] | None) -> DataFrame:
    return classified(docs, namespaces).filter("status = 'op'")


def live_operations(docs: DataFrame, window: str = "5 minutes", slide: str | None = None, namespaces: list[str] | None = None) -> DataFrame:
    """A1 by window of time."""
    return _by_window(_operations(docs, namespaces), ["db", "coll", "op", "appName"], window, slide, vocabulary(docs_need_keys=True), ranked_values(docs_need_keys=True))


def live_query_hash(docs: DataFrame, window: str = "5 minutes", slide: str | None = None, namespaces: list[str] | None = None) -> DataFrame:
    """A3 by window of time, without the summaries of values."""
    rows = _operations(docs, namespaces).filter("queryHash IS NOT NULL")
    out = _by_window(rows, ["queryHash", "ns", "op"], window, slide, [*vocabulary(), *planning()], ranked_values(planning=True))
    return out.withColumn("replannedPct", percent(F.col("replannedCount"), F.col("count"))).withColumn("multiPlannerPct", percent(F.col("multiPlannerCount"), F.col("count")))


def live_index_stats(docs: DataFrame, window: str = "5 minutes", slide: str | None = None, namespaces: list[str] | None = None) -> DataFrame:
    """A7 by window of time."""
    rows = _operations(docs, namespaces).filter("ns IS NOT NULL AND planSummary IS NOT NULL")
    out = _by_window(rows, ["ns", "planSummary"], window, slide, vocabulary(), {"p95Ms": F.col("durationMillis")})
    return out.withColumn("isCollScan", F.col("planSummary").contains("COLLSCAN"))


def live_errors(docs: DataFrame, window: str = "5 minutes") -> DataFrame:
    """A5 by window of time."""
    events = docs.select("file", "line_no", "shard", "node", "doc", "msg", "t")
    exploded = error_events(events.withColumn("file", F.struct("file", "t"))).select(F.col("file.t").alias("t"), "codeName")
    return exploded.withWatermark("t", "10 minutes").groupBy(F.window("t", window), "codeName").agg(F.count("*").alias("count"))


__all__ = ["live_documents", "live_errors", "live_index_stats", "live_operations", "live_query_hash", "read_stream"]
