"""One query an operator: tables rendered as log files go through the whole path from files to result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import LogAnalysis, trim_logs
from ..functions import redact, text
from ..operators import analyses as a
from ..operators import classify
from ..operators import drivers as d
from ..operators.metrics import ranked_p95
from ..sources.lines import base_name, read_lines
from . import bridge
from .oracles import ORACLES

MAIN = ["db", "coll", "op", "appName", "count", "minMs", "maxMs", "avgMs", "p95Ms", "totalSec", "avgKeys", "avgDocs", "p95Keys", "p95Docs", "totalKeysK", "totalDocsK", "avgReturned", "exRetRatio"]
MORE = ["avgShards", "avgReslen", "avgBytesRead", "maxBytesRead", "avgBytesWritten", "maxBytesWritten", "avgWriteConflicts", "errorCount"]
METRICS = MAIN[4:]
PLANNING = ["minPlanMs", "maxPlanMs", "avgPlanMs", "p95PlanMs", "replannedCount", "multiPlannerCount"]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles to six places."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns))


def logs(spark: SparkSession, sf_dir: str, *kinds: str, **options) -> LogAnalysis:
    return LogAnalysis(spark, bridge.log_files(spark, sf_dir, *kinds), **options)


def events(spark: SparkSession, sf_dir: str, **options) -> LogAnalysis:
    return logs(spark, sf_dir, "events", **options)


def by_shard(spark: SparkSession, sf_dir: str, kind: str = "sharded") -> LogAnalysis:
    return logs(spark, sf_dir, kind, by_shard=True)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _value_counts(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = events(spark, sf_dir).query_hash()
        return found.filter(F.col(name).isNotNull()).select("queryHash", "ns", "op", name, f"top{name[0].upper()}{name[1:]}")

    return query


def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events(spark, sf_dir).main_operations()
    sample = lambda path: F.get_json_object("sample", path)
    found = found.withColumn("sampleTime", sample("$.t.$date")).withColumn("sampleReslen", sample("$.attr.reslen").cast("long"))
    return rounded(found, *MAIN, *MORE, "sampleTime", "sampleReslen", "isMirrored", "hasCollScan")


def _drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs(spark, sf_dir, "connections").drivers()
    return found.withColumn("sampleMetadata", F.get_json_object("sampleMetadata", "$.attr.remote")).withColumn("sampleAuth", F.get_json_object("sampleAuth", "$.ctx"))


def _lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = logs(spark, sf_dir, "connections").documents
    return d.lifetimes(d.metadata(docs), d.connection_ends(docs)).select(base_name(F.col("file")).alias("file"), "conn_id", "lifetimeMs")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain files of one name, gzip and zip, the first twenty lines of each, and a path that is skipped."""
    lines, skipped = read_lines(spark, bridge.packed_files(spark, sf_dir), line_limit=20)
    name = F.regexp_extract("file", r"((?:[ab]/)?[^/!]+(?:!.*)?)$", 1)
    return lines.groupBy(name.alias("name"), "shard", "node").agg(F.count("*").alias("lines"), F.sum(F.get_json_object("value", "$.attr.durationMillis").cast("long")).alias("durations"), F.lit(len(skipped)).cast("long").alias("skipped"))


def _node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 6
    tags = F.element_at(F.array(*map(F.lit, ("nodeType: analytics", "x: y<br>workloadType: operational", "region: r, provider: p", "role: analytics, nodeType: voting", "region: r", "a: b<br>region: r, provider: p"))), (e + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", classify.node_type(tags).alias("node"))


def _atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.concat(F.lit("atlas-ab"), F.col("user_id").cast("string"), F.lit("-shard-00-0"), (F.col("event_id") % 3).cast("string"), F.lit(".x1y2z.mongodb.net:27017"))
    return _table(spark, sf_dir, "events").select("user_id", "event_id", text.mask_atlas(host).alias("masked"))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("user_id") % 250).cast("string")
    remote = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10.0.0."), n, F.lit(":27017"))).otherwise(F.concat(F.lit("[fe80::"), n, F.lit("]:27017")))
    return _table(spark, sf_dir, "events").select("event_id", text.host_of(remote).alias("host"))


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).lines.select("line_no", redact.redacted(F.col("value")).alias("value"))


def _trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim_logs(events(spark, sf_dir).lines, aggressive=True, redact=True).select("line_no", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_files": _files,
    "scan_connections": lambda s, p: LogAnalysis(s, bridge.packed_files(s, p)).appname_connections(),
    "main_operations": _main,
    "main_operations_summary": lambda s, p: events(s, p).main_summary(),
    "main_operations_by_shard": lambda s, p: rounded(by_shard(s, p).main_operations(), "shard", "node", *MAIN),
    "main_operations_search": lambda s, p: rounded(a.text_search(events(s, p).main_operations(), "LIC", "coll"), *MAIN),
    "read_ops": lambda s, p: rounded(a.reads(events(s, p).main_operations()), *MAIN),
    "write_ops": lambda s, p: rounded(a.writes(events(s, p).main_operations()), *MAIN),
    "ops_by_operation": lambda s, p: rounded(a.by_operation(events(s, p).main_operations(), "find"), *MAIN),
    "ops_by_namespace": lambda s, p: rounded(a.by_namespace(events(s, p).main_operations(), "app", "click"), *MAIN),
    "collscan_ops": lambda s, p: a.collscans(events(s, p).main_operations()).select("db", "coll", "op", "appName", "count"),
    "write_operations": lambda s, p: rounded(logs(s, p, "writes").main_operations(), "db", "coll", "op", "appName", "count", "minMs", "maxMs", "p95Ms", "avgReturned"),
    "command_operations": lambda s, p: logs(s, p, "commands").main_operations(change_stream_label=True).select("db", "coll", "op", "count", "minMs", "maxMs"),
    "command_labels": lambda s, p: rounded(logs(s, p, "commands").op_type_stats(), "label", "count", "pct"),
    "command_filters": lambda s, p: logs(s, p, "commands").operations.groupBy("op", "sanitizedFilter").agg(F.count("*").alias("count")),
    "ns_filter_exact": lambda s, p: rounded(events(s, p, namespaces=["app.$cmd"]).main_operations(), *MAIN),
    "ns_filter_db": lambda s, p: rounded(events(s, p, namespaces=["shop", "other.*"]).main_operations(), *MAIN),
    "ns_filter_glob": lambda s, p: rounded(events(s, p, namespaces=["sh*.$c*"]).main_operations(), *MAIN),
    "query_hash": lambda s, p: rounded(events(s, p).query_hash(), "queryHash", "ns", "op", *METRICS, *PLANNING, "planSummary", "appName", "sanitizedFilter", "replannedPct", "multiPlannerPct"),
    "query_hash_summary": lambda s, p: a.query_hash_summary(events(s, p).query_hash()),
    "query_hash_read_prefs": _value_counts("readPreferences"),
    "query_hash_tags": _value_counts("readPreferenceTags"),
    "query_hash_replan_reasons": _value_counts("replanReasons"),
    "query_hash_by_shard": lambda s, p: rounded(by_shard(s, p).query_hash(), "shard", "node", "queryHash", "ns", "op", *METRICS),
    "query_hash_top100": lambda s, p: a.query_hash_top(events(s, p).query_hash()).select("queryHash", "ns", "op", "count"),
    "plan_cache": lambda s, p: rounded(events(s, p).plan_cache(), "ns", "op", "queryHash", "planSummary", *METRICS, *PLANNING, "collScanCount", "collScanPct", "replannedPct", "multiPlannerPct", "readPreference", "meanShards"),
    "plan_cache_by_shard": lambda s, p: rounded(by_shard(s, p).plan_cache(), "shard", "node", "ns", "op", "queryHash", "planSummary", *METRICS),
    "plan_cache_multi_plan": lambda s, p: a.multi_plan(events(s, p).plan_cache()).select("ns", "op", "queryHash", "planSummary", "count", "plans", "hashCount"),
    "plan_cache_summary": lambda s, p: rounded(a.plan_cache_summary(events(s, p).plan_cache()), "totalCount", "entries", "queryHashes", "collScanPct", "replannedPct", "multiPlannerPct"),
    "replan_reasons_top5": lambda s, p: a.replan_reasons_top(events(s, p).plan_cache()),
    "index_stats": lambda s, p: rounded(events(s, p).index_stats(), "ns", "planSummary", "count", "minMs", "maxMs", "avgMs", "p95Ms", "totalSec", "avgKeys", "avgDocs", "avgReturned", "examinedReturnedRatio", "isCollScan"),
    "index_stats_by_shard": lambda s, p: rounded(by_shard(s, p).index_stats(), "shard", "node", "ns", "planSummary", "count", "p95Ms", "avgKeys"),
    "index_stats_summary": lambda s, p: rounded(a.index_summary(events(s, p).index_stats()), "totalOperations", "patterns", "collScanOperations", "collScanPct"),
    "ttl_operations": lambda s, p: logs(s, p, "ttl", "writes").ttl_operations(),
    "ttl_operations_by_shard": lambda s, p: by_shard(s, p, "ttl").ttl_operations(),
    "error_codes": lambda s, p: rounded(events(s, p).error_codes(), "codeName", "count", "errorCode", "message", "pct"),
    "error_codes_top5": lambda s, p: rounded(a.error_codes_top(events(s, p).error_codes()), "codeName", "count", "errorCode", "message", "pct"),
    "error_codes_by_shard": lambda s, p: rounded(by_shard(s, p).error_codes(), "shard", "node", "codeName", "count", "pct"),
    "transactions": lambda s, p: logs(s, p, "transactions").transactions(),
    "transactions_by_shard": lambda s, p: by_shard(s, p, "transactions").transactions().select("shard", "node", "txnRetryCounter", "terminationCause", "commitType", "count", "maxMs"),
    "termination_causes": lambda s, p: rounded(a.termination_causes(logs(s, p, "transactions").transactions()), "terminationCause", "count", "pct"),
    "slow_planning_top50": lambda s, p: events(s, p).slow_planning().drop("file", "line_no", "line"),
    "appname_connections": lambda s, p: events(s, p).appname_connections(),
    "appname_connections_compat": lambda s, p: logs(s, p, "writes").appname_connections("compat"),
    "op_type_stats": lambda s, p: rounded(logs(s, p, "events", "writes").op_type_stats(), "label", "count", "pct"),
    "ignored_categories": lambda s, p: rounded(logs(s, p, "noise").ignored_categories(), "category", "count", "pct"),
    "run_stats": lambda s, p: logs(s, p, "events", "noise", "ttl").run_stats(),
    "time_range": lambda s, p: events(s, p).time_range(),
    "driver_stats": _drivers,
    "connection_lifetimes": _lifetimes,
    "ranked_p95": lambda s, p: rounded(ranked_p95(events(s, p).operations, ["op"], "durationMillis", "p95Ms"), "op", "p95Ms"),
    "node_types": _node_types,
    "format_bytes_long": lambda s, p: _table(s, p, "events").select("event_id", text.format_bytes_long(F.col("event_id") * F.col("event_id") * 37).alias("shown")),
    "format_bytes_as": lambda s, p: _table(s, p, "events").select("event_id", text.format_bytes_as(F.col("event_id") * 997, text.byte_unit(F.col("event_id") * 50)).alias("shown")),
    "format_planning": lambda s, p: _table(s, p, "events").select("event_id", text.format_planning(F.col("event_id") * 131).alias("shown")),
    "format_lifetime": lambda s, p: _table(s, p, "events").select("event_id", text.format_lifetime(F.col("event_id") * 99_991).alias("shown")),
    "format_range": lambda s, p: _table(s, p, "events").select("event_id", text.format_range(F.lit("2024-01-01T00:00:00.000+00:00"), F.date_format(F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("event_id") * 6_997), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")).alias("shown")),
    "csv_cell": lambda s, p: _table(s, p, "documents").select("doc_id", text.csv_cell(F.col("text")).alias("shown")),
    "truncate_lines": lambda s, p: _table(s, p, "documents").select("doc_id", text.truncate_lines(F.replace("text", F.lit("\n"), F.lit("<br>")), 30).alias("shown")),
    "epoch_millis": lambda s, p: _table(s, p, "events").select("event_id", text.epoch_millis(F.when(F.col("event_id") % 5 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))).alias("ms")),
    "format_bytes": lambda s, p: _table(s, p, "events").select("event_id", text.format_bytes(F.col("event_id") * F.col("event_id") * 37).alias("shown")),
    "format_duration": lambda s, p: _table(s, p, "events").select("event_id", text.format_duration(F.col("event_id") * 997).alias("shown")),
    "truncate_text": lambda s, p: _table(s, p, "documents").select("doc_id", text.truncate(F.col("text"), 40).alias("shown")),
    "atlas_host_mask": _atlas,
    "host_of_remote": _hosts,
    "redact_lines": _redacted,
    "trim_lines": _trimmed,
}

__all__ = ["ORACLES", "QUERIES"]
