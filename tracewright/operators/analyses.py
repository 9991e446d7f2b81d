"""The analyses: each takes a table of operations (or staged lines) and returns a lazy DataFrame.

``by_shard`` adds shard and node to the key.  Order is falling by count and then by key, so that ties have one
order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import get, has, is_object
from .metrics import derived, grouped, micros_to_millis, null_safe_join, percent, planning, quotient, ranked_values, sample_line, total, value_counts, vocabulary

D = "doc"
SHARD = ["shard", "node"]


def _keys(keys: list[str], by_shard: bool) -> list[str]:
    return SHARD + keys if by_shard else keys


def _ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*(F.asc_nulls_first(k) for k in keys if k in SHARD), F.desc("count"), *(F.asc_nulls_first(k) for k in keys if k not in SHARD))


def main_operations(ops: DataFrame, by_shard: bool = False, change_stream_label: bool = False) -> DataFrame:
    """A1: by database, collection, operation and application."""
    keys = _keys(["db", "coll", "op", "appName"], by_shard)
    if change_stream_label:
        ops = ops.withColumn("op", F.when(F.col("isChangeStream"), "getMore (change stream)").otherwise(F.col("op")))
    out = derived(grouped(ops, keys, [*vocabulary(docs_need_keys=True), F.bool_or("isChangeStream").alias("isChangeStream"), sample_line()], ranked_values(docs_need_keys=True)))
    mirrored = F.coalesce(F.col("sample").contains('"mirrored":true'), F.lit(False))
    scan = F.coalesce(F.col("sample").contains("COLLSCAN"), F.lit(False)) & ~F.col("isChangeStream") & ~mirrored
    return _ordered(out.withColumn("isMirrored", mirrored).withColumn("hasCollScan", scan), keys)


def is_write(op: Column) -> Column:
    return op.endswith("_w") | op.isin("insert", "remove")


def by_operation(main: DataFrame, op: str) -> DataFrame:
    return main.filter(F.col("op") == op)


def by_namespace(main: DataFrame, db: str, coll: str | None = None) -> DataFrame:
    return main.filter((F.col("db") == db) & (F.col("coll") == coll if coll is not None else F.lit(True)))


def collscans(main: DataFrame) -> DataFrame:
    return main.filter("hasCollScan")


def writes(main: DataFrame) -> DataFrame:
    return main.filter(is_write(F.col("op")))


def reads(main: DataFrame) -> DataFrame:
    return main.filter(~is_write(F.col("op")))


def text_search(rows: DataFrame, needle: str, column: str | None = None) -> DataFrame:
    """rows of which any cell, or one, holds the needle whatever the case."""
    cells = [column] if column else rows.columns
    return rows.filter(F.lower(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in cells if not rows.schema[c].dataType.typeName() in ("map", "array", "struct")))).contains(needle.lower()))


def main_summary(main: DataFrame) -> DataFrame:
    """A16."""
    writes_, count = is_write(F.col("op")), F.col("count")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return main.agg(
        zero(F.sum("count")).alias("totalOperations"),
        zero(F.sum("totalMs")).alias("totalMs"),
        F.count("*").alias("patterns"),
        F.count_if(writes_).alias("writePatterns"),
        zero(F.sum(F.when(~writes_, count))).alias("readCount"),
        zero(F.sum(F.when(writes_, count))).alias("writeCount"),
        zero(F.sum(F.when(F.col("hasCollScan"), count))).alias("collScanCount"),
        zero(F.sum("totalDocs")).alias("docsExamined"),
        zero(F.sum("totalReturned")).alias("docsReturned"),
    )


def ttl_operations(staged: DataFrame, namespaces: Column | None = None, by_shard: bool = False) -> DataFrame:
    """A2: expiry lines by namespace, whatever else becomes of them; ``staged`` lines must be parsed."""
    keys = _keys(["ns"], by_shard)
    rows = staged.filter("ttl").withColumn("ns", get(D, "string", "attr", "namespace")).filter("ns IS NOT NULL AND substring_index(ns, '.', 1) <> 'config'")
    if namespaces is not None:
        rows = rows.filter(namespaces)
    rows = rows.withColumn("ms", get(D, "bigint", "attr", "durationMillis")).withColumn("deleted", get(D, "bigint", "attr", "numDeleted"))
    n = F.count("ms")
    out = rows.groupBy(*keys).agg(n.alias("count"), quotient(total("ms"), n).alias("avgMs"), F.coalesce(F.min("ms"), F.lit(0).cast("long")).alias("minMs"), F.coalesce(F.max("ms"), F.lit(0).cast("long")).alias("maxMs"), quotient(total("deleted"), n).alias("avgDeleted"), total("deleted").alias("totalDeleted"))
    return _ordered(out, keys)


def query_hash(ops: DataFrame, by_shard: bool = False) -> DataFrame:
    """A3: by query hash, namespace and operation."""
    keys = _keys(["queryHash", "ns", "op"], by_shard)
    rows = ops.filter("queryHash IS NOT NULL")
    at = F.struct("file", "line_no")
    when = lambda c: F.when(F.col(c).isNotNull(), at)
    firsts = [F.max_by("planSummary", when("planSummary")).alias("planSummary"), F.min_by("appName", when("appName")).alias("appName"), F.min_by("sanitizedFilter", when("sanitizedFilter")).alias("sanitizedFilter")]
    out = derived(grouped(rows, keys, [*vocabulary(), *planning(), *firsts, sample_line()], ranked_values(planning=True)))
    out = out.withColumn("replannedPct", percent(F.col("replannedCount"), F.col("count"))).withColumn("multiPlannerPct", percent(F.col("multiPlannerCount"), F.col("count")))
    values = {"readPreferences": F.coalesce("readPreference", F.lit("default")), "readPreferenceTags": F.col("readPreferenceTags"), "replanReasons": F.col("replanReason")}
    return _ordered(null_safe_join(out, value_counts(rows, keys, values), keys), keys)


def query_hash_top(hashes: DataFrame, n: int = 100) -> DataFrame:
    """O3: the commonest patterns."""
    return hashes.orderBy(F.desc("count"), "queryHash", "ns", "op").limit(n)


def query_hash_summary(hashes: DataFrame) -> DataFrame:
    """A17."""
    return hashes.agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("totalCount"), F.count("*").alias("entries"), F.countDistinct("ns").alias("namespaces"))


def plan_cache(ops: DataFrame, by_shard: bool = False) -> DataFrame:
    """A4: operations with a plan cache key, by namespace, operation, query hash and plan."""
    keys = _keys(["ns", "op", "queryHash", "planSummary"], by_shard)
    rows = ops.filter("planCacheKey IS NOT NULL AND planSummary IS NOT NULL")
    shards = F.count("nShards")
    out = derived(grouped(rows, keys, [*vocabulary(), *planning(), F.count_if(F.col("planSummary").contains("COLLSCAN")).alias("collScanCount"), F.max_by("readPreference", F.when(F.col("readPreference").isNotNull(), F.struct("file", "line_no"))).alias("readPreference"), F.when(shards > 0, total("nShards") / shards).otherwise(0.0).alias("meanShards"), sample_line()], ranked_values(planning=True)))
    for part, name in (("collScanCount", "collScanPct"), ("replannedCount", "replannedPct"), ("multiPlannerCount", "multiPlannerPct")):
        out = out.withColumn(name, percent(F.col(part), F.col("count")))
    out = null_safe_join(out, value_counts(rows, keys, {"replanReasons": F.col("replanReason")}), keys)
    return _ordered(out, keys)


def multi_plan(plans: DataFrame) -> DataFrame:
    """Hashes with several plans, the commonest first, and their plans by count."""
    w = Window.partitionBy("queryHash")
    out = plans.filter("queryHash IS NOT NULL").withColumn("plans", F.count("*").over(w)).withColumn("hashCount", F.sum("count").over(w)).filter("plans > 1")
    return out.orderBy(F.desc("hashCount"), "queryHash", F.desc("count"), "ns", "op", "planSummary")


def plan_cache_summary(plans: DataFrame) -> DataFrame:
    """A4c."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return plans.agg(s("count").alias("totalCount"), F.count("*").alias("entries"), F.countDistinct("queryHash").alias("queryHashes"), percent(s("collScanCount"), s("count")).alias("collScanPct"), percent(s("replannedCount"), s("count")).alias("replannedPct"), percent(s("multiPlannerCount"), s("count")).alias("multiPlannerPct"))


def replan_reasons_top(plans: DataFrame, n: int = 5) -> DataFrame:
    reasons = plans.select(F.explode("replanReasonsCounts").alias("replanReason", "c"))
    return reasons.groupBy("replanReason").agg(F.sum("c").alias("count")).orderBy(F.desc("count"), "replanReason").limit(n)


def error_events(docs: DataFrame) -> DataFrame:
    """The errors that parsed lines report: up to three a line."""
    attr = lambda kind, *keys: get(D, kind, "attr", *keys)
    event = lambda name, code, message: F.struct(name.alias("codeName"), code.alias("errorCode"), message.alias("message"))
    explicit = F.when(is_object(D, "attr", "error"), attr("string", "error", "codeName"))
    failed = F.when(attr("int", "ok") == 0, F.coalesce(attr("string", "errName"), F.concat(F.lit("Error"), attr("int", "errCode").cast("string"))))
    gone = "Interrupted operation as its client disconnected"
    cut = F.when((F.col("msg") == gone) & has(D, "attr"), F.lit("InterruptedByClientDisconnect"))
    about = F.concat(F.lit(gone), F.coalesce(F.concat(F.lit(" (opId: "), attr("string", "opId"), F.lit(")")), F.lit("")))
    events = F.array(event(explicit, attr("int", "error", "code"), attr("string", "error", "errmsg")), event(failed, attr("int", "errCode"), attr("string", "errMsg")), event(cut, F.lit(None).cast("int"), about))
    return docs.withColumn("e", F.explode(F.filter(events, lambda e: e["codeName"].isNotNull()))).select("file", "line_no", "shard", "node", "e.*")


def error_codes(events: DataFrame, by_shard: bool = False) -> DataFrame:
    """A5, with percentages of the total (of the shard's with ``by_shard``)."""
    keys = _keys(["codeName"], by_shard)
    at = F.struct("file", "line_no")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    out = events.groupBy(*keys).agg(F.count("*").alias("count"), first("errorCode"), first("message"))
    whole = Window.partitionBy(*(SHARD if by_shard else []))
    return _ordered(out.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(whole)), keys)


def error_codes_top(codes: DataFrame, n: int = 5) -> DataFrame:
    return codes.orderBy(F.desc("count"), "codeName").limit(n)


def transaction_rows(docs: DataFrame) -> DataFrame:
    attr = lambda kind, *keys: get(D, kind, "attr", *keys)
    rows = docs.filter("component = 'TXN' AND msg = 'transaction'").select(
        "shard", "node", attr("int", "parameters", "txnRetryCounter").alias("txnRetryCounter"), attr("string", "terminationCause").alias("terminationCause"), attr("string", "commitType").alias("commitType"), attr("bigint", "durationMillis").alias("durationMillis"),
        *(micros_to_millis(attr("bigint", k)).alias(n) for k, n in (("commitDurationMicros", "commit"), ("timeActiveMicros", "active"), ("timeInactiveMicros", "inactive"))),
    )
    return rows.filter("coalesce(CAST(txnRetryCounter AS STRING), terminationCause, commitType, CAST(durationMillis AS STRING)) IS NOT NULL")


def transactions(rows: DataFrame, by_shard: bool = False) -> DataFrame:
    """A6; of commit, active and inactive times the microseconds of a row are rounded before they are added."""
    keys = _keys(["txnRetryCounter", "terminationCause", "commitType"], by_shard)
    most = lambda c: F.coalesce(F.max(c), F.lit(0).cast("long"))
    mean = lambda c: quotient(total(c), F.count(c))
    made = [F.count("*").alias("count"), F.coalesce(F.min("durationMillis"), F.lit(0).cast("long")).alias("minMs"), most("durationMillis").alias("maxMs"), mean("durationMillis").alias("avgMs")]
    for name in ("commit", "active", "inactive"):
        made += [most(name).alias(f"max{name.title()}Ms"), mean(name).alias(f"avg{name.title()}Ms")]
    return _ordered(rows.groupBy(*keys).agg(*made), keys)


def termination_causes(found: DataFrame) -> DataFrame:
    """A6b."""
    out = found.groupBy(F.coalesce("terminationCause", F.lit("unknown")).alias("terminationCause")).agg(F.sum("count").alias("count"))
    return out.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy())).orderBy(F.desc("count"), "terminationCause")


def index_stats(ops: DataFrame, by_shard: bool = False) -> DataFrame:
    """A7."""
    keys = _keys(["ns", "planSummary"], by_shard)
    out = derived(grouped(ops.filter("ns IS NOT NULL AND planSummary IS NOT NULL"), keys, vocabulary(), {"p95Ms": F.col("durationMillis")}))
    out = out.withColumn("examinedReturnedRatio", quotient(F.col("totalKeys") + F.col("totalDocs"), F.col("totalReturned"))).withColumn("isCollScan", F.col("planSummary").contains("COLLSCAN"))
    return _ordered(out.select(*keys, "count", "minMs", "maxMs", "avgMs", "p95Ms", "totalSec", "avgKeys", "avgDocs", "avgReturned", "examinedReturnedRatio", "isCollScan"), keys)


def index_summary(stats: DataFrame) -> DataFrame:
    """A7b."""
    n = F.coalesce(F.sum("count"), F.lit(0).cast("long"))
    scans = F.coalesce(F.sum(F.when(F.col("isCollScan"), F.col("count"))), F.lit(0).cast("long"))
    return stats.agg(n.alias("totalOperations"), F.count("*").alias("patterns"), scans.alias("collScanOperations"), percent(scans, n).alias("collScanPct"))


def slow_planning(ops: DataFrame, n: int = 50) -> DataFrame:
    """The operations that took longest to plan, the earliest of equals."""
    rows = ops.filter("planningTimeMicros IS NOT NULL").orderBy(F.desc("planningTimeMicros"), "file", "line_no").limit(n)
    return rows.select("file", "line_no", "planningTimeMicros", micros_to_millis(F.col("planningTimeMicros")).alias("planningTimeMs"), "ns", "op", "appName", "queryHash", "planSummary", "sanitizedFilter", "line")


def appname_connections(ops: DataFrame, scope: str = "all") -> DataFrame:
    """A10: distinct connections by application.

    ``all`` counts connections of every file apart and all operations; ``compat`` counts connection numbers
    over all files together, of index and write lines alone.
    """
    rows = ops.filter("conn_id IS NOT NULL")
    conn = F.struct("file", "conn_id")
    if scope == "compat":
        rows, conn = rows.filter(F.col("branch").isin("index", "write")), F.col("conn_id")
    return rows.groupBy(F.coalesce("appName", F.lit("unknown")).alias("appName")).agg(F.countDistinct(conn).alias("count")).orderBy(F.desc("count"), "appName")


def op_type_stats(classed: DataFrame) -> DataFrame:
    """Labels of all classified lines; index and write lines count before the namespace filter."""
    out = classed.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("count"))
    return out.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy())).orderBy(F.desc("count"), "label")


def ignored_categories(staged: DataFrame) -> DataFrame:
    """A12."""
    from .prefilter import category

    out = staged.filter("stage = 'ignored'").groupBy(category(F.col("value")).alias("category")).agg(F.count("*").alias("count"))
    return out.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy())).orderBy(F.desc("count"), "category")


def run_stats(classed: DataFrame) -> DataFrame:
    """One row; ``classed`` holds the lines of every stage, status null where a line wasn't parsed."""
    status, stage = F.col("status"), F.col("stage")
    counts = {"parseErrors": status == "parse_error", "noAttr": status == "no_attr", "noNs": status == "no_ns", "namespaceFiltered": status == "filtered", "foundOps": status == "op"}
    return classed.agg(F.count("*").alias("linesRead"), F.count_if(stage == "ignored").alias("ignored"), F.count_if(stage == "oversize").alias("oversizeLines"), F.count_if("ttl").alias("ttlLines"), F.count_if(stage == "kept").alias("processed"), *(F.count_if(F.coalesce((stage == "kept") & c, F.lit(False))).alias(n) for n, c in counts.items()))


def time_range(docs: DataFrame) -> DataFrame:
    """The first and last time as text."""
    return docs.agg(F.min("t_raw").alias("earliest"), F.max("t_raw").alias("latest"))
