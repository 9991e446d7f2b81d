"""DuckDB SQL that says directly, on the tables, what the analyses find in the rendered lines."""

from __future__ import annotations

from ..functions.text import ATLAS

SLOW = """
ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
raw AS (
  SELECT event_id AS line_no, user_id, ts, k, CASE WHEN user_id % 4 = 0 THEN 'shop' ELSE 'app' END AS db, event_type AS coll, CASE WHEN user_id % 4 = 0 THEN 'shop' ELSE 'app' END || '.' || event_type AS ns,
    CASE event_id % 5 WHEN 0 THEN 'find' WHEN 1 THEN 'aggregate' WHEN 2 THEN 'update' WHEN 3 THEN 'insert' ELSE 'remove' END AS op,
    CASE event_id % 5 WHEN 4 THEN 'delete' WHEN 0 THEN 'find' WHEN 1 THEN 'aggregate' WHEN 2 THEN 'update' ELSE 'insert' END AS label,
    CASE WHEN event_id % 11 <> 0 THEN 'svc' || (user_id % 4) END AS "appName",
    CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value) AS BIGINT) END AS dur,
    CASE WHEN event_id % 6 <> 0 THEN k END AS keys, CASE WHEN event_id % 6 <> 0 THEN 2 * k END AS docs,
    coalesce(CASE WHEN event_id % 5 = 2 AND event_id % 4 = 0 THEN k % 3 END, CASE WHEN event_id % 6 <> 0 THEN event_id % 7 END) AS nret,
    CASE WHEN event_id % 7 <> 3 THEN 'H' || (user_id % 10) END AS "queryHash",
    CASE WHEN event_id % 3 <> 0 THEN 'P' || (user_id % 6) END AS plankey,
    CASE WHEN event_id % 17 <> 0 THEN CASE WHEN k < 20 THEN 'COLLSCAN' ELSE 'IXSCAN { k: 1 }' END END AS "planSummary",
    CASE WHEN event_id % 19 <> 0 THEN k * 100 + event_id % 97 END AS planning,
    event_id % 23 = 0 AS replanned, CASE WHEN event_id % 23 = 0 THEN 'reason' || (k % 3) END AS reason, event_id % 10 = 0 AS multi,
    event_id % 1000 AS reslen, CASE WHEN event_id % 2 = 0 THEN event_id % 3 END AS shards, CASE WHEN event_id % 5 = 2 THEN event_id % 4 END AS conflicts,
    CASE WHEN event_id % 2 = 0 THEN k * 1000 ELSE k * 10 END AS bread, CASE WHEN event_id % 2 = 0 AND event_id % 9 = 0 THEN k END AS bwritten,
    CASE event_id % 3 WHEN 0 THEN 'secondary' WHEN 1 THEN 'primary' END AS pref,
    CASE WHEN event_id % 3 = 0 THEN 'nodeType: ANALYTICS, region: r' || (user_id % 2) END AS tags,
    CASE WHEN event_id % 5 = 0 THEN '{"uid":' || (user_id % 3) || '}' END AS filter,
    event_type = 'error' AND event_id % 4 IN (0, 1) AS err,
    CASE WHEN user_id % 5 = 4 THEN 'plain.log' ELSE 'db-shard-0' || (user_id % 2) || '-0' || (user_id % 3) || '.log' END AS file,
    CASE WHEN user_id % 5 <> 4 THEN '0' || (user_id % 2) END AS shard, CASE WHEN user_id % 5 <> 4 THEN '0' || (user_id % 3) END AS node
  FROM ev WHERE user_id % 31 <> 7),
slow AS (SELECT *, keys AS fkeys, docs AS fdocs FROM raw)"""


def p95(x: str, p: float = 0.95) -> str:
    a = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"
    n = f"count({x})"
    at = f"({p}::DOUBLE * ({n} + 1))"
    k = f"CAST(floor({at}) AS BIGINT)"
    return f"CASE WHEN {n} = 0 THEN 0.0 WHEN {at} < 1 THEN ({a})[1]::DOUBLE WHEN {at} >= {n} THEN ({a})[{n}]::DOUBLE ELSE ({a})[{k}] + ({at} - {k}) * (({a})[{k} + 1] - ({a})[{k}]) END"


def total(x: str) -> str:
    return f"coalesce(sum({x}), 0)::BIGINT"


def quotient(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) // ({b}) ELSE 0 END::BIGINT"


N = "count(dur)"
KEYS, DOCS, RET = total("keys"), total("docs"), total("nret")
VOCABULARY = f"""{N} AS count, coalesce(min(dur), 0)::BIGINT AS "minMs", coalesce(max(dur), 0)::BIGINT AS "maxMs", {quotient(total("dur"), N)} AS "avgMs",
  round({p95("dur")}, 6) AS "p95Ms", ({total("dur")} // 1000)::BIGINT AS "totalSec", {quotient(KEYS, N)} AS "avgKeys", {quotient(DOCS, N)} AS "avgDocs",
  round({p95("keys")}, 6) AS "p95Keys", round({p95("docs")}, 6) AS "p95Docs", {KEYS} / 1000.0::DOUBLE AS "totalKeysK", {DOCS} / 1000.0::DOUBLE AS "totalDocsK",
  {quotient(RET, N)} AS "avgReturned", {quotient(DOCS, RET)} AS "exRetRatio\""""
EXTRA = f"""{quotient(total("shards"), N)} AS "avgShards", {quotient(total("reslen"), N)} AS "avgReslen", {quotient(total("bread"), N)} AS "avgBytesRead",
  coalesce(max(bread), 0)::BIGINT AS "maxBytesRead", {quotient(total("bwritten"), N)} AS "avgBytesWritten", coalesce(max(bwritten), 0)::BIGINT AS "maxBytesWritten",
  {quotient(total("conflicts"), N)} AS "avgWriteConflicts", count(*) FILTER (WHERE err) AS "errorCount\""""


def millis(x: str) -> str:
    return f"CAST(floor({x} / 1000.0::DOUBLE + 0.5) AS BIGINT)"


PLANNING = f"""coalesce({millis("min(planning)")}, 0)::BIGINT AS "minPlanMs", coalesce({millis("max(planning)")}, 0)::BIGINT AS "maxPlanMs",
  coalesce({millis("(sum(planning)::BIGINT // count(planning))")}, 0)::BIGINT AS "avgPlanMs", round(({p95("planning")}) / 1000.0::DOUBLE, 6) AS "p95PlanMs",
  count(*) FILTER (WHERE replanned) AS "replannedCount", count(*) FILTER (WHERE multi) AS "multiPlannerCount\""""


def percent(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN ({a}) * 100.0::DOUBLE / ({b}) ELSE 0.0 END, 6)"


def main_sql(where: str = "TRUE", extra: str = EXTRA) -> str:
    more = f", {extra}" if extra else ""
    return f'WITH {SLOW} SELECT db, coll, op, "appName", {VOCABULARY}{more} FROM slow WHERE {where} GROUP BY ALL'


SAMPLE = """, coalesce(arg_max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+00:00'), (dur, line_no)) FILTER (WHERE dur IS NOT NULL), arg_min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+00:00'), line_no)) AS "sampleTime",
  coalesce(arg_max(reslen, (dur, line_no)) FILTER (WHERE dur IS NOT NULL), arg_min(reslen, line_no)) AS "sampleReslen", FALSE AS "isMirrored",
  contains(coalesce(arg_max(coalesce("planSummary", ''), (dur, line_no)) FILTER (WHERE dur IS NOT NULL), arg_min(coalesce("planSummary", ''), line_no)), 'COLLSCAN') AS "hasCollScan\""""


def counts_sql(keys: str, value: str, name: str, default: str | None = None) -> str:
    v = f"coalesce({value}, '{default}')" if default else value
    return f"""SELECT {keys}, string_agg(v || ': ' || format('{{:,}}', c), '<br>' ORDER BY c DESC, v) AS "{name}", arg_min(v, (-c, v)) AS "top{name[0].upper()}{name[1:]}"
  FROM (SELECT {keys}, {v} AS v, count(*) AS c FROM chosen WHERE {v} IS NOT NULL GROUP BY ALL) GROUP BY ALL"""


HASHED = f"""WITH {SLOW}, chosen AS (SELECT * FROM slow WHERE "queryHash" IS NOT NULL)"""
PLANNED = f"""WITH {SLOW}, chosen AS (SELECT * FROM slow WHERE plankey IS NOT NULL AND "planSummary" IS NOT NULL)"""
HASH_ROWS = f"""{HASHED} SELECT "queryHash", ns, op, {VOCABULARY}, {PLANNING}, arg_max("planSummary", line_no) FILTER (WHERE "planSummary" IS NOT NULL) AS "planSummary",
  arg_min("appName", line_no) FILTER (WHERE "appName" IS NOT NULL) AS "appName", arg_min(filter, line_no) FILTER (WHERE filter IS NOT NULL) AS "sanitizedFilter",
  {percent("count(*) FILTER (WHERE replanned)", N)} AS "replannedPct", {percent("count(*) FILTER (WHERE multi)", N)} AS "multiPlannerPct" FROM chosen GROUP BY "queryHash", ns, op"""
SCANS = "count(*) FILTER (WHERE contains(\"planSummary\", 'COLLSCAN'))"
PLAN_ROWS = f"""{PLANNED} SELECT ns, op, "queryHash", "planSummary", {VOCABULARY}, {PLANNING}, {SCANS} AS "collScanCount", {percent(SCANS, N)} AS "collScanPct",
  {percent("count(*) FILTER (WHERE replanned)", N)} AS "replannedPct", {percent("count(*) FILTER (WHERE multi)", N)} AS "multiPlannerPct",
  arg_max(pref, line_no) FILTER (WHERE pref IS NOT NULL) AS "readPreference", round(CASE WHEN count(shards) > 0 THEN sum(shards) / count(shards)::DOUBLE ELSE 0.0 END, 6) AS "meanShards"
  FROM chosen GROUP BY ns, op, "queryHash", "planSummary\""""
INDEX_ROWS = f"""WITH {SLOW} SELECT ns, "planSummary", {N} AS count, coalesce(min(dur), 0)::BIGINT AS "minMs", coalesce(max(dur), 0)::BIGINT AS "maxMs", {quotient(total("dur"), N)} AS "avgMs",
  round({p95("dur")}, 6) AS "p95Ms", ({total("dur")} // 1000)::BIGINT AS "totalSec", {quotient(KEYS, N)} AS "avgKeys", {quotient(DOCS, N)} AS "avgDocs", {quotient(RET, N)} AS "avgReturned",
  {quotient(f"{KEYS} + {DOCS}", RET)} AS "examinedReturnedRatio", contains("planSummary", 'COLLSCAN') AS "isCollScan"
  FROM slow WHERE "planSummary" IS NOT NULL GROUP BY ns, "planSummary\""""
ERRORS = """
err AS (
  SELECT event_id AS line_no, coalesce(CASE WHEN event_id % 8 <> 0 THEN 'Err' || (event_id % 3) END, 'Error' || (event_id % 3 + 1)) AS "codeName", (event_id % 3 + 1)::INTEGER AS "errorCode", 'm' || event_id AS message, user_id
  FROM events WHERE event_type = 'error' AND event_id % 4 = 0
  UNION ALL SELECT event_id, 'Code' || (event_id % 5), (event_id % 5)::INTEGER, 'e' || event_id, user_id FROM events WHERE event_type = 'error' AND event_id % 4 = 1)"""
ERROR_ROWS = f'WITH {ERRORS} SELECT "codeName", count(*) AS count, arg_min("errorCode", line_no) AS "errorCode", arg_min(message, line_no) AS message, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM err GROUP BY "codeName"'
TXN = """
txn AS (
  SELECT '0' || (o_orderkey % 2) AS shard, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 3)::INTEGER END AS "txnRetryCounter", CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS "terminationCause", o_orderpriority AS "commitType",
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 1000 END AS dur,
    CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor((CAST(floor(o_totalprice) AS BIGINT) % 7919) / 1000.0::DOUBLE + 0.5) AS BIGINT) END AS a,
    CAST(floor((CAST(floor(o_totalprice) AS BIGINT) % 100003) / 1000.0::DOUBLE + 0.5) AS BIGINT) AS b,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor((CAST(floor(o_totalprice) AS BIGINT) % 50021) / 1000.0::DOUBLE + 0.5) AS BIGINT) END AS c
  FROM orders)"""
_times = lambda x, n: f'coalesce(max({x}), 0)::BIGINT AS "max{n}Ms", {quotient(total(x), f"count({x})")} AS "avg{n}Ms"'
TXN_ROWS = f"""WITH {TXN} SELECT "txnRetryCounter", "terminationCause", "commitType", count(*) AS count, coalesce(min(dur), 0)::BIGINT AS "minMs", coalesce(max(dur), 0)::BIGINT AS "maxMs",
  {quotient(total("dur"), "count(dur)")} AS "avgMs", {_times("a", "Commit")}, {_times("b", "Active")}, {_times("c", "Inactive")} FROM txn GROUP BY ALL"""
CONNECTIONS = """
conns AS (
  SELECT c_custkey AS c, 'node' || (c_custkey % 2) AS file, CASE WHEN c_custkey % 10 = 9 THEN 'NetworkInterfaceTL' ELSE c_mktsegment END AS "driverName", '4.' || (c_custkey % 3) AS "driverVersion",
    CASE WHEN c_custkey % 2 = 0 OR c_custkey % 4 = 1 THEN 'snappy,zstd' ELSE '' END AS compressors, CASE WHEN c_custkey % 3 <> 0 THEN 'user' || (c_custkey % 4) END AS username,
    '10.1.0.' || (c_custkey % 100) AS host, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 977 > 0 THEN c_custkey % 977 END AS life,
    CASE WHEN c_custkey % 7 = 0 THEN '8.0.' || (c_custkey % 2) END AS version, c_custkey % 100 || ':' || (c_custkey % 5000 + 1024) AS remote
  FROM customer),
outside AS (SELECT * FROM conns WHERE NOT starts_with("driverName", 'NetworkInterface'))"""


def duration(m: str = "m") -> str:
    return f"""CASE WHEN {m} < 1000 THEN {m} || 'ms' WHEN {m} < 60000 THEN printf('%.1fs', floor({m} / 100.0::DOUBLE + 0.5) / 10) WHEN {m} < 3600000 THEN ({m} // 60000) || 'm ' || ({m} // 1000 % 60) || 's'
  WHEN {m} < 86400000 THEN ({m} // 3600000) || 'h ' || ({m} // 60000 % 60) || 'm ' || ({m} // 1000 % 60) || 's' ELSE ({m} // 86400000) || 'd ' || ({m} // 3600000 % 24) || 'h ' || ({m} // 60000 % 60) || 'm' END"""


BRAND = "replace(p_brand, '#', '')"

COMMANDS = """WITH cmd AS (
  SELECT c_custkey % 11 AS k, (c_custkey % 100)::BIGINT AS ms, ['findAndModify', 'getMore', 'getMore', 'count', 'distinct', 'aggregate', 'command', 'command', 'command', NULL, 'aggregate'][c_custkey % 11 + 1] AS op,
    ['orders', 'carts', 'carts', 'orders', 'orders', 'base', 'base', 'base', 'base', NULL, 'orders'][c_custkey % 11 + 1] AS coll,
    ['findAndModify', 'getMore', 'getMore', 'count', 'distinct', 'aggregate', 'drop', 'createIndexes', 'shard__shardsvrMovePrimary', NULL, 'aggregate'][c_custkey % 11 + 1] AS label FROM customer)"""

ORACLES: dict[str, str] = {
    "scan_files": """WITH f(name, shard, node) AS (VALUES ('a/db-shard-07-01.log', '07', '01'), ('b/db-shard-07-01.log', '07', '01'), ('mongod.log.gz', NULL, NULL), ('logs.zip!in/mongod.log', NULL, NULL), ('logs.zip!mongod.log.gz', NULL, NULL)),
  n AS (SELECT n_nationkey::BIGINT AS d FROM nation ORDER BY n_nationkey LIMIT 20)
SELECT name, shard, node, count(*) AS lines, sum(d)::BIGINT AS durations, 1::BIGINT AS skipped FROM f, n GROUP BY ALL""",
    "scan_connections": """SELECT 'svc' || (n_nationkey % 2) AS "appName", 5 * count(DISTINCT n_nationkey % 5) AS count FROM nation GROUP BY 1""",
    "main_operations": main_sql(extra=EXTRA + SAMPLE),
    "main_operations_search": main_sql("contains(coll, 'lic')", ""),
    "read_ops": main_sql("NOT (ends_with(op, '_w') OR op IN ('insert', 'remove'))", ""),
    "write_ops": main_sql("ends_with(op, '_w') OR op IN ('insert', 'remove')", ""),
    "ops_by_operation": main_sql("op = 'find'", ""),
    "ops_by_namespace": main_sql("db = 'app' AND coll = 'click'", ""),
    "ns_filter_exact": main_sql("db = 'app'", ""),
    "ns_filter_db": main_sql("db = 'shop'", ""),
    "ns_filter_glob": main_sql("db = 'shop'", ""),
    "main_operations_by_shard": f'WITH {SLOW} SELECT shard, node, db, coll, op, "appName", {VOCABULARY} FROM slow GROUP BY ALL',
    "main_operations_summary": f"""WITH {SLOW}, g AS (SELECT db, coll, op, "appName", {N} AS n, {total("dur")} AS ms, {DOCS} AS docs, {RET} AS ret,
  contains(coalesce(arg_max(coalesce("planSummary", ''), (dur, line_no)) FILTER (WHERE dur IS NOT NULL), arg_min(coalesce("planSummary", ''), line_no)), 'COLLSCAN') AS scan FROM slow GROUP BY ALL)
SELECT coalesce(sum(n) FILTER (WHERE scan), 0)::BIGINT AS "collScanCount", sum(n)::BIGINT AS "totalOperations", sum(ms)::BIGINT AS "totalMs", count(*) AS patterns, count(*) FILTER (WHERE op IN ('insert', 'remove')) AS "writePatterns",
  coalesce(sum(n) FILTER (WHERE op NOT IN ('insert', 'remove')), 0)::BIGINT AS "readCount", coalesce(sum(n) FILTER (WHERE op IN ('insert', 'remove')), 0)::BIGINT AS "writeCount",
  sum(docs)::BIGINT AS "docsExamined", sum(ret)::BIGINT AS "docsReturned" FROM g""",
    "collscan_ops": f"""WITH {SLOW}, g AS (SELECT db, coll, op, "appName", {N} AS count, 1 AS one,
  arg_max(coalesce("planSummary", ''), (dur, line_no)) FILTER (WHERE dur IS NOT NULL) AS slowest, arg_min(coalesce("planSummary", ''), line_no) AS first FROM slow GROUP BY ALL)
SELECT db, coll, op, "appName", count FROM g WHERE contains(coalesce(slowest, first), 'COLLSCAN')""",
    "query_hash": HASH_ROWS,
    "query_hash_summary": f'{HASHED} SELECT sum(n)::BIGINT AS "totalCount", count(*) AS entries, count(DISTINCT ns) AS namespaces FROM (SELECT "queryHash", ns, op, {N} AS n FROM chosen GROUP BY ALL)',
    "query_hash_read_prefs": f'{HASHED} {counts_sql(chr(34) + "queryHash" + chr(34) + ", ns, op", "pref", "readPreferences", "default")}',
    "query_hash_tags": f'{HASHED} {counts_sql(chr(34) + "queryHash" + chr(34) + ", ns, op", "tags", "readPreferenceTags")}',
    "query_hash_replan_reasons": f'{HASHED} {counts_sql(chr(34) + "queryHash" + chr(34) + ", ns, op", "reason", "replanReasons")}',
    "query_hash_by_shard": f'{HASHED} SELECT shard, node, "queryHash", ns, op, {VOCABULARY} FROM chosen GROUP BY shard, node, "queryHash", ns, op',
    "plan_cache_by_shard": f'{PLANNED} SELECT shard, node, ns, op, "queryHash", "planSummary", {VOCABULARY} FROM chosen GROUP BY shard, node, ns, op, "queryHash", "planSummary"',
    "index_stats_by_shard": f'WITH {SLOW} SELECT shard, node, ns, "planSummary", {N} AS count, round({p95("dur")}, 6) AS "p95Ms", {quotient(KEYS, N)} AS "avgKeys" FROM slow WHERE "planSummary" IS NOT NULL GROUP BY shard, node, ns, "planSummary"',
    "query_hash_top100": f'{HASHED} SELECT "queryHash", ns, op, {N} AS count FROM chosen GROUP BY ALL ORDER BY count DESC, "queryHash", ns, op LIMIT 100',
    "plan_cache": PLAN_ROWS,
    "plan_cache_multi_plan": f"""{PLANNED}, g AS (SELECT ns, op, "queryHash", "planSummary", {N} AS count FROM chosen GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY "queryHash") AS plans, (sum(count) OVER (PARTITION BY "queryHash"))::BIGINT AS "hashCount" FROM g WHERE "queryHash" IS NOT NULL QUALIFY plans > 1""",
    "plan_cache_summary": f"""{PLANNED}, g AS (SELECT ns, op, "queryHash", "planSummary", {N} AS n, {SCANS} AS s, count(*) FILTER (WHERE replanned) AS r, count(*) FILTER (WHERE multi) AS m FROM chosen GROUP BY ALL)
SELECT sum(n)::BIGINT AS "totalCount", count(*) AS entries, count(DISTINCT "queryHash") AS "queryHashes", {percent("sum(s)", "sum(n)")} AS "collScanPct", {percent("sum(r)", "sum(n)")} AS "replannedPct", {percent("sum(m)", "sum(n)")} AS "multiPlannerPct" FROM g""",
    "replan_reasons_top5": f'{PLANNED} SELECT reason AS "replanReason", count(*) AS count FROM chosen WHERE reason IS NOT NULL GROUP BY ALL ORDER BY count DESC, reason LIMIT 5',
    "index_stats": INDEX_ROWS,
    "index_stats_summary": f"""WITH g AS ({INDEX_ROWS}) SELECT sum(count)::BIGINT AS "totalOperations", count(*) AS patterns, coalesce(sum(count) FILTER (WHERE "isCollScan"), 0)::BIGINT AS "collScanOperations",
  {percent('coalesce(sum(count) FILTER (WHERE "isCollScan"), 0)', "sum(count)")} AS "collScanPct" FROM g""",
    "ttl_operations": f"""WITH t AS (SELECT 'ttl.' || {BRAND} AS ns, CASE WHEN p_partkey % 13 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS ms, p_size::BIGINT AS d FROM part
  UNION ALL SELECT 'shop.' || {BRAND}, p_size::BIGINT, p_partkey % 100 FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 4 = 1)
SELECT ns, count(ms) AS count, {quotient(total("ms"), "count(ms)")} AS "avgMs", coalesce(min(ms), 0)::BIGINT AS "minMs", coalesce(max(ms), 0)::BIGINT AS "maxMs", {quotient(total("d"), "count(ms)")} AS "avgDeleted", {total("d")} AS "totalDeleted" FROM t GROUP BY ns""",
    "ttl_operations_by_shard": f"""WITH t AS (SELECT '0' || (p_partkey % 2) AS shard, 'ttl.' || {BRAND} AS ns, CASE WHEN p_partkey % 13 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS ms, p_size::BIGINT AS d FROM part)
SELECT shard, '01' AS node, ns, count(ms) AS count, {quotient(total("ms"), "count(ms)")} AS "avgMs", coalesce(min(ms), 0)::BIGINT AS "minMs", coalesce(max(ms), 0)::BIGINT AS "maxMs", {quotient(total("d"), "count(ms)")} AS "avgDeleted", {total("d")} AS "totalDeleted" FROM t GROUP BY shard, ns""",
    "error_codes": ERROR_ROWS,
    "error_codes_top5": f'SELECT * FROM ({ERROR_ROWS}) ORDER BY count DESC, "codeName" LIMIT 5',
    "error_codes_by_shard": f"""WITH {ERRORS}, s AS (SELECT *, CASE WHEN user_id % 5 <> 4 THEN '0' || (user_id % 2) END AS shard, CASE WHEN user_id % 5 <> 4 THEN '0' || (user_id % 3) END AS node FROM err)
SELECT shard, node, "codeName", count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY shard, node), 6) AS pct FROM s GROUP BY shard, node, "codeName\"""",
    "transactions": TXN_ROWS,
    "transactions_by_shard": f"""WITH {TXN} SELECT shard, '00' AS node, "txnRetryCounter", "terminationCause", "commitType", count(*) AS count, coalesce(max(dur), 0)::BIGINT AS "maxMs" FROM txn GROUP BY ALL""",
    "termination_causes": f"""WITH {TXN} SELECT coalesce("terminationCause", 'unknown') AS "terminationCause", count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM txn GROUP BY 1""",
    "slow_planning_top50": f'WITH {SLOW} SELECT planning AS "planningTimeMicros", {millis("planning")} AS "planningTimeMs", ns, op, "appName", "queryHash", "planSummary", filter AS "sanitizedFilter" FROM slow WHERE planning IS NOT NULL ORDER BY planning DESC, line_no LIMIT 50',
    "appname_connections": f"""WITH {SLOW} SELECT coalesce("appName", 'unknown') AS "appName", count(DISTINCT user_id) AS count FROM slow GROUP BY 1""",
    "appname_connections_compat": """SELECT CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN 'app' || (p_partkey % 3) ELSE 'unknown' END AS "appName", count(DISTINCT p_partkey % 50) AS count FROM part GROUP BY 1""",
    "op_type_stats": f"""WITH {SLOW}, labels AS (
  SELECT label FROM slow UNION ALL SELECT CASE p_partkey % 4 WHEN 0 THEN 'update_w' WHEN 1 THEN 'delete_w' WHEN 2 THEN 'insert_w' ELSE 'write_other' END FROM part WHERE p_partkey % 7 <> 0
  UNION ALL SELECT CASE WHEN p_partkey % 4 = 1 THEN 'ttl_delete' ELSE CASE p_partkey % 3 WHEN 0 THEN 'index_build' WHEN 1 THEN 'index_drop' ELSE 'index_other' END END FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT 'index_operation' FROM part WHERE p_partkey % 7 = 0)
SELECT label, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM labels GROUP BY label""",
    "write_operations": f"""WITH w AS (SELECT 'shop' AS db, CASE WHEN p_partkey % 9 = 0 AND p_partkey % 7 <> 0 THEN 'deletedTTL' ELSE {BRAND} END AS coll, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 4 = 1 THEN p_partkey % 100 END AS nret,
  CASE WHEN p_partkey % 7 = 0 AND p_partkey % 4 = 1 THEN 'remove' WHEN p_partkey % 7 = 0 THEN 'command' ELSE CASE p_partkey % 4 WHEN 0 THEN 'update_w' WHEN 1 THEN 'remove' WHEN 2 THEN 'insert' ELSE 'command' END END AS op,
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN 'app' || (p_partkey % 3) END AS "appName", p_size::BIGINT AS dur FROM part)
SELECT db, coll, op, "appName", count(dur) AS count, min(dur) AS "minMs", max(dur) AS "maxMs", round({p95("dur")}, 6) AS "p95Ms", {quotient(RET, "count(dur)")} AS "avgReturned" FROM w GROUP BY ALL""",
    "ignored_categories": """WITH k AS (SELECT ['NETWORK', 'STORAGE', 'HEALTH_CHECK', 'REPLICATION', 'ADMIN_DB', 'NON_JSON', NULL, NULL, 'ACCESS', 'CONTROL', 'HEALTH_CHECK', 'LOCAL_DB', 'CONFIG_DB', 'PROFILING', 'TTL_MONITOR', 'OTHER'][c_custkey % 16 + 1] AS category FROM customer)
SELECT category, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM k WHERE category IS NOT NULL GROUP BY category""",
    "command_operations": f"""{COMMANDS} SELECT 'shop' AS db, coll, CASE WHEN k = 1 THEN 'getMore (change stream)' ELSE op END AS op, count(*) AS count, min(ms) AS "minMs", max(ms) AS "maxMs" FROM cmd WHERE op IS NOT NULL GROUP BY ALL""",
    "command_labels": f"""{COMMANDS} SELECT label, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM cmd WHERE label IS NOT NULL GROUP BY label""",
    "command_filters": f"""{COMMANDS} SELECT op, CASE k WHEN 2 THEN '{{"a":1}}' WHEN 3 THEN '{{"c":1}}' WHEN 10 THEN '{{"b":1}}' END AS "sanitizedFilter", count(*) AS count FROM cmd WHERE op IS NOT NULL GROUP BY ALL""",
    "run_stats": """WITH n AS (SELECT count(*) AS c, count(*) FILTER (WHERE c_custkey % 16 NOT IN (6, 7)) AS i, count(*) FILTER (WHERE c_custkey % 16 = 6) AS p, count(*) FILTER (WHERE c_custkey % 16 = 7) AS a FROM customer), e AS (SELECT count(*) AS c, count(*) FILTER (WHERE user_id % 31 = 7) AS f FROM events), t AS (SELECT count(*) AS c FROM part)
SELECT n.c + e.c + t.c AS "linesRead", n.i + t.c AS ignored, 0::BIGINT AS "oversizeLines", t.c AS "ttlLines", n.p + n.a + e.c AS processed, n.p AS "parseErrors", n.a AS "noAttr", 0::BIGINT AS "noNs", e.f AS "namespaceFiltered", e.c - e.f AS "foundOps" FROM n, e, t""",
    "time_range": "SELECT min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+00:00')) AS earliest, max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+00:00')) AS latest FROM events",
    "driver_stats": f"""WITH {CONNECTIONS} SELECT "driverName", "driverVersion", 'Linux' AS "osType", 'x86_64' AS platform, compressors, username, count(*) AS "connectionCount", count(DISTINCT host) AS "uniqueHosts",
  coalesce(sum(life)::BIGINT // count(life), 0)::BIGINT AS "avgLifetimeMs", coalesce(max(life), 0)::BIGINT AS "maxLifetimeMs", 'Ubuntu' AS "osName",
  arg_min_null(version, (file, c)) AS "serverVersion", '10.1.0.' || arg_min(remote, (file, c)) AS "sampleMetadata", CASE WHEN username IS NOT NULL THEN 'conn' || arg_min(c, (file, c)) END AS "sampleAuth" FROM outside GROUP BY "driverName", "driverVersion", compressors, username""",
    "connection_lifetimes": f'WITH {CONNECTIONS} SELECT file || \'.log\' AS file, c AS conn_id, life AS "lifetimeMs" FROM outside WHERE life IS NOT NULL',
    "ranked_p95": f'WITH {SLOW} SELECT op, round({p95("dur")}, 6) AS "p95Ms" FROM slow WHERE dur IS NOT NULL GROUP BY op',
    "format_bytes": "SELECT event_id, CASE WHEN b = 0 THEN '0' WHEN b < 1024 THEN b || 'B' WHEN b < 1048576 THEN printf('%.1fKB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10) WHEN b < 1073741824 THEN printf('%.1fMB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1fGB', floor(b / 1073741824.0::DOUBLE * 10 + 0.5) / 10) END AS shown FROM (SELECT event_id, event_id * event_id * 37 AS b FROM events)",
    "format_duration": """SELECT event_id, CASE WHEN m < 1000 THEN m || 'ms' WHEN m < 60000 THEN printf('%.1fs', m / 1000.0::DOUBLE) WHEN m < 3600000 THEN (m // 60000) || 'm ' || (m // 1000 % 60) || 's'
  ELSE (m // 3600000) || 'h ' || (m // 60000 % 60) || 'm ' || (m // 1000 % 60) || 's' END AS shown FROM (SELECT event_id, event_id * 997 AS m FROM events)""",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS shown FROM documents",
    "atlas_host_mask": rf"SELECT user_id, event_id, regexp_replace('atlas-ab' || user_id || '-shard-00-0' || (event_id % 3) || '.x1y2z.mongodb.net:27017', '{ATLAS}', 'atlas-xxx\2xxx\4\5') AS masked FROM events",
    "node_types": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'analytics' WHEN 1 THEN 'voting' WHEN 2 THEN 'voting' WHEN 3 THEN 'analytics' WHEN 5 THEN 'voting' END AS node FROM events",
    "format_bytes_long": "SELECT event_id, CASE WHEN b < 1024 THEN b || ' bytes' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10) WHEN b < 1073741824 THEN printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(b / 1073741824.0::DOUBLE * 10 + 0.5) / 10) END AS shown FROM (SELECT event_id, event_id * event_id * 37 AS b FROM events)",
    "format_bytes_as": "SELECT event_id, CASE WHEN m >= 1073741824 THEN printf('%.1f', floor(b / 1073741824.0::DOUBLE * 10 + 0.5) / 10) WHEN m >= 1048576 THEN printf('%.1f', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) WHEN m >= 1024 THEN printf('%.1f', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE b::VARCHAR END AS shown FROM (SELECT event_id, event_id * 997 AS b, event_id * 50 AS m FROM events)",
    "format_planning": "SELECT event_id, CASE WHEN m < 1000 THEN m || 'µs' WHEN m < 10000 THEN printf('%.2fms', floor(m / 10.0::DOUBLE + 0.5) / 100) WHEN m < 100000 THEN printf('%.1fms', floor(m / 100.0::DOUBLE + 0.5) / 10) WHEN m < 1000000 THEN printf('%.0fms', floor(m / 1000.0::DOUBLE + 0.5)) ELSE printf('%.2fs', floor(m / 10000.0::DOUBLE + 0.5) / 100) END AS shown FROM (SELECT event_id, event_id * 131 AS m FROM events)",
    "format_lifetime": f"SELECT event_id, CASE WHEN m = 0 THEN 'N/A' ELSE {duration()} END AS shown FROM (SELECT event_id, event_id * 99991 AS m FROM events)",
    "format_range": f"""SELECT event_id, '2024-01-01 00:00:00 - ' || CASE WHEN m < 86400000 THEN strftime(t, '%H:%M:%S') ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END || ' (' || ({duration()}) || ')' AS shown FROM (SELECT event_id, event_id * 6997 AS m, TIMESTAMP '2024-01-01' + to_milliseconds(event_id * 6997) AS t FROM events)""",
    "csv_cell": """SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS shown FROM documents""",
    "truncate_lines": "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) <= 30 THEN x ELSE substr(x, 1, 27) || '...' END), '<br>') AS shown FROM documents",
    "epoch_millis": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE epoch_us(ts) // 1000 END::BIGINT AS ms FROM events",
    "host_of_remote": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (user_id % 250) ELSE '[fe80::' || (user_id % 250) || ']' END AS host FROM events",
}
