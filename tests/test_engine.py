import gzip
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright import LogAnalysis
from tracewright.api import trim_logs
from tracewright.operators.metrics import grouped, p95, ranked, ranked_p95
from tracewright.sources.lines import read_lines

SF = "/root/testdata/sf0.001"


def command(verb="find", coll="c", **attr):
    return {"t": {"$date": "2024-01-01T00:00:00.000+00:00"}, "c": "COMMAND", "ctx": "conn7", "msg": "Slow query", "attr": {"ns": "db.c", "command": {verb: coll}} | attr}


def analysis(spark, *docs, **options):
    rows = [("f.log", i, d if isinstance(d, str) else json.dumps(d, separators=(",", ":")), None, None) for i, d in enumerate(docs)]
    return LogAnalysis(spark, lines=spark.createDataFrame(rows, "file string, line_no long, value string, shard string, node string"), **options)


@pytest.mark.parametrize("n", [1, 2, 18, 19, 20, 21, 100])
def test_p95_is_type_six(spark, n):
    values = sorted((i * 37) % 101 for i in range(n))
    at = 0.95 * (n + 1)
    k = int(at)
    want = values[0] if at < 1 else values[-1] if at >= n else values[k - 1] + (at - k) * (values[k] - values[k - 1])
    df = spark.createDataFrame([(v, "g") for v in values], "v long, g string")
    assert df.agg(p95("v")).first()[0] == pytest.approx(want)
    assert ranked_p95(df, ["g"], "v", "p").first().p == pytest.approx(want)


def test_p95_of_nothing(spark):
    assert spark.createDataFrame([(None,)], "v long").agg(p95("v")).first()[0] == 0.0


def test_counts_need_a_duration_and_keys_need_nreturned(spark):
    rows = analysis(spark, command(durationMillis=10, keysExamined=5, docsExamined=6, nreturned=2), command(keysExamined=100, docsExamined=100)).main_operations().collect()
    assert len(rows) == 1 and rows[0]["count"] == 1 and rows[0].totalKeys == 5 and rows[0].totalDocs == 6 and rows[0].exRetRatio == 3


def test_wrong_types_and_bad_lines_lose_one_row_only(spark):
    a = analysis(spark, command(durationMillis="x"), '{"find": broken "find":', command(durationMillis="12"), command(durationMillis=1.9), {"c": "X", "find": 1, "msg": "no attr"}, "noise")
    stats = a.run_stats().first()
    assert (stats.linesRead, stats.ignored, stats.parseErrors, stats.foundOps) == (6, 1, 1, 3)
    assert a.main_operations().first().totalMs == 13


def test_classification(spark):
    docs = [command(v, durationMillis=1) for v in ("find", "aggregate", "findAndModify", "update", "insert", "delete", "count", "distinct")]
    docs += [command("getMore", 5, durationMillis=1, originatingCommand={"pipeline": [{"$changeStream": {}}]}), command("drop", durationMillis=1), command("unknown", durationMillis=1), command("_shardsvrMove", 1, durationMillis=1)]
    a = analysis(spark, *docs)
    assert {r.op: r["count"] for r in a.operations.groupBy("op").count().collect()} == {"find": 1, "aggregate": 1, "findAndModify": 1, "update": 1, "insert": 1, "remove": 1, "count": 1, "distinct": 1, "getMore": 1, "command": 2}
    assert a.operations.filter("isChangeStream").count() == 1
    assert {r.label for r in a.op_type_stats().collect()} >= {"delete", "drop", "shard__shardsvrMove"}


def test_write_index_and_returned_precedence(spark):
    write = {"c": "WRITE", "ctx": "conn1", "msg": "Slow query", "attr": {"type": "update", "ns": "a.b", "nreturned": 1, "nModified": 3, "ninserted": 4, "durationMillis": 2, "find": 1}}
    index = {"c": "INDEX", "ctx": "x", "msg": "Index build: done", "attr": {"namespace": "a.i", "durationMillis": 5, "find": 1}}
    rows = {r.op: r for r in analysis(spark, write, index).operations.collect()}
    assert rows["update_w"].nreturned == 4 and rows["command"].ns == "a.i" and rows["command"].durationMillis == 5


def test_filters_preferences_and_tags(spark):
    doc = command("aggregate", durationMillis=1)
    doc["attr"]["command"] |= {"pipeline": [{"$limit": 1}, {"$match": {"b": 1, "a": 2}}], "$readPreference": {"mode": "nearest", "tags": [{"k": "v"}, {"x": "y", "z": "w"}]}}
    row = analysis(spark, doc).operations.first()
    assert json.loads(row.sanitizedFilter) == {"a": 2, "b": 1} and row.readPreference == "nearest" and row.readPreferenceTags == "k: v<br>x: y, z: w"
    text = command("find", durationMillis=1)
    text["attr"]["command"]["$readPreference"] = "primary"
    assert analysis(spark, text).operations.first().readPreference == "primary"


@pytest.mark.parametrize(("filters", "found"), [(["db.c"], 1), (["db"], 1), (["db.*"], 1), (["d*.c"], 1), (["d.c"], 0), (["dbx.*"], 0)])
def test_namespace_filters(spark, filters, found):
    assert analysis(spark, command(durationMillis=1), namespaces=filters).operations.count() == found


def test_errors(spark):
    both = command(ok=0, errName="Late", errCode=50, errMsg="late", error={"codeName": "Early", "code": 1, "errmsg": "e"})
    cut = {"c": "X", "msg": "Interrupted operation as its client disconnected", "attr": {"opId": 5, "find": 1}}
    found = {r.codeName: (r["count"], r.errorCode, r.message) for r in analysis(spark, both, cut, command(ok=0, errCode=7), command(error="text")).error_codes().collect()}
    assert found == {"Early": (1, 1, "e"), "Late": (1, 50, "late"), "Error7": (1, 7, None), "InterruptedByClientDisconnect": (1, None, "Interrupted operation as its client disconnected (opId: 5)")}


def test_drivers_join_in_any_order_and_per_file(spark):
    meta = {"t": {"$date": "2024-01-01T00:00:01.000Z"}, "c": "NETWORK", "ctx": "conn1", "msg": "client metadata", "attr": {"remote": "[::1]:5", "negotiatedCompressors": ["z", "a"], "doc": {"driver": {"name": "d", "version": "1"}, "os": {"type": "L"}}}}
    auth = {"c": "ACCESS", "ctx": "conn1", "msg": "Successfully authenticated", "attr": {"user": "ann"}}
    end = {"t": {"$date": "2024-01-01T00:00:03.500Z"}, "c": "NETWORK", "ctx": "conn1", "msg": "Connection ended", "attr": {}}
    row = analysis(spark, meta, auth, end, end, redact=True).drivers().first()
    assert (row.username, row.compressors, row.connectionCount, row.uniqueHosts, row.avgLifetimeMs) == ("xxx", "a,z", 1, 1, 2500)


def test_files_gzip_zip_and_missing(spark, tmp_path):
    line = json.dumps(command(durationMillis=4), separators=(",", ":"))
    (tmp_path / "x-shard-01-02.log").write_text(line + "\n" + line + "\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as file:
        file.write(line + "\n")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as archive:
        archive.writestr("m1.log", line + "\n")
        archive.writestr("m2.log", line + "\r\n" + line)
    paths = [str(tmp_path / n) for n in ("x-shard-01-02.log", "b.log.gz", "c.zip", "none.log")]
    a = LogAnalysis(spark, paths, by_shard=True)
    assert a.skipped == [paths[3]]
    assert {(r.shard, r.node): r["count"] for r in a.main_operations().collect()} == {("01", "02"): 2, (None, None): 4}
    limited, _ = read_lines(spark, paths[:3], line_limit=1)
    assert limited.count() == 4
    a.write_csv("main_operations", str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns[:3] == ["Namespace", "Operation", "Count"]
    a.write_json(str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["main_operations"][0]["coll"] == "c"
    a.write_html(str(tmp_path / "r.html"))
    assert "<table" in (tmp_path / "r.html").read_text()


def test_files_of_one_name_stay_apart(spark, tmp_path):
    line = json.dumps(command(durationMillis=4, appName="app"), separators=(",", ":"))
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "mongod.log").write_text(f"{line}\n{line}\n")
    paths = [str(tmp_path / folder / "mongod.log") for folder in ("a", "b")]
    limited, _ = read_lines(spark, paths, line_limit=1)
    assert limited.count() == 2
    logs = LogAnalysis(spark, paths)
    assert logs.appname_connections().first()["count"] == 2 and logs.appname_connections("compat").collect() == []
    folder = logs.folder
    logs.close()
    assert not (tmp_path / folder).exists() and logs.folder is None


def test_expiry_lines_are_counted_and_classified(spark):
    named = command("find", "deletedTTL", durationMillis=1)
    expired = {"c": "INDEX", "ctx": "x", "msg": "Deleted expired documents", "attr": {"namespace": "a.TTL", "numDeleted": 5, "durationMillis": 2}}
    monitor = expired | {"ctx": "TTLMonitor"}
    logs = analysis(spark, named, expired, monitor)
    assert {(r.op, r.coll, r.nreturned) for r in logs.operations.collect()} == {("find", "deletedTTL", None), ("remove", "TTL", 5)}
    assert {r.label for r in logs.op_type_stats().collect()} == {"find", "ttl_delete", "index_operation"}
    assert logs.ttl_operations().first().totalDeleted == 10
    stats = logs.run_stats().first()
    assert (stats.ttlLines, stats.ignored, stats.foundOps) == (3, 1, 2)


def test_percentiles_of_a_hot_group_need_no_list(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), (F.col("id") % 977).alias("v"), F.lit(None).cast("long").alias("none"))
    found = ranked(rows, ["g"], {"p": F.col("v"), "q": F.col("none")})
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.g: (r.p, r.q) for r in found.collect()} == {r.g: (r.p, 0.0) for r in rows.groupBy("g").agg(p95("v").alias("p")).collect()}
    both = grouped(rows, ["g"], [F.count("*").alias("n")], {"q": F.col("none")})
    assert {(r.g, r.n, r.q) for r in both.collect()} == {("cold", 20_000, 0.0), ("hot", 40_000, 0.0)}


def test_node_types(spark):
    from tracewright.operators.classify import node_type

    cases = {"nodeType: analytics": "analytics", "a: b<br>role: analytics": "analytics", "nodeType: voting": "voting", "workloadType: operational": "voting", "provider: p, region: r": "voting", "region: r": None, None: None, "": None}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "tags string, want string").withColumn("got", node_type(F.col("tags"))).collect()
    assert all(r.want == r.got for r in rows)


def test_classification_reads_a_line_once(spark):
    plan = analysis(spark, command(durationMillis=1), store=False).operations._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("try_variant_get") < 60


def test_redaction_reaches_views_and_ignored_lines(spark, tmp_path):
    doc = command("find", durationMillis=1, queryHash="H")
    doc["attr"]["command"] |= {"filter": {"name": "zoe"}, "$readPreference": {"mode": "nearest", "tags": [{"who": "zoe"}]}}
    logs = analysis(spark, doc, '{"c":"NETWORK","user":"zoe"}', redact=True)
    logs.create_views()
    for view in ("log_lines", "log_docs", "slow_op", "query_hash"):
        assert "zoe" not in json.dumps([r.asDict(recursive=True) for r in spark.table(view).collect()], default=str), view


def test_oversize_line_is_skipped_alone(spark):
    stats = analysis(spark, command(durationMillis=1), '{"find":"' + "x" * (1 << 20) + '"}', command(durationMillis=1)).run_stats().first()
    assert (stats.oversizeLines, stats.foundOps) == (1, 2)


def test_rewriter_accepts_plain_and_grepped_lines(spark):
    line = '{"t":{"$date":"2024"},"c":"COMMAND","attr":{"lsid":{"id":1},"a":1}}'
    a = analysis(spark, line, "host.log:" + line, '{"c":"STORAGE"}')
    assert [r.value for r in trim_logs(a.lines).collect()] == ['{"t":{"$date":"2024"},"c":"COMMAND","attr":{"a":1}}'] * 2


def test_ties_and_order_do_not_change_results(spark):
    docs = [command(durationMillis=d, queryHash="H", planSummary=p) for d, p in ((5, "A"), (5, "B"), (1, "C"))]
    rows = analysis(spark, *docs)
    shuffled = LogAnalysis(spark, lines=rows.lines.orderBy(F.desc("line_no")).repartition(3))
    assert rows.query_hash().first().planSummary == "C" == shuffled.query_hash().first().planSummary
    assert rows.main_operations().first().sample == shuffled.main_operations().first().sample
    assert '"B"' in rows.main_operations().first().sample


def test_streaming_windows(spark, tmp_path):
    from tracewright.streaming.live import live_documents, live_operations, read_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(json.dumps(command(durationMillis=d), separators=(",", ":")) for d in (1, 2)))
    query = live_operations(live_documents(read_stream(spark, str(tmp_path / "in")))).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert spark.table("live").first()["count"] == 2
    finally:
        query.stop()


def test_streamed_hashes_and_indexes(spark, tmp_path):
    from tracewright.streaming.live import live_documents, live_index_stats, live_query_hash, read_stream

    (tmp_path / "a.log").write_text("\n".join(json.dumps(command(durationMillis=d, queryHash="H", planSummary="COLLSCAN", planningTimeMicros=2000), separators=(",", ":")) for d in (1, 2, 9)))
    for name, function in (("hashes", live_query_hash), ("indexes", live_index_stats)):
        query = function(live_documents(read_stream(spark, str(tmp_path)))).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp{name}")).start()
        try:
            query.processAllAvailable()
            row = spark.table(name).first()
            assert (row["count"], row.p95Ms) == (3, 9.0)
        finally:
            query.stop()
    assert spark.table("hashes").first().p95PlanMs == 2.0 and spark.table("indexes").first().isCollScan


@pytest.mark.parametrize("name", ["scan_files", "main_operations", "write_operations", "query_hash_read_prefs", "error_codes", "run_stats", "driver_stats"])
def test_against_duckdb(spark, name):
    from tracewright.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for table in ("events", "customer", "part", "orders", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted((tuple(r) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == want
