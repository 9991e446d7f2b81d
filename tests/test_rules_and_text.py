import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import redact, text
from tracewright.sources.rules import DEFAULT_IGNORED, FilterRules, parse_properties


def test_properties():
    found = parse_properties("# note\nfilter.ignore.add = a, b\nfilter.ignore.remove: b\\\n,c\n")
    assert found == {"filter.ignore.add": "a, b", "filter.ignore.remove": "b,c"}
    rules = FilterRules.from_mapping(found)
    assert rules.ignored == (*DEFAULT_IGNORED, "a")
    assert FilterRules.from_mapping({"filter.ignore.patterns": "x,y"}).ignored == ("x", "y")


def red(obj):
    return json.loads(redact.redact_line(json.dumps(obj)))


def test_redaction_keeps_system_fields_and_masks_values():
    line = {"t": {"$date": "2024"}, "msg": "Slow query", "attr": {"ns": "a.b", "durationMillis": 12, "command": {"find": "b", "filter": {"name": "Ann", "age": 42, "sort": -1, "ok": True, "none": None}}}}
    out = red(line)
    assert out["attr"]["ns"] == "a.b" and out["attr"]["durationMillis"] == 12 and out["t"] == {"$date": "2024"}
    assert out["attr"]["command"]["filter"] == {"name": "xxx", "age": 99, "sort": -1, "ok": True, "none": None}


def test_redaction_of_arrays_patterns_and_hosts():
    out = red({"attr": {"command": {"filter": {"a": ["x", 17], "r": {"$regularExpression": {"pattern": "^abc.*", "options": "i"}}, "h": "atlas-ab1-shard-00-01.zz9.mongodb.net:27017", "id": "secret", "leak": "see atlas-x and .mongodb.net"}}}})["attr"]["command"]["filter"]
    assert out["a"] == ["xxx", 99] and out["r"]["$regularExpression"] == {"pattern": "^xxx.*", "options": "i"}
    assert out["h"] == "atlas-xxx-shard-00-01.xxx.mongodb.net:27017" and out["leak"] == "xxx" and out["id"] == "xxx"
    assert redact.redact_line("not json") == "xxx" and redact.redact_line(None) is None and redact.redact_line("x", False) == "x"
    assert json.loads(redact.sanitize_filter('{"id": "a", "t": "b"}', True)) == {"id": "xxx", "t": "xxx"}


KEPT_LINES = {
    "top level and performance": {"t": {"$date": "2025-01-02T03:04:05.006Z"}, "s": "W", "c": "WRITE", "id": 7, "ctx": "conn9", "msg": "Slow query", "attr": {"type": "update", "cpuNanos": 123456, "keysExamined": 3, "docsExamined": 4, "nreturned": 5, "reslen": 600, "queryHash": "AB12", "planCacheKey": "CD34", "planSummary": "COLLSCAN", "ok": 0, "errName": "Late", "errCode": 50, "protocol": "op_msg"}},
    "replanning": {"attr": {"replanReason": "plan was pinned", "replanned": True, "durationMillis": 12}},
    "limits": {"attr": {"command": {"find": "c", "limit": 17, "skip": 23, "maxTimeMS": 1234}}},
    "client": {"attr": {"command": {"$client": {"mongos": {"client": "10.1.2.3:99", "version": "8.0.1"}, "driver": {"name": "d", "version": "1"}, "os": {"name": "L", "type": "L", "version": "9", "architecture": "arm"}, "platform": "p", "application": {"name": "shell 1"}}}}},
    "read concerns": {"attr": {"readConcern": {"level": "local", "provenance": "x"}, "command": {"getMore": 99, "cursorid": 12345678901234567, "cursorExhausted": True, "queryFramework": "sbe", "readConcern": {"level": "majority", "provenance": "y"}}, "originatingCommand": {"readConcern": {"level": "linearizable", "provenance": "z"}, "collation": {"locale": "de"}, "$db": "d", "mayBypassWriteBlocking": False}}},
    "audit": {"attr": {"command": {"$audit": {"$impersonatedUser": {"user": "u", "db": "admin"}}}, "originatingCommand": {"$audit": {"$impersonatedUser": {"user": "v", "db": "admin"}}}}},
    "locks and storage of the list": {"attr": {"locks": {"Global": {"acquireCount": {"r": 4, "w": 5}}}, "storage": {"data": {"timeReadingMicros": 4321, "bytesRead": 8765}}}},
    "dates": {"attr": {"command": {"filter": {"at": {"$date": "2025-06-07T08:09:10Z"}, "n": {"$oid": "65"}, "u": {"$uuid": "a-b"}}}}},
}


@pytest.mark.parametrize("name", KEPT_LINES)
def test_redaction_keeps(name):
    assert red(KEPT_LINES[name]) == KEPT_LINES[name]


def test_redaction_masks_what_users_wrote():
    out = red({"attr": {"errMsg": "no such customer Ann", "command": {"find": "c", "comment": "for Ann", "filter": {"city": "Bonn", "name": "Ann"}}, "application": "a", "locks": {"Mutex": {"acquireCount": {"r": 7}}, "Other": {"acquireCount": {"r": 12}}}}})["attr"]
    assert out["errMsg"] == "xxx" and out["command"] == {"find": "c", "comment": "xxx", "filter": {"city": "xxx", "name": "xxx"}}
    assert out["locks"]["Other"]["acquireCount"]["r"] == 99
    assert red({"name": "Ann", "attr": {"command": {"$client": {"application": {"name": "Ann"}}, "filter": {"application": {"name": "Ann"}}}}})["attr"]["command"] == {"$client": {"application": {"name": "Ann"}}, "filter": {"application": {"name": "xxx"}}}


def test_redaction_of_pipelines():
    near = {"$geoNear": {"near": {"x": "home"}, "distanceField": "far", "maxDistance": 250, "spherical": True, "distanceMultiplier": 3, "query": {"kind": "shop"}}}
    out = red({"attr": {"ns": "g.l", "command": {"aggregate": "l", "pipeline": [near, {"$match": {"who": "Ann", "when": {"$date": "2025"}}}, {"$skip": 30}, {"$limit": 40}]}}})["attr"]
    stages = out["command"]["pipeline"]
    assert out["ns"] == "g.l" and out["command"]["aggregate"] == "l" and stages[2:] == [{"$skip": 30}, {"$limit": 40}]
    assert {k: stages[0]["$geoNear"][k] for k in ("distanceField", "maxDistance", "spherical", "distanceMultiplier")} == {"distanceField": "far", "maxDistance": 250, "spherical": True, "distanceMultiplier": 3}
    assert stages[0]["$geoNear"]["query"] == {"kind": "xxx"} and stages[1]["$match"] == {"who": "xxx", "when": {"$date": "2025"}}


def test_redaction_of_patterns_keeps_operators():
    out = red({"attr": {"command": {"filter": {"p": {"$regularExpression": {"pattern": "^Ann\\.B", "options": ""}}}}}})["attr"]["command"]["filter"]["p"]["$regularExpression"]
    assert out["pattern"].startswith("^xxx") and "\\" in out["pattern"] and out["options"] == ""


def test_trimming_of_routed_commands():
    drop = dict.fromkeys(("shardVersion", "clientOperationKey", "lsid", "$clusterTime", "$configTime", "$topologyTime", "runtimeConstants"), {"a": 1})
    keep = {"find": "c", "filter": {"a": 1}, "limit": 5, "$db": "d", "plain": "stays"}
    out = json.loads(redact.trim_line(json.dumps({"attr": {"durationMillis": 1234, "command": drop | keep}})))
    assert out == {"attr": {"durationMillis": 1234, "command": keep}}
    assert redact.process_line("not json") == "xxx" and redact.trim_line("not json") == "not json"


def test_bold_fields_and_values():
    line = '{"nModified": 4,"usedDisk":true,"planSummary":"IXSCAN { a: 1 }","other":5,"$audit":{"$impersonatedUser":{"user":"u","db":"a"}}}'
    assert redact.bold_fields(line) == '{<strong>"nModified":</strong> <strong>4</strong>,<strong>"usedDisk":</strong><strong>true</strong>,<strong>"planSummary":</strong><strong>"IXSCAN { a: 1 }"</strong>,"other":5,<strong>"$audit":{"$impersonatedUser":{"user":"u","db":"a"}</strong>}}'


def test_preserved_host_keeps_other_names():
    client = {"mongos": {"host": "db1:27017"}}
    out = red({"attr": {"command": {"$client": client}, "originatingCommand": {"$client": {"mongos": {"host": "atlas-q-shard-00-00.r.mongodb.net"}}}}})
    assert out["attr"]["command"]["$client"] == client
    assert out["attr"]["originatingCommand"]["$client"]["mongos"]["host"] == "atlas-xxx-shard-00-00.xxx.mongodb.net"


def test_trim():
    line = {"attr": {"lsid": {"id": 1}, "ns": "a" * 50, "text": "b" * 40, "list": [1, 2, 3, 4], "pipeline": [1, 2, 3, 4], "empty": {}, "writeConcern": {"w": 1}}}
    out = json.loads(redact.trim_line(json.dumps(line)))["attr"]
    assert out == {"ns": "a" * 50, "text": "b" * 35 + "...", "list": [1, "<truncated 3 elements>"], "pipeline": [1, 2, 3, 4], "writeConcern": {"w": 1}}
    assert "writeConcern" not in json.loads(redact.trim_line(json.dumps(line), True))["attr"]


@pytest.mark.parametrize(("n", "shown"), [(0, "0"), (12, "12B"), (1536, "1.5KB"), (3 << 20, "3.0MB"), (5 << 30, "5.0GB")])
def test_format_bytes(spark, n, shown):
    assert spark.range(1).select(text.format_bytes(F.lit(n))).first()[0] == shown


def test_text_functions(spark):
    row = spark.range(1).select(
        text.format_duration(F.lit(125_000)).alias("a"), text.format_duration(F.lit(90_061_000), days=True).alias("b"), text.truncate(F.lit("abcdefgh"), 6).alias("c"), text.truncate(F.lit("abcdefgh"), 2).alias("d"),
        text.host_of(F.lit("[fe80::1]:27017")).alias("e"), text.host_of(F.lit("h:1")).alias("f"), text.epoch_millis(F.lit("bad")).alias("g"), text.format_planning(F.lit(1500)).alias("h"), text.csv_cell(F.lit('a"b,c')).alias("i"),
        text.is_truncated(F.lit('{"truncated":{"a":1,"errMsg":"x"}}')).alias("j"), text.query_source(F.lit('{"mongos":1}')).alias("k"), text.truncate_lines(F.lit("abcdef<br>ab"), 5).alias("l"),
    ).first()
    assert list(row) == ["2m 5s", "1d 1h 1m", "abc...", "ab", "[fe80::1]", "h", -1, "1.50ms", '"a""b,c"', True, " (from mongos)", "ab...<br>ab"]


@pytest.mark.parametrize(("line", "cut"), [('{"a":[{"b":{"truncated":{"x":{"y":1},"errMsg":"e"}}}]}', True), ('{"truncated":{"x":1},"errMsg":"e"}', False), ('{"truncated": cut "errMsg"', True), ('{"errMsg":1}', False), (None, None)])
def test_truncated_at_any_depth(spark, line, cut):
    assert spark.createDataFrame([(line,)], "l string").select(text.is_truncated(F.col("l"))).first()[0] is cut


@pytest.mark.parametrize(("ms", "shown"), [(0, "N/A"), (999, "999ms"), (1500, "1.5s"), (3000, "3s"), (12_400, "12s"), (60_000, "1m"), (61_000, "1m 1s"), (3_600_000, "1h"), (7_260_000, "2h 1m"), (90_000_000, "25h")])
def test_short_lifetimes(spark, ms, shown):
    assert spark.range(1).select(text.format_lifetime_short(F.lit(ms))).first()[0] == shown


def test_compress_plan(spark):
    plan = ", ".join(["IXSCAN { a: 1, b: { c: 1, d: 1 } }"] * 3)
    df = spark.createDataFrame([(plan,), ("COLLSCAN",), (None,)], "p string").select(text.compress_plan(F.col("p")).alias("p"))
    assert [r.p for r in df.collect()] == ["IXSCAN { a: 1, b: { c: 1, d: 1 } } (x3)", "COLLSCAN", None]


def test_command_line(spark, tmp_path, capsys):
    from tracewright.__main__ import main

    (tmp_path / "a.log").write_text('{"t":{"$date":"2024"},"c":"COMMAND","attr":{"lsid":{"id":1},"a":1}}\n{"c":"STORAGE"}\n')
    main(["trim", "-f", str(tmp_path / "a.log"), str(tmp_path / "none.log"), "--stdout"])
    assert capsys.readouterr().out.splitlines() == ['{"t":{"$date":"2024"},"c":"COMMAND","attr":{"a":1}}', f"skipped: {tmp_path / 'none.log'}"]


def test_report_command(spark, tmp_path, capsys):
    from tracewright.__main__ import main

    line = '{"t":{"$date":"2024-01-01T00:00:00.000Z"},"c":"COMMAND","ctx":"conn1","msg":"Slow query","attr":{"ns":"d.c","command":{"find":"c"},"durationMillis":7}}'
    (tmp_path / "a.log").write_text(f'{line}\n{{"find": broken "find":\n')
    main(["report", "-f", str(tmp_path / "a.log"), "--json", str(tmp_path / "r.json"), "--json-only", "--text", "--verbose", "-c", str(tmp_path / "csv"), "--appNameStats"])
    spark.sparkContext.setLogLevel("ERROR")
    out = capsys.readouterr()
    assert "main_operations: 1 groups, 1 in all" in out.out and "appname_connections: 1 groups, 1 in all" in out.out and "json:" in out.err
    assert json.loads((tmp_path / "r.json").read_text())["run_stats"][0]["parseErrors"] == 1 and (tmp_path / "csv").is_dir() and not (tmp_path / "report.html").exists()
