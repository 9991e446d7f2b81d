"""Command lines: ``python -m tracewright report -f LOG...`` and ``python -m tracewright trim [-f LOG...]``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .api import LogAnalysis, trim_logs
from .sources import sinks
from .sources.lines import read_lines, read_stdin
from .sources.rules import FilterRules

CSV_OPTIONS = {"csv": "main_operations", "planCacheCsv": "plan_cache", "queryHashCsv": "query_hash", "errorCodesCsv": "error_codes", "transactionCsv": "transactions", "slowPlanningCsv": "slow_planning"}

CONSOLE = ("main_operations", "query_hash", "plan_cache", "error_codes", "transactions", "ttl_operations")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    report = commands.add_parser("report", help="analyse log files")
    report.add_argument("-f", "--files", nargs="+", required=True)
    report.add_argument("-c", "--csv")
    for option in CSV_OPTIONS:
        if option != "csv":
            report.add_argument(f"--{option}")
    for option in ("config", "json", "ignoredAnalysis"):
        report.add_argument(f"--{option}")
    report.add_argument("--html", default="report.html")
    report.add_argument("--json-only", action="store_true", help="no HTML report")
    report.add_argument("--debug", action="store_true", help="Spark's log, and the first lines that can't be parsed")
    report.add_argument("--verbose", action="store_true", help="seconds of each output")
    report.add_argument("--ns", "--namespace", nargs="+", dest="namespaces")
    report.add_argument("--limit", type=int)
    for option in ("redact", "shards", "drivers", "appNameStats", "text"):
        report.add_argument(f"--{option}", action="store_true")
    trim = commands.add_parser("trim", help="rewrite logs without noise")
    trim.add_argument("-f", "--files", nargs="+")
    trim.add_argument("--config")
    trim.add_argument("--output")
    for option in ("stdout", "aggressive", "redact"):
        trim.add_argument(f"--{option}", action="store_true")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    options = arguments(argv)
    spark = SparkSession.builder.appName("tracewright").getOrCreate()
    spark.sparkContext.setLogLevel("DEBUG" if getattr(options, "debug", False) else "WARN")
    if options.command == "trim":
        lines, missing = read_lines(spark, options.files) if options.files else read_stdin(spark)
        rules = FilterRules.from_properties(options.config) if options.config else None
        found = trim_logs(lines, options.aggressive, options.redact, rules)
        if options.output and not options.stdout:
            sinks.write_lines(found, options.output)
        else:
            for row in found.orderBy("file", "line_no").toLocalIterator():
                print(row.value)
    else:
        logs = LogAnalysis(spark, options.files, config=options.config, namespaces=options.namespaces, redact=options.redact, by_shard=options.shards, line_limit=options.limit)
        missing = logs.skipped
        outputs = [(f"{name}.csv", lambda name=name, path=getattr(options, option): logs.write_csv(name, path)) for option, name in CSV_OPTIONS.items() if getattr(options, option)]
        if options.json:
            outputs.append(("json", lambda: logs.write_json(options.json)))
        if not options.json_only:
            outputs.append(("html", lambda: logs.write_html(options.html)))
        if options.ignoredAnalysis:
            outputs.append(("ignored lines", lambda: logs.write_ignored_sample(options.ignoredAnalysis)))
        if options.text:
            outputs += [(name, lambda name=name: sinks.console(name, getattr(logs, name)())) for name in CONSOLE]
        if options.drivers:
            outputs.append(("drivers", lambda: sinks.console("drivers", logs.drivers(), "connectionCount")))
        if options.appNameStats:
            outputs.append(("appname_connections", lambda: sinks.console("appname_connections", logs.appname_connections())))
        if options.debug:
            outputs.append(("unparsed", lambda: sinks.show(logs.documents.filter("doc IS NULL").select("file", "line_no", "value"), 3, 300)))
        for name, write in outputs:
            began = time.monotonic()
            write()
            if options.verbose:
                print(f"{name}: {time.monotonic() - began:.1f} s", file=sys.stderr)
        logs.close()
    for path in missing:
        print(f"skipped: {path}")


if __name__ == "__main__":
    main()
