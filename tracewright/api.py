"""The front door: one object for a set of log files."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import redact as red
from .operators import analyses as a
from .operators import drivers as d
from .operators import prefilter
from .operators.classify import classified, slow_op
from .operators.documents import get, parsed, staged
from .scratch import new_folder, removed, stored
from .sources import sinks
from .sources.lines import read_lines, strip_prefix
from .sources.rules import FilterRules


class LogAnalysis:
    """Analyses of log files.

    The first analysis of operations classifies the lines once and writes the typed operations (never the documents) as
    Parquet to the shared folder; every analysis of operations reads the columns that it needs from there.
    ``store=False`` leaves that out, and each classifies anew.  ``close`` deletes what was written.  ``redact`` masks
    every column that may hold a user's text, after aggregation, and those of the views.
    """

    def __init__(self, spark: SparkSession, paths: list[str] | None = None, *, lines: DataFrame | None = None, rules: FilterRules | None = None, config: str | None = None, namespaces: list[str] | None = None, redact: bool = False, by_shard: bool = False, line_limit: int | None = None, store: bool = True):
        self.spark, self.namespaces, self.redact, self.by_shard, self.store = spark, namespaces, redact, by_shard, store
        self.folder: str | None = None
        self.rules = rules or (FilterRules.from_properties(config) if config else FilterRules())
        self.skipped: list[str] = []
        if lines is None:
            lines, self.skipped = read_lines(spark, paths or [], line_limit)
        self.lines = lines

    @cached_property
    def staged(self) -> DataFrame:
        return staged(self.lines, self.rules)

    @cached_property
    def documents(self) -> DataFrame:
        return parsed(self.staged.filter("stage = 'kept'"))

    @cached_property
    def classified(self) -> DataFrame:
        return classified(self.documents, self.namespaces)

    @cached_property
    def operations(self) -> DataFrame:
        ops = slow_op(self.classified)
        if not self.store:
            return ops
        self.folder = new_folder(self.spark, "operations")
        return stored(ops, self.folder)

    def close(self) -> None:
        if self.folder:
            removed(self.spark, self.folder)
            self.folder = None
            del self.operations

    def _masked(self, df: DataFrame) -> DataFrame:
        if not self.redact:
            return df
        for column in df.columns:
            if column in ("sample", "line", "sampleMetadata", "sampleAuth", "value"):
                df = df.withColumn(column, red.redacted(F.col(column)))
            elif column == "sanitizedFilter":
                df = df.withColumn(column, red.sanitized(F.col(column)))
            elif column in ("message", "username", "readPreferenceTags", "topReadPreferenceTags"):
                df = df.withColumn(column, red.redacted_text(F.col(column)))
            elif column in ("readPreferenceTagsCounts", "doc"):
                df = df.drop(column)
        return df

    def main_operations(self, **options) -> DataFrame:
        return self._masked(a.main_operations(self.operations, self.by_shard, **options))

    def main_summary(self) -> DataFrame:
        return a.main_summary(self.main_operations())

    def query_hash(self) -> DataFrame:
        return self._masked(a.query_hash(self.operations, self.by_shard))

    def plan_cache(self) -> DataFrame:
        return self._masked(a.plan_cache(self.operations, self.by_shard))

    def index_stats(self) -> DataFrame:
        return a.index_stats(self.operations, self.by_shard)

    def slow_planning(self, n: int = 50) -> DataFrame:
        return self._masked(a.slow_planning(self.operations, n))

    def error_codes(self) -> DataFrame:
        return self._masked(a.error_codes(a.error_events(self.documents), self.by_shard))

    def transactions(self) -> DataFrame:
        return a.transactions(a.transaction_rows(self.documents), self.by_shard)

    def ttl_operations(self) -> DataFrame:
        rows = parsed(self.staged.filter("ttl"))
        return a.ttl_operations(rows, prefilter.namespace_filter(get(F.col("doc"), "string", "attr", "namespace"), self.namespaces or []), self.by_shard)

    def drivers(self) -> DataFrame:
        return self._masked(d.driver_stats(self.documents))

    def appname_connections(self, scope: str = "all") -> DataFrame:
        return a.appname_connections(self.operations, scope)

    def op_type_stats(self) -> DataFrame:
        return a.op_type_stats(self.classified)

    def ignored_categories(self) -> DataFrame:
        return a.ignored_categories(self.staged)

    def run_stats(self) -> DataFrame:
        return a.run_stats(classified(parsed(self.staged), self.namespaces))

    def time_range(self) -> DataFrame:
        return a.time_range(self.documents)

    def sections(self) -> dict[str, DataFrame]:
        hashes, plans, codes, txns, index = self.query_hash(), self.plan_cache(), self.error_codes(), self.transactions(), self.index_stats()
        return {
            "main_summary": self.main_summary(), "main_operations": self.main_operations(), "ttl_operations": self.ttl_operations(), "op_type_stats": self.op_type_stats(),
            "query_hash": a.query_hash_top(hashes), "plan_cache": plans, "plan_cache_summary": a.plan_cache_summary(plans), "error_codes": codes,
            "transactions": txns, "termination_causes": a.termination_causes(txns), "index_stats": index, "index_summary": a.index_summary(index),
            "slow_planning": self.slow_planning(), "drivers": self.drivers(), "appname_connections": self.appname_connections(), "run_stats": self.run_stats(), "time_range": self.time_range(),
        }

    def write_csv(self, name: str, path: str) -> None:
        sinks.write_csv(name, getattr(self, name)(), path)

    def write_json(self, path: str) -> None:
        sinks.write_json(self.sections(), path, {"skipped": self.skipped, "redacted": self.redact})

    def write_html(self, path: str, title: str = "Log report") -> None:
        sinks.write_html(self.sections(), path, title)

    def write_ignored_sample(self, path: str) -> None:
        sinks.write_lines(self._masked(sinks.ignored_sample(self.staged)), path)

    def create_views(self) -> None:
        """log_lines, log_docs, slow_op and a view an analysis, for SQL; with ``redact`` log_docs has no document."""
        self._masked(self.staged).createOrReplaceTempView("log_lines")
        self._masked(self.documents).createOrReplaceTempView("log_docs")
        self._masked(self.operations).createOrReplaceTempView("slow_op")
        for name, df in self.sections().items():
            df.createOrReplaceTempView(name)


def trim_logs(lines: DataFrame, aggressive: bool = False, redact: bool = False, rules: FilterRules | None = None) -> DataFrame:
    """The rewriter: noise dropped, grep prefixes stripped, lines trimmed."""
    value = strip_prefix(F.col("value"))
    kept = lines.withColumn("value", value).filter(prefilter.json_like(F.col("value")) & ~prefilter.any_of(F.col("value"), (rules or FilterRules()).ignored))
    return kept.withColumn("value", red.processed(F.col("value"), redact, aggressive))
