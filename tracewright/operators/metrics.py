"""The metric vocabulary shared by the analyses.

Counts are of rows with a duration, averages are integer quotients of sums by that count, and percentiles are
exact, of type 6 (position p * (n + 1)).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def quotient(total: Column, count: Column) -> Column:
    """Integer quotient, 0 where the divisor isn't positive."""
    return F.when(count > 0, _div(total, count)).otherwise(F.lit(0).cast("long"))


def _div(a: Column, b: Column) -> Column:
    """Truncating division of longs."""
    return F.call_function("div", a, b)


def total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0).cast("long"))


def micros_to_millis(x: Column) -> Column:
    """Rounded, halves towards positive infinity."""
    return F.floor(x / 1000.0 + 0.5).cast("long")


def p95(name: str | Column, p: float = 0.95) -> Column:
    """Type-6 percentile as an aggregate over a sorted list, for groups of a bounded size; 0.0 without values."""
    a = F.sort_array(F.collect_list(name))
    n = F.size(a)
    at = p * (n + 1)
    k = F.floor(at).cast("int")
    low, high = F.get(a, k - 1).cast("double"), F.get(a, k).cast("double")
    return F.when(n == 0, 0.0).when(at < 1, F.get(a, F.lit(0)).cast("double")).when(at >= n, F.get(a, n - 1).cast("double")).otherwise(low + (at - k) * (high - low))


def ranked(rows: DataFrame, keys: list[str], values: dict[str, Column], p: float = 0.95) -> DataFrame:
    """Type-6 percentiles of several values by name, of groups of any size, in one pass over the rows.

    Equal values are counted first, before the shuffle as far as tasks hold them, so a group is as large as its
    different values; a window adds the counts up along them, and the two values at the wanted ranks are picked.
    """
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), v.cast("long").alias("v")) for i, v in enumerate(values.values())))
    spread = rows.select(*keys, F.explode(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("x"))
    counted = spread.groupBy(*keys, F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys, "i")
    ends = counted.withColumn("last", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = p * (F.col("n") + 1)
    k = F.greatest(F.lit(1), F.least(F.floor(at), F.col("n")))
    holds = lambda rank: (F.col("last") >= rank) & (F.col("last") - F.col("c") < rank)
    ends = ends.withColumn("low", F.when(holds(k), F.col("v"))).withColumn("high", F.when(holds(F.least(k + 1, F.col("n"))), F.col("v")))
    of = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    picked = ends.groupBy(*keys).agg(*(of(i, c).alias(f"{c}{i}") for i in range(len(values)) for c in ("n", "low", "high")))

    def between(i: int) -> Column:
        n, low, high = (F.col(f"{c}{i}") for c in ("n", "low", "high"))
        at = p * (n + 1)
        inside = low + (at - F.floor(at)) * (high - low)
        return F.coalesce(F.when((at < 1) | (at >= n), low.cast("double")).otherwise(inside), F.lit(0.0))

    return picked.select(*keys, *(between(i).alias(name) for i, name in enumerate(values)))


def grouped(rows: DataFrame, keys: list[str], aggregates: list[Column], percentiles: dict[str, Column]) -> DataFrame:
    """Rows grouped by keys, of which null is a value, with aggregates and percentiles; rows are read twice."""
    out = null_safe_join(rows.groupBy(*keys).agg(*aggregates), ranked(rows, keys, percentiles), keys)
    return out.fillna(0.0, [*percentiles])


def ranked_p95(rows: DataFrame, keys: list[str], name: str, out: str, p: float = 0.95) -> DataFrame:
    """One percentile of the groups that have a value."""
    return ranked(rows.filter(F.col(name).isNotNull()), keys, {out: F.col(name)}, p)


def sample_line() -> Column:
    """The slowest row's line, the last of equals; without durations the first line."""
    at = F.struct("durationMillis", "file", "line_no")
    return F.coalesce(F.max_by(F.when(F.col("durationMillis").isNotNull(), F.col("line")), F.when(F.col("durationMillis").isNotNull(), at)), F.min_by("line", F.struct("file", "line_no"))).alias("sample")


def _docs(need_keys: bool) -> Column:
    return F.when(F.col("keysExamined").isNotNull(), F.col("docsExamined")) if need_keys else F.col("docsExamined")


def ranked_values(docs_need_keys: bool = False, planning: bool = False) -> dict[str, Column]:
    """The values of which percentiles are taken; planning times in microseconds."""
    found = {"p95Ms": F.col("durationMillis"), "p95Keys": F.col("keysExamined"), "p95Docs": _docs(docs_need_keys)}
    return found | ({"p95PlanMicros": F.col("planningTimeMicros")} if planning else {})


def vocabulary(docs_need_keys: bool = False) -> list[Column]:
    """Aggregates from which ``derived`` makes the metrics."""
    docs = _docs(docs_need_keys)
    return [
        F.count("durationMillis").alias("count"),
        F.coalesce(F.min("durationMillis"), F.lit(0).cast("long")).alias("minMs"),
        F.coalesce(F.max("durationMillis"), F.lit(0).cast("long")).alias("maxMs"),
        total("durationMillis").alias("totalMs"),
        total("keysExamined").alias("totalKeys"),
        F.coalesce(F.sum(docs), F.lit(0).cast("long")).alias("totalDocs"),
        total("nreturned").alias("totalReturned"),
        total("nShards").alias("totalShards"),
        total("reslen").alias("totalReslen"),
        total("bytesRead").alias("totalBytesRead"),
        F.coalesce(F.max("bytesRead"), F.lit(0).cast("long")).alias("maxBytesRead"),
        total("bytesWritten").alias("totalBytesWritten"),
        F.coalesce(F.max("bytesWritten"), F.lit(0).cast("long")).alias("maxBytesWritten"),
        total("writeConflicts").alias("totalWriteConflicts"),
        F.count_if("is_error").alias("errorCount"),
    ]


def derived(grouped: DataFrame) -> DataFrame:
    N = F.col("count")
    made = {
        "avgMs": quotient(F.col("totalMs"), N),
        "totalSec": _div(F.col("totalMs"), F.lit(1000).cast("long")),
        "avgKeys": quotient(F.col("totalKeys"), N),
        "avgDocs": quotient(F.col("totalDocs"), N),
        "totalKeysK": F.col("totalKeys") / 1000.0,
        "totalDocsK": F.col("totalDocs") / 1000.0,
        "avgReturned": quotient(F.col("totalReturned"), N),
        "exRetRatio": quotient(F.col("totalDocs"), F.col("totalReturned")),
        "avgShards": quotient(F.col("totalShards"), N),
        "avgReslen": quotient(F.col("totalReslen"), N),
        "avgBytesRead": quotient(F.col("totalBytesRead"), N),
        "avgBytesWritten": quotient(F.col("totalBytesWritten"), N),
        "avgWriteConflicts": quotient(F.col("totalWriteConflicts"), N),
    }
    if "p95PlanMicros" in grouped.columns:
        made["p95PlanMs"] = F.col("p95PlanMicros") / 1000.0
    return grouped.withColumns(made).drop("p95PlanMicros")


def planning() -> list[Column]:
    """Planning times: milliseconds rounded."""
    m = "planningTimeMicros"
    return [
        F.coalesce(micros_to_millis(F.min(m)), F.lit(0).cast("long")).alias("minPlanMs"),
        F.coalesce(micros_to_millis(F.max(m)), F.lit(0).cast("long")).alias("maxPlanMs"),
        F.coalesce(micros_to_millis(_div(F.sum(m), F.count(m))), F.lit(0).cast("long")).alias("avgPlanMs"),
        F.count_if("replanned").alias("replannedCount"),
        F.count_if("fromMultiPlanner").alias("multiPlannerCount"),
    ]


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def value_counts(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Per key and named value, in one pass: counts by value as a map, the summary ``v: n<br>...`` in falling order, and the commonest."""
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values.values())))
    spread = rows.select(*keys, F.explode(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("x"))
    counted = spread.groupBy(*keys, F.col("x.i").alias("i"), F.col("x.v").alias("v")).agg(F.count("*").alias("c"))
    # one entry for each different value of a group
    entries = lambda i: F.array_sort(F.collect_list(F.when(F.col("i") == i, F.struct((-F.col("c")).alias("c"), "v"))))
    out = counted.groupBy(*keys).agg(*(entries(i).alias(f"l{i}") for i in range(len(values))))
    made = []
    for i, name in enumerate(values):
        some = F.when(F.size(f"l{i}") > 0, F.col(f"l{i}"))
        counts = F.map_from_entries(F.transform(some, lambda e: F.struct(e["v"].alias("k"), (-e["c"]).alias("n"))))
        shown = F.array_join(F.transform(some, lambda e: F.concat(e["v"], F.lit(": "), F.format_number(-e["c"], 0))), "<br>")
        made += [counts.alias(f"{name}Counts"), shown.alias(name), F.get(some, F.lit(0))["v"].alias(f"top{name[0].upper()}{name[1:]}")]
    return out.select(*keys, *made)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys of which null is a value."""
    r = right.select(*(F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns))
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return left.join(r, on, how).drop(*(f"__{k}" for k in keys))
