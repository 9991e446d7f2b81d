"""Where results go: CSV, JSON, HTML, text, filtered logs and samples of ignored lines.

Reports hold aggregates.  They are written by the driver, to a file beside the target that is then renamed, so that a
broken run leaves no half report; CSV files of one part are written by Spark.
"""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redact import bold_fields

# Headers of the CSV reports and the columns they show.
_MAIN = [("Count", "count"), ("MinMs", "minMs"), ("MaxMs", "maxMs"), ("AvgMs", "avgMs"), ("P95Ms", "p95Ms"), ("TotalSec", "totalSec"), ("AvgKeysEx", "avgKeys"), ("AvgDocsEx", "avgDocs"), ("KeysP95", "p95Keys"), ("DocsP95", "p95Docs"), ("TotalKeysK", "totalKeysK"), ("TotalDocsK", "totalDocsK"), ("AvgReturn", "avgReturned"), ("ExRetRatio", "exRetRatio")]
CSV = {
    "main_operations": [("Namespace", "ns"), ("Operation", "op"), *_MAIN],
    "query_hash": [("QueryHash", "queryHash"), ("Namespace", "ns"), ("Operation", "op"), *_MAIN, ("ReadPreference", "readPreferences"), ("ReadPreferenceTags", "readPreferenceTags"), ("SanitizedQuery", "sanitizedFilter")],
    "plan_cache": [("Namespace", "ns"), ("QueryHash", "queryHash"), ("PlanSummary", "planSummary"), *_MAIN, ("CollScanCount", "collScanCount"), ("CollScanPct", "collScanPct"), ("MinPlanMs", "minPlanMs"), ("MaxPlanMs", "maxPlanMs"), ("AvgPlanMs", "avgPlanMs"), ("PlanP95Ms", "p95PlanMs"), ("ReplannedCount", "replannedCount"), ("ReplannedPct", "replannedPct"), ("MultiPlannerCount", "multiPlannerCount"), ("MultiPlannerPct", "multiPlannerPct"), ("TopReplanReason", "topReplanReasons")],
    "error_codes": [("CodeName", "codeName"), ("ErrorCode", "errorCode"), ("Count", "count"), ("SampleErrorMessage", "message")],
    "transactions": [("TxnRetryCounter", "txnRetryCounter"), ("TerminationCause", "terminationCause"), ("CommitType", "commitType"), ("Count", "count"), ("MinDurationMs", "minMs"), ("MaxDurationMs", "maxMs"), ("AvgDurationMs", "avgMs"), ("MaxCommitMs", "maxCommitMs"), ("AvgCommitMs", "avgCommitMs"), ("MaxTimeActiveMs", "maxActiveMs"), ("AvgTimeActiveMs", "avgActiveMs"), ("MaxTimeInactiveMs", "maxInactiveMs"), ("AvgTimeInactiveMs", "avgInactiveMs")],
    "slow_planning": [("PlanningTimeMicros", "planningTimeMicros"), ("PlanningTimeMs", "planningTimeMs"), ("Namespace", "ns"), ("Operation", "op"), ("PlanSummary", "planSummary"), ("SanitizedQuery", "sanitizedFilter")],
}


def csv_frame(name: str, df: DataFrame) -> DataFrame:
    if name == "main_operations":
        df = df.withColumn("ns", F.concat_ws(".", "db", "coll"))
    return df.select(*(F.col(c).alias(h) for h, c in CSV[name]))


def write_csv(name: str, df: DataFrame, path: str) -> None:
    """K1 to K6: one part with a header; quotes are doubled."""
    csv_frame(name, df).coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def _written(path: str, text: str) -> None:
    with open(f"{path}.part", "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(f"{path}.part", path)


def write_json(sections: dict[str, DataFrame], path: str, metadata: dict | None = None) -> None:
    """K7."""
    report = {"metadata": metadata or {}} | {name: [row.asDict(recursive=True) for row in df.collect()] for name, df in sections.items()}
    _written(path, json.dumps(report, ensure_ascii=False, indent=2, default=str))


PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>
body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse;margin:1em 0}}td,th{{border:1px solid #ccc;padding:3px 8px;vertical-align:top}}
th{{cursor:pointer;background:#f4f4f4}}td details{{max-width:60em;overflow-wrap:anywhere}}</style></head><body><h1>{title}</h1>{body}<script>
document.querySelectorAll('input').forEach(i=>i.oninput=()=>document.querySelectorAll('#'+i.dataset.t+' tbody tr').forEach(r=>r.hidden=!r.textContent.toLowerCase().includes(i.value.toLowerCase())));
const n=s=>parseFloat(s.replace(/[,%$a-zA-Zµ ]/g,''));
document.querySelectorAll('th').forEach(h=>h.onclick=()=>{{const b=h.closest('table').tBodies[0],k=h.cellIndex,d=h.d=-(h.d||1);[...b.rows].sort((x,y)=>{{const p=x.cells[k].textContent,q=y.cells[k].textContent;return d*(isNaN(n(p))||isNaN(n(q))?p.localeCompare(q):n(p)-n(q))}}).forEach(r=>b.append(r))}});
</script></body></html>"""


def write_html(sections: dict[str, DataFrame], path: str, title: str = "Log report") -> None:
    """K8: one table a section, with search, sorting by column, and samples that unfold."""
    parts = []
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        rows = []
        for row in df.collect():
            cells = []
            for column, value in row.asDict().items():
                text = "" if value is None else html.escape(str(value), quote=False)
                if column in ("sample", "line") and text:
                    text = f"<details><summary>sample</summary>{bold_fields(text)}</details>"
                cells.append(f"<td>{text.replace('&lt;br&gt;', '<br>')}</td>")
            rows.append(f"<tr>{''.join(cells)}</tr>")
        parts.append(f'<h2>{html.escape(name)}</h2><input data-t="{name}" placeholder="search"><table id="{name}"><thead><tr>{head}</tr></thead><tbody>{"".join(rows)}</tbody></table>')
    _written(path, PAGE.format(title=html.escape(title), body="".join(parts)))


def show(df: DataFrame, rows: int = 50, width: int = 60) -> None:
    """K9."""
    df.show(rows, truncate=width)


def console(name: str, df: DataFrame, count: str = "count", rows: int = 50) -> None:
    """K9: a title with the number of groups and their total count, then the first groups."""
    groups, whole = df.agg(F.count("*"), F.coalesce(F.sum(count), F.lit(0))).first()
    print(f"{name}: {groups} groups, {whole} in all")
    show(df.drop(*(c for c in ("sample", "line", "sampleMetadata", "sampleAuth") if c in df.columns)), rows)


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    """K10."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def ignored_sample(staged: DataFrame, every: int = 100) -> DataFrame:
    """Every hundredth ignored line of each file."""
    rows = staged.filter("stage = 'ignored'").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("line_no")))
    return rows.filter(F.col("k") % every == 0).select("file", "line_no", "value")
