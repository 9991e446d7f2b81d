"""Formatting and extraction of text, as Columns."""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB = 1024, 1024**2, 1024**3
# Host names of the hosted service, of which two parts are masked.
ATLAS = r"atlas-([a-zA-Z0-9]+)(-shard-[0-9]+-[0-9]+\.)([a-zA-Z0-9-]+)(\.mongodb\.net)(:[0-9]+)?"


def _scaled(n: Column, base: int, unit: str) -> Column:
    return F.format_string(f"%.1f{unit}", n / float(base))


def format_bytes(n: Column) -> Column:
    """0, 12B, 1.5KB."""
    return F.when(n == 0, "0").when(n < KB, F.concat(n.cast("string"), F.lit("B"))).when(n < MB, _scaled(n, KB, "KB")).when(n < GB, _scaled(n, MB, "MB")).otherwise(_scaled(n, GB, "GB"))


def format_bytes_long(n: Column) -> Column:
    """12 bytes, 1.5 KB."""
    return F.when(n < KB, F.concat(n.cast("string"), F.lit(" bytes"))).when(n < MB, _scaled(n, KB, " KB")).when(n < GB, _scaled(n, MB, " MB")).otherwise(_scaled(n, GB, " GB"))


def byte_unit(mean: Column) -> Column:
    """The unit of a column of sizes, from its mean."""
    return F.when(mean >= GB, "GB").when(mean >= MB, "MB").when(mean >= KB, "KB").otherwise("B")


def format_bytes_as(n: Column, unit: Column) -> Column:
    return F.when(unit == "GB", F.format_string("%.1f", n / float(GB))).when(unit == "MB", F.format_string("%.1f", n / float(MB))).when(unit == "KB", F.format_string("%.1f", n / float(KB))).otherwise(n.cast("string"))


def _part(ms: Column, size: int, modulo: int | None = None) -> Column:
    whole = F.floor(ms / size)
    return (whole % modulo if modulo else whole).cast("long").cast("string")


def format_duration(ms: Column, days: bool = False) -> Column:
    """12ms, 1.5s, 2m 3s, 1h 2m 3s, and with ``days`` 1d 2h 3m."""
    minutes = F.concat(_part(ms, 60_000), F.lit("m "), _part(ms, 1000, 60), F.lit("s"))
    hours = F.concat(_part(ms, 3_600_000), F.lit("h "), _part(ms, 60_000, 60), F.lit("m "), _part(ms, 1000, 60), F.lit("s"))
    out = F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.format_string("%.1fs", ms / 1000.0)).when(ms < 3_600_000, minutes)
    if days:
        whole = F.concat(_part(ms, 86_400_000), F.lit("d "), _part(ms, 3_600_000, 24), F.lit("h "), _part(ms, 60_000, 60), F.lit("m"))
        return out.when(ms < 86_400_000, hours).otherwise(whole)
    return out.otherwise(hours)


def format_planning(micros: Column) -> Column:
    """Microseconds below a millisecond; milliseconds with 2, 1 or 0 decimals; seconds."""
    ms = micros / 1000.0
    return F.when(micros < 1000, F.concat(micros.cast("string"), F.lit("µs"))).when(ms < 10, F.format_string("%.2fms", ms)).when(ms < 100, F.format_string("%.1fms", ms)).when(ms < 1000, F.format_string("%.0fms", ms)).otherwise(F.format_string("%.2fs", ms / 1000.0))


def format_lifetime(ms: Column) -> Column:
    """N/A for none."""
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "N/A").otherwise(format_duration(ms, days=True))


def format_lifetime_short(ms: Column) -> Column:
    """X6 as driver tables show it: N/A, 12ms, 1.5s, 12s, 2m 3s, 1h 2m; what is zero is left out."""
    seconds = F.floor(ms / 1000)
    two = lambda big, high, small, low: F.concat(big.cast("string"), F.lit(high), F.when(small > 0, F.concat(F.lit(" "), small.cast("string"), F.lit(low))).otherwise(""))
    part = lambda size, modulo: (F.floor(ms / size) % modulo).cast("long")
    short = F.when(F.coalesce(ms, F.lit(0)) == 0, "N/A").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
    short = short.when((seconds < 10) & (ms % 1000 > 0), F.format_string("%.1fs", ms / 1000.0)).when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
    return short.when(seconds < 3600, two(part(60_000, 60), "m", part(1000, 60), "s")).otherwise(two(F.floor(ms / 3_600_000).cast("long"), "h", part(60_000, 60), "m"))


def truncate(s: Column, width: int) -> Column:
    """An ellipsis within the width; a hard cut where there is no room for one."""
    return F.when(F.length(s) <= width, s).when(F.lit(width <= 3), F.substring(s, 1, width)).otherwise(F.concat(F.substring(s, 1, max(0, width - 3)), F.lit("...")))


def truncate_lines(s: Column, width: int, sep: str = "<br>") -> Column:
    """Each line of several."""
    return F.array_join(F.transform(F.split(s, re.escape(sep)), lambda x: truncate(x, width)), sep)


def csv_cell(s: Column) -> Column:
    """Quoted where a comma, quote or line end stands."""
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def html_cell(s: str) -> str:
    """X11: five entities; <strong> survives."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = s.replace(a, b)
    return s.replace("&lt;strong&gt;", "<strong>").replace("&lt;/strong&gt;", "</strong>")


def host_of(remote: Column) -> Column:
    """The host of host:port; brackets of an IPv6 address stay."""
    return F.when(remote.isNotNull(), F.regexp_extract(remote, r"^(\[[^\]]*\]|.+?)(?::[^:]*)?$", 1))


def _compressed(plan: str | None) -> str | None:
    if plan is None or len(plan) < 50:
        return plan
    parts, depth, current = [], 0, []
    for c in plan:
        depth += (c == "{") - (c == "}")
        if c == "," and depth <= 0:
            parts.append("".join(current).strip())
            current = []
        else:
            current.append(c)
    parts.append("".join(current).strip())
    if len(parts) < 3:
        return plan
    return ", ".join(p if n == 1 else f"{p} (x{n})" for p, n in Counter(parts).items())


def compress_plan(plan: Column) -> Column:
    """Repeated stages of long plans are counted; commas inside braces, nested or not, don't part stages."""

    @F.pandas_udf("string")
    def compressed(s: pd.Series) -> pd.Series:
        return s.map(_compressed, na_action="ignore")

    return F.when(F.length(plan) < 50, plan).otherwise(compressed(plan))


def format_range(first: Column, last: Column) -> Column:
    """Times cut to seconds, one date if equal, and the time between."""
    a, b = (F.replace(F.substring(x, 1, 19), F.lit("T"), F.lit(" ")) for x in (first, last))
    between = F.unix_millis(F.try_to_timestamp(last)) - F.unix_millis(F.try_to_timestamp(first))
    shown = F.when(F.substring(a, 1, 10) == F.substring(b, 1, 10), F.concat(a, F.lit(" - "), F.substring(b, 12, 8))).otherwise(F.concat(a, F.lit(" - "), b))
    return F.concat(shown, F.coalesce(F.concat(F.lit(" ("), format_duration(between, days=True), F.lit(")")), F.lit("")))


def fast_ctx(line: Column) -> Column:
    """Ctx without parsing."""
    return F.nullif(F.regexp_extract(line, r'"ctx":"([^"]*)"', 1), F.lit(""))


def fast_time(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r'"\$date":"([^"]*)"', 1), F.lit(""))


def _holds_truncated(value) -> bool:
    if isinstance(value, dict):
        cut = value.get("truncated")
        return isinstance(cut, dict) and "errMsg" in cut or any(map(_holds_truncated, value.values()))
    return isinstance(value, list) and any(_holds_truncated(v) for v in value if isinstance(v, dict))


def _truncated(line: str | None) -> bool | None:
    if line is None:
        return None
    try:
        return _holds_truncated(json.loads(line))
    except ValueError:
        return True


def is_truncated(line: Column) -> Column:
    """An object ``truncated``, at any depth, that holds ``errMsg``; by substrings where the line isn't JSON.

    Only lines that hold both names are walked through.
    """

    @F.pandas_udf("boolean")
    def walked(s: pd.Series) -> pd.Series:
        return s.map(_truncated, na_action="ignore")

    both = line.contains('"truncated"') & line.contains('"errMsg"')
    return F.when(line.isNotNull(), F.coalesce(walked(F.when(both, line)), F.lit(False)))


def query_source(line: Column) -> Column:
    """X17."""
    return F.when(line.contains('"mongos"') | line.contains('"fromMongos"'), " (from mongos)").otherwise(" (from mongod)")


def epoch_millis(at: Column) -> Column:
    """-1 where the time can't be read."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(at)), F.lit(-1).cast("long"))


def mask_atlas(s: Column) -> Column:
    """R3 for a field that is kept: only the parts of hosted names that tell are masked."""
    return F.regexp_replace(s, ATLAS, "atlas-xxx$2xxx$4$5")


def sample_facts() -> dict[str, Column]:
    """What reports read from a column ``line``, with a pattern where the JSON is bad."""
    number = lambda *paths: F.coalesce(*(F.expr(f"try_cast(get_json_object(line, '{p}') AS BIGINT)") for p in paths))
    read = F.coalesce(number("$.attr.storage.data.bytesRead", "$.attr.storage.bytesRead"), F.expr("try_cast(nullif(regexp_extract(line, '\"bytesRead\":([0-9]+)', 1), '') AS BIGINT)"))
    return {"duration": format_duration(number("$.attr.durationMillis")), "bytes_read": format_bytes_long(read), "planning": format_planning(number("$.attr.planningTimeMicros")), "storage_time": format_planning(number("$.attr.timeReadingMicros"))}


def format_size(n: int) -> str:
    """A file's size."""
    for base, unit in ((GB, "GB"), (MB, "MB"), (KB, "KB")):
        if n >= base:
            return f"{n / base:.1f} {unit}"
    return f"{n} B"
