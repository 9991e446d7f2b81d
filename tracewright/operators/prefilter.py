"""Line predicates that run before any JSON is parsed, and namespace predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.lines import LONGEST
from ..sources.rules import FilterRules

# Keys of commands that always keep a line.
KEPT_VERBS = ('"find":', '"aggregate":', '"update":', '"insert":', '"delete":', '"findAndModify":', '"getMore":', '"count":', '"distinct":')
# Categories of ignored lines, the first match wins.
CATEGORIES = (
    ('"c":"NETWORK"', "NETWORK"), ('"c":"ACCESS"', "ACCESS"), ('"c":"STORAGE"', "STORAGE"), ('"c":"CONTROL"', "CONTROL"),
    ('"hello":1', "HEALTH_CHECK"), ('"isMaster":1', "HEALTH_CHECK"), ('"replSetHeartbeat"', "REPLICATION"),
    ('"$db":"admin"', "ADMIN_DB"), ('"$db":"local"', "LOCAL_DB"), ('"$db":"config"', "CONFIG_DB"), ('"profile":', "PROFILING"), ("TTL", "TTL_MONITOR"),
)


def any_of(value: Column, parts: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (value.contains(p) for p in parts), F.lit(False))


def json_like(value: Column) -> Column:
    return value.rlike(r"^[\x00-\x20]*\{")


def always_kept(value: Column) -> Column:
    """Lines with a command, and those that driver statistics need."""
    access = value.contains('"c":"ACCESS"') & value.contains('"msg":"Successfully authenticated"')
    network = value.contains('"c":"NETWORK"') & any_of(value, ('"msg":"Connection accepted"', '"msg":"Connection ended"'))
    return any_of(value, KEPT_VERBS) | value.contains('"msg":"client metadata"') | access | network


def kept(value: Column, rules: FilterRules) -> Column:
    return json_like(value) & (always_kept(value) | ~any_of(value, rules.ignored))


def oversize(value: Column) -> Column:
    return F.length(value) >= LONGEST


def ttl_line(value: Column) -> Column:
    """Judged before ``kept``: an expiry line is counted even where it is noise."""
    return value.contains("TTL") & (value.contains("deleted") | value.contains("Deleted expired documents"))


def category(value: Column) -> Column:
    found = F
    for part, name in CATEGORIES:
        found = found.when(value.contains(part), name)
    return found.when(~json_like(value), "NON_JSON").otherwise("OTHER")


def namespace_filter(ns: Column, filters: list[str]) -> Column:
    """Exact names, ``db``, ``db.*``, or names with ``*``; the config database never passes, nor a null."""
    db = F.substring_index(ns, ".", 1)
    accepted = ns.isNotNull() & (db != "config")
    if not filters:
        return accepted
    tests = []
    for name in filters:
        if name.endswith(".*") and "*" not in name[:-2]:
            tests.append(db == name[:-2])
        elif "*" in name:
            tests.append(ns.rlike("^(?:" + ".*".join(re.escape(p) for p in name.split("*")) + ")$"))
        elif "." in name:
            tests.append(ns == name)
        else:
            tests.append(db == name)
    return accepted & reduce(Column.__or__, tests)
