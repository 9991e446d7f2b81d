"""From documents to the table of slow operations.

The fixed part of a line's attributes is read by one cast to a struct.  A field is of type VARIANT there if it
matters that it is present, if it may be of several types, or if it holds a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefilter
from .documents import get, is_text, once

# Command keys in the order in which they are tried, with the operation each stands for.
VERBS = (("find", "find"), ("aggregate", "aggregate"), ("findAndModify", "findAndModify"), ("update", "update"), ("insert", "insert"), ("delete", "remove"), ("getMore", "getMore"), ("count", "count"), ("distinct", "distinct"))
# Keys of administrative commands.
ADMINISTRATIVE = ("drop", "dropDatabase", "dropIndexes", "createIndexes", "collMod", "renameCollection", "validate", "compact", "reIndex", "explain", "currentOp", "killOp", "fsync", "eval", "listCollections", "planCacheClear", "configureFailPoint", "killCursors", "abortTransaction", "commitTransaction", "startTransaction")


def _struct(**groups: str) -> str:
    """A struct type from groups of field names by type."""
    return "struct<" + ",".join(f"`{name}`:{kind.replace('__', '')}" for kind, names in groups.items() for name in names.split()) + ">"


_STORAGE = "struct<bytesRead:bigint,bytesWritten:bigint,data:struct<bytesRead:bigint,bytesWritten:bigint>>"
_COMMAND = _struct(variant=" ".join(key for key, _ in VERBS) + " collection q filter pipeline $readPreference")
_ORIGIN = _struct(variant="filter pipeline $readPreference")
ATTR = _struct(
    string="msg ns appName queryHash planCacheKey planSummary replanReason remote",
    bigint="ok durationMillis reslen nShards planningTimeMicros ninserted ndeleted numDeleted keysExamined docsExamined writeConflicts",
    boolean="replanned fromMultiPlanner",
    variant="namespace type nreturned nMatched nModified nUpserted error",
)[:-1] + f",storage:{_STORAGE},command:{_COMMAND},originatingCommand:{_ORIGIN}>"


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _json(value: Column) -> Column:
    return F.when(_is(value, "OBJECT"), F.to_json(value))


def _read_preference(a: Column, field: str) -> Column:
    """mode or tags, from the command or else from the command that began it."""
    found = []
    for where in ("command", "originatingCommand"):
        value = a[where]["$readPreference"]
        if field == "mode":
            mode = get(value, "variant", "mode")
            found.append(F.when(is_text(value), _as(value, "string")).otherwise(F.when(is_text(mode), _as(mode, "string"))))
        else:
            tags = get(value, "variant", "tags")
            one = lambda tag: F.array_join(F.transform(F.map_entries(tag), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
            many = F.array_join(F.transform(_as(tags, "array<map<string,string>>"), one), "<br>")
            found.append(F.when(_is(tags, "ARRAY"), many).when(_is(tags, "OBJECT"), one(_as(tags, "map<string,string>"))))
    return F.coalesce(*found)


def _filter(a: Column) -> Column:
    """The query as JSON: q, else filter, else the first $match, else that of the command that began it."""
    command = a["command"]
    matches = F.filter(F.transform(_as(command["pipeline"], "array<variant>"), lambda s: get(s, "variant", "$match")), lambda m: _is(m, "OBJECT"))
    return F.coalesce(_json(command["q"]), _json(command["filter"]), F.to_json(F.get(matches, F.lit(0))), _json(a["originatingCommand"]["filter"]))


def _other_key(doc: Column) -> Column:
    """The smallest key of a shard or administrative command."""
    keys = F.json_object_keys(F.to_json(get(doc, "variant", "attr", "command")))
    return F.array_min(F.filter(keys, lambda k: k.startswith("_shardsv") | k.isin(*ADMINISTRATIVE)))


def _changes(a: Column) -> Column:
    stages = _as(a["originatingCommand"]["pipeline"], "array<variant>")
    return F.coalesce(F.exists(stages, lambda s: get(s, "variant", "$changeStream").isNotNull()), F.lit(False))


#: Metrics that an index line doesn't have.
_PLAIN = ("reslen", "queryHash", "appName", "remote", "nShards", "planCacheKey", "planSummary", "planningTimeMicros", "replanned", "replanReason", "fromMultiPlanner", "writeConflicts")


def classified(docs: DataFrame, namespaces: list[str] | None = None, attr_msg_only: bool = False) -> DataFrame:
    """One row a kept line, with branch, operation, labels and all metrics; ``slow_op`` has the operations.

    branch: metadata, index, write, command, or none.  status says what became of the line: parse_error,
    no_attr, metadata, no_ns, filtered, unknown, or op.
    """
    a = F.col("a")
    rows = docs.withColumn("a", once(get(F.col("doc"), ATTR, "attr")))
    message = a["msg"] if attr_msg_only else F.coalesce(a["msg"], F.col("msg"))
    expired = F.coalesce(message.contains("Deleted expired documents"), F.lit(False))
    branch = (
        F.when((F.col("component") == "NETWORK") & (F.col("msg") == "client metadata"), "metadata")
        .when((F.col("component") == "INDEX") & (expired | a["namespace"].isNotNull()), "index")
        .when((F.col("component") == "WRITE") & a["type"].isNotNull(), "write")
        .when(a["command"].isNotNull(), "command")
        .otherwise("none")
    )
    verb = F
    for key, _ in VERBS:
        verb = verb.when(a["command"][key].isNotNull(), key)
    # other keys are looked for only where no verb is
    rows = rows.withColumns({"branch": once(branch), "expired": once(expired), "verb": once(F.when(a["command"].isNotNull(), verb.otherwise(_other_key(F.col("doc")))))})
    rows = rows.withColumn("verb", F.when(F.col("branch") == "command", F.col("verb"))).withColumn("ns_raw", F.when(F.col("branch") == "index", _as(a["namespace"], "string")).otherwise(a["ns"]))
    kind = _as(a["type"], "string")
    expired = F.col("expired")
    operation = F.when(F.col("branch") == "index", F.when(expired, "remove").otherwise("command"))
    operation = operation.when(F.col("branch") == "write", F.when(kind == "update", "update_w").when(kind.isin("remove", "delete"), "remove").when(kind == "insert", "insert").otherwise("command"))
    named = F
    for key, name in VERBS:
        named = named.when(F.col("verb") == key, name)
    operation = operation.when(F.col("branch") == "command", named.when(F.col("verb").isNotNull(), "command"))
    # a collection may be named by the command itself
    value = F
    for key, _ in VERBS:
        value = value.when(F.col("verb") == key, a["command"]["collection" if key == "getMore" else key])
    value = value.otherwise(None)
    given = F.when(is_text(value), _as(value, "string"))
    given = F.when((F.col("verb") != "aggregate") | (given != "1"), given)
    db = F.substring_index("ns_raw", ".", 1)
    rest = F.when(F.instr("ns_raw", ".") > 0, F.expr("substring(ns_raw, instr(ns_raw, '.') + 1)"))
    rows = rows.withColumn("op", operation).withColumn("db", db).withColumn("coll", F.when(F.col("branch") == "command", F.coalesce(given, rest)).otherwise(rest))
    accepted = prefilter.namespace_filter(F.col("ns_raw"), namespaces or [])
    status = (
        F.when(F.col("doc").isNull(), "parse_error").when(a.isNull(), "no_attr").when(F.col("branch") == "metadata", "metadata")
        .when(F.col("branch").isin("write", "command") & F.col("ns_raw").isNull(), "no_ns")
        .when(F.col("branch") == "none", "unknown").when(F.coalesce(~accepted, F.lit(True)), "filtered").when(F.col("op").isNull(), "unknown").otherwise("op")
    )
    changed = F.when(a["nMatched"].isNotNull() | a["nModified"].isNotNull() | a["nUpserted"].isNotNull(), F.coalesce(_as(a["nModified"], "bigint"), _as(a["nUpserted"], "bigint")))
    returned = F.coalesce(a["ninserted"], a["ndeleted"], changed, _as(a["nreturned"], "bigint"))
    gated = lambda key: F.when(a["nreturned"].isNotNull(), a[key])
    stored = lambda key: F.coalesce(a["storage"][key], a["storage"]["data"][key])
    indexed = F.col("branch") == "index"
    only = lambda column: F.when(~indexed, column)
    label = F.when(F.col("branch") == "command", F.when(F.col("verb").startswith("_shardsv"), F.concat(F.lit("shard_"), "verb")).otherwise(F.col("verb")))
    labels = F.when(F.col("branch") == "command", F.when(F.col("ns_raw").isNotNull() & accepted, F.array(label)))
    labels = labels.when(F.col("branch") == "write", F.array(F.when(kind == "update", "update_w").when(kind.isin("remove", "delete"), "delete_w").when(kind == "insert", "insert_w").otherwise(F.concat(F.lit("write_"), kind))))
    step = F.when(expired, "ttl_delete").when(message.isNull(), "index_maintenance").when(message.contains("Index build"), "index_build").when(message.contains("Index drop"), "index_drop").otherwise("index_other")
    labels = labels.when(indexed, F.array(step, F.lit("index_operation")))
    return rows.withColumns(
        {
            "status": once(status),
            "labels": F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isNotNull()),
            "ns": F.concat_ws(".", "db", "coll"),
            "nreturned": F.when(indexed, F.when(expired, a["numDeleted"])).otherwise(returned),
            "keysExamined": only(gated("keysExamined")),
            "docsExamined": only(gated("docsExamined")),
            "durationMillis": a["durationMillis"],
            "bytesRead": only(stored("bytesRead")),
            "bytesWritten": only(stored("bytesWritten")),
            "readPreference": only(_read_preference(a, "mode")),
            "readPreferenceTags": only(_read_preference(a, "tags")),
            "sanitizedFilter": only(_filter(a)),
            "isChangeStream": F.coalesce((F.col("verb") == "getMore") & _changes(a), F.lit(False)),
            "is_error": F.coalesce(a["ok"] == 0, F.lit(False)) | F.coalesce(a["error"].isNotNull(), F.lit(False)),
        }
        | {name: only(a[name]) for name in _PLAIN}
    ).drop("a")


SLOW_OP = ["file", "line_no", "shard", "node", "t_raw", "t_ms", "ctx", "conn_id", "component", "msg", "branch", "ns_raw", "db", "coll", "ns", "op", "docsExamined", "keysExamined", "nreturned", "durationMillis", "reslen", "bytesRead", "bytesWritten", "queryHash", "appName", "remote", "nShards", "planCacheKey", "planSummary", "planningTimeMicros", "replanned", "replanReason", "fromMultiPlanner", "readPreference", "readPreferenceTags", "sanitizedFilter", "writeConflicts", "isChangeStream", "is_error", "line"]


def slow_op(classed: DataFrame) -> DataFrame:
    """The operations alone, without the document."""
    return classed.filter("status = 'op'").withColumnRenamed("value", "line").select(*SLOW_OP)


# Tags that tell what kind of node a read preference asks for, analytics first.
ANALYTICS_TAGS = ("nodeType: analytics", "workloadType: analytics", "role: analytics")
VOTING_TAGS = ("nodeType: voting", "workloadType: operational")


def node_type(tags: Column) -> Column:
    """of ``readPreferenceTags`` the kind of node that the first telling tag set names, else null.

    A tag set with a provider and a region names an operational node.
    """
    def of(one: Column) -> Column:
        parts = F.split(one, ", ")
        holds = lambda wanted: F.arrays_overlap(parts, F.array(*map(F.lit, wanted)))
        keys = F.transform(parts, lambda x: F.substring_index(x, ": ", 1))
        placed = F.array_contains(keys, "provider") & F.array_contains(keys, "region")
        return F.when(holds(ANALYTICS_TAGS), "analytics").when(holds(VOTING_TAGS) | placed, "voting")

    return F.get(F.filter(F.transform(F.split(tags, "<br>"), of), lambda x: x.isNotNull()), F.lit(0))


def op_dimension(spark) -> DataFrame:
    """Operations with whether they have a query shape and execution statistics."""
    rows = [(name, name in ("find", "aggregate", "findAndModify", "update", "remove", "count", "distinct", "getMore"), name != "command") for name in dict.fromkeys(n for _, n in VERBS)] + [("update_w", True, True), ("command", False, False)]
    return spark.createDataFrame(rows, "op string, supports_query_shape boolean, supports_exec_stats boolean")
