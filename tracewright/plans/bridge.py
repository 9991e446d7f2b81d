"""Tables rendered as log files, so that whole analyses run from files and can be compared with SQL on the tables.

Every rule below has its twin in ``oracles.SLOW`` and the other common tables there.  A session renders each set
of files once, into the shared folder.
"""

from __future__ import annotations

import gzip
import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import file_system, new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out for rendering: small files are read by one task."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(spark.sparkContext.defaultParallelism)


def _lines(df: DataFrame, file: Column, number: Column, value: Column) -> DataFrame:
    return df.select(file.alias("file"), number.cast("long").alias("number"), value.alias("value"))


#: Files that a session has rendered, by application, tables and kind.
_RENDERED: dict[tuple[str, str, str], list[str]] = {}


def log_files(spark: SparkSession, sf_dir: str, *kinds: str) -> list[str]:
    """Paths of the log files of some of RENDERERS."""
    return [path for kind in kinds for path in _rendered(spark, sf_dir, kind)]


def _rendered(spark: SparkSession, sf_dir: str, kind: str) -> list[str]:
    key = spark.sparkContext.applicationId, sf_dir, kind
    if key not in _RENDERED:
        folder = new_folder(spark, kind)
        lines = RENDERERS[kind](spark, sf_dir).withColumn("name", F.col("file"))
        # a file is one part; in this order the writer need not sort by name, which would lose the lines' order
        lines.repartition("name").sortWithinPartitions("name", "number").select("name", "value").write.partitionBy("name").text(folder)
        system, where = file_system(spark, folder)
        paths = []
        for part in system.globStatus(file_system(spark, f"{folder}/name=*/part-*")[1]):
            name = part.getPath().getParent().getName().removeprefix("name=")
            target = f"{folder}/{name.replace('%2F', '/')}"
            system.mkdirs(file_system(spark, target)[1].getParent())
            system.rename(part.getPath(), file_system(spark, target)[1])
            paths.append(target)
        _RENDERED[key] = sorted(paths)
    return _RENDERED[key]


def packed_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """A few lines as two plain files of one name, a gzip file and a zip file of two members, beside a path that isn't there."""
    key = spark.sparkContext.applicationId, sf_dir, "packed"
    if key not in _RENDERED:
        plain = log_files(spark, sf_dir, "copies")
        lines = [r.value for r in _table(spark, sf_dir, "nation").select(_copied(F.col("n_nationkey")).alias("value")).orderBy("n_nationkey").collect()]  # 25 rows
        text = "".join(f"{line}\n" for line in lines)
        zipped = io.BytesIO()
        with zipfile.ZipFile(zipped, "w") as archive:
            archive.writestr("in/mongod.log", text)
            archive.writestr("mongod.log.gz", gzip.compress(text.encode()))
        folder = new_folder(spark, "packed")
        paths = [*plain]
        for name, data in (("mongod.log.gz", gzip.compress(text.encode())), ("logs.zip", zipped.getvalue())):
            system, where = file_system(spark, f"{folder}/{name}")
            out = system.create(where)
            out.write(bytearray(data))
            out.close()
            paths.append(f"{folder}/{name}")
        _RENDERED[key] = [*paths, f"{folder}/none.log"]
    return _RENDERED[key]


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def _when(condition: Column, value: Column | str) -> Column:
    return F.when(condition, F.lit(value) if isinstance(value, str) else value)


def event_lines(spark: SparkSession, sf_dir: str, sharded: bool = False) -> DataFrame:
    """Slow commands, some of which failed."""
    e, u = F.col("event_id"), F.col("user_id")
    events = _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k = F.col("k")
    text = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    verbs = [_when(e % 5 == i, F.col("event_type")).alias(v) for i, v in enumerate(("find", "aggregate", "update", "insert", "delete"))]
    tags = F.array(F.struct(F.lit("ANALYTICS").alias("nodeType"), text("r", u % 2).alias("region")))
    preference = F.when(e % 3 == 0, F.struct(F.lit("secondary").alias("mode"), tags.alias("tags"))).when(e % 3 == 1, F.struct(F.lit("primary").alias("mode"), F.lit(None).cast("array<struct<nodeType:string,region:string>>").alias("tags")))
    command = F.struct(*verbs, F.when(e % 5 == 0, F.struct((u % 3).alias("uid"))).alias("filter"), F.lit("app").alias("$db"), preference.alias("$readPreference"))
    replanned = e % 23 == 0
    failed, explicit = (F.col("event_type") == "error") & (e % 4 == 0), (F.col("event_type") == "error") & (e % 4 == 1)
    space = F.when(u % 31 == 7, "config").when(u % 4 == 0, "shop").otherwise("app")
    storage = F.struct(
        F.when(e % 2 == 0, F.struct((k * 1000).alias("bytesRead"), F.when(e % 9 == 0, k).alias("bytesWritten"))).alias("data"),
        F.when(e % 2 == 1, k * 10).alias("bytesRead"),
    )
    attr = F.struct(
        F.lit("command").alias("type"), F.concat(space, F.lit(".$cmd")).alias("ns"), F.when(e % 11 != 0, text("svc", u % 4)).alias("appName"), command.alias("command"),
        F.when(e % 17 != 0, F.when(k < 20, "COLLSCAN").otherwise("IXSCAN { k: 1 }")).alias("planSummary"), k.alias("keysExamined"), (2 * k).alias("docsExamined"),
        F.when(e % 6 != 0, e % 7).alias("nreturned"), F.when((e % 5 == 2) & (e % 4 == 0), k % 3).alias("nModified"), F.when(e % 7 != 3, text("H", u % 10)).alias("queryHash"),
        F.when(e % 3 != 0, text("P", u % 6)).alias("planCacheKey"), F.when(e % 19 != 0, k * 100 + e % 97).alias("planningTimeMicros"), F.when(replanned, F.lit(True)).alias("replanned"),
        F.when(replanned, text("reason", k % 3)).alias("replanReason"), F.when(e % 10 == 0, F.lit(True)).alias("fromMultiPlanner"), (e % 1000).alias("reslen"), F.when(e % 2 == 0, e % 3).alias("nShards"),
        F.when(e % 5 == 2, e % 4).alias("writeConflicts"), storage.alias("storage"), F.concat(F.lit("10.0.0."), (u % 250).cast("string"), F.lit(":27017")).alias("remote"),
        F.when(failed, 0).alias("ok"), F.when(failed & (e % 8 != 0), text("Err", e % 3)).alias("errName"), F.when(failed, e % 3 + 1).alias("errCode"), F.when(failed, text("m", e)).alias("errMsg"),
        F.when(explicit, F.struct(text("Code", e % 5).alias("codeName"), (e % 5).alias("code"), text("e", e).alias("errmsg"))).alias("error"),
        F.when(e % 13 != 0, F.floor("value").cast("long")).alias("durationMillis"),
    )
    at = F.struct(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'").alias("$date"))
    value = _json(t=at, s=F.lit("I"), c=F.lit("COMMAND"), id=F.lit(51803), ctx=text("conn", u), msg=F.lit("Slow query"), attr=attr)
    file = F.when(u % 5 == 4, "plain.log").otherwise(F.concat(F.lit("db-shard-0"), (u % 2).cast("string"), F.lit("-0"), (u % 3).cast("string"), F.lit(".log"))) if sharded else F.lit("events.log")
    return _lines(events, file, e, value)


def write_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WRITE and INDEX lines from parts, expiries and a collection whose name looks like one among them."""
    p = F.col("p_partkey")
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    write = F.struct(F.element_at(F.array(*map(F.lit, ("update", "remove", "insert", "other"))), (p % 4 + 1).cast("int")).alias("type"), F.concat(F.lit("shop."), F.when(p % 9 == 0, "deletedTTL").otherwise(brand)).alias("ns"), F.when(p % 5 != 0, F.concat(F.lit("app"), (p % 3).cast("string"))).alias("appName"), F.col("p_size").alias("durationMillis"))
    index = F.struct(F.concat(F.lit("shop."), brand).alias("namespace"), F.col("p_size").alias("durationMillis"), F.when(p % 4 == 1, p % 100).alias("numDeleted"))
    steps = F.element_at(F.array(*map(F.lit, ("Index build: done", "Index drop", "Other step"))), (p % 3 + 1).cast("int"))
    message = F.when((p % 7 == 0) & (p % 4 == 1), "TTL: Deleted expired documents").when(p % 7 == 0, steps).otherwise("Slow query")
    ctx = F.concat(F.lit("conn"), (p % 50).cast("string"))
    value = F.when(p % 7 == 0, _json(c=F.lit("INDEX"), ctx=ctx, msg=message, attr=index)).otherwise(_json(c=F.lit("WRITE"), ctx=ctx, msg=message, attr=write))
    return _lines(_table(spark, sf_dir, "part"), F.lit("writes.log"), p, value)


def ttl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    attr = F.struct(F.concat(F.lit("ttl."), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("namespace"), F.col("p_size").alias("numDeleted"), F.when(p % 13 != 0, F.floor("p_retailprice").cast("long")).alias("durationMillis"))
    value = _json(c=F.lit("INDEX"), ctx=F.lit("TTLMonitor"), msg=F.lit("Deleted expired documents"), attr=attr)
    return _lines(_table(spark, sf_dir, "part"), F.concat(F.lit("ttl-shard-0"), (p % 2).cast("string"), F.lit("-01.log")), p, value)


def transaction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    price = F.floor("o_totalprice").cast("long")
    attr = F.struct(
        F.struct(F.when(o % 9 != 0, o % 3).alias("txnRetryCounter")).alias("parameters"), F.when(o % 11 != 0, F.col("o_orderstatus")).alias("terminationCause"), F.col("o_orderpriority").alias("commitType"),
        F.when(o % 7 != 0, price % 1000).alias("durationMillis"), F.when(o % 2 == 0, price % 7919).alias("commitDurationMicros"), (price % 100_003).alias("timeActiveMicros"), F.when(o % 3 == 0, price % 50_021).alias("timeInactiveMicros"),
    )
    value = _json(c=F.lit("TXN"), ctx=F.lit("conn1"), msg=F.lit("transaction"), attr=attr)
    return _lines(_table(spark, sf_dir, "orders"), F.concat(F.lit("txn-shard-0"), (o % 2).cast("string"), F.lit("-00.log")), o, value)


def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignored lines of every category, lines that aren't JSON, and lines without attributes."""
    c = F.col("c_custkey")
    kinds = [
        '{"c":"NETWORK","msg":"x"}', '{"c":"STORAGE","msg":"x"}', '{"c":"REPL","hello":1}', '{"c":"REPL","replSetHeartbeat":"rs"}', '{"listDatabases":1,"$db":"admin"}', "plain text", '{"find": broken "find":', '{"msg":"nothing here"}',
        '{"c":"ACCESS","msg":"x"}', '{"c":"CONTROL","msg":"x"}', '{"isMaster":1}', '{"ping":1,"$db":"local"}', '{"ping":1,"$db":"config"}', '{"ping":1,"profile":2}', '{"ctx":"TTLMonitor","msg":"x"}', '{"ping":1}',
    ]
    value = F.element_at(F.array(*map(F.lit, kinds)), (c % 16 + 1).cast("int"))
    return _lines(_table(spark, sf_dir, "customer"), F.lit("noise.log"), c, value)


def command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of all kinds, one of them unknown."""
    c = F.col("c_custkey")
    commands = [
        '{"findAndModify":"orders"}', '{"getMore":123,"collection":"carts"},"originatingCommand":{"pipeline":[{"$changeStream":{}}]}', '{"getMore":123,"collection":"carts"},"originatingCommand":{"filter":{"a":1}}', '{"count":"orders","q":{"c":1}}', '{"distinct":"orders"}',
        '{"aggregate":1}', '{"drop":"old"}', '{"createIndexes":"x"}', '{"_shardsvrMovePrimary":"x"}', '{"foo":1}', '{"aggregate":"orders","pipeline":[{"$limit":1},{"$match":{"b":1}}]}',
    ]
    command = F.element_at(F.array(*map(F.lit, commands)), (c % 11 + 1).cast("int"))
    head = '{"c":"COMMAND","ctx":"conn1","msg":"Slow query","attr":{"ns":"shop.base","durationMillis":'
    value = F.concat(F.lit(head), (c % 100).cast("string"), F.lit(',"command":'), command, F.lit("}}"))
    return _lines(_table(spark, sf_dir, "customer"), F.lit("commands.log"), c, value)


def connection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer a connection: metadata, mostly an authentication (before or after) and an end."""
    c = F.col("c_custkey")
    t = lambda ms: F.struct(F.concat(F.date_format(F.timestamp_millis(F.lit(1_700_000_000_000) + ms).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("$date"))
    ctx = F.concat(F.lit("conn"), c.cast("string"))
    segment = F.col("c_mktsegment")
    driver = F.struct(F.when(c % 10 == 9, "NetworkInterfaceTL").otherwise(segment).alias("name"), F.concat(F.lit("4."), (c % 3).cast("string")).alias("version"))
    packed = F.when(c % 2 == 0, F.array(F.lit("zstd"), F.lit("snappy"))).when(c % 4 == 1, F.array(F.lit("snappy"), F.lit("zstd")))
    doc = F.struct(driver.alias("driver"), F.struct(F.lit("Linux").alias("type"), F.lit("Ubuntu").alias("name"), F.lit("x86_64").alias("architecture")).alias("os"), F.when(c % 7 == 0, F.struct(F.concat(F.lit("8.0."), (c % 2).cast("string")).alias("version"))).alias("mongos"))
    meta = _json(t=t(c * 10), c=F.lit("NETWORK"), ctx=ctx, msg=F.lit("client metadata"), attr=F.struct(F.concat(F.lit("10.1.0."), (c % 100).cast("string"), F.lit(":"), (c % 5000 + 1024).cast("string")).alias("remote"), packed.alias("negotiatedCompressors"), doc.alias("doc")))
    user = _json(t=t(c * 10), c=F.lit("ACCESS"), ctx=ctx, msg=F.lit("Successfully authenticated"), attr=F.struct(F.concat(F.lit("user"), (c % 4).cast("string")).alias("user"), F.lit("admin").alias("db")))
    end = _json(t=t(c * 10 + c % 977), c=F.lit("NETWORK"), ctx=ctx, msg=F.lit("Connection ended"), attr=F.struct(F.lit(1).alias("n")))
    rows = F.filter(F.array(F.struct((c * 10 + F.when(c % 2 == 0, 0).otherwise(2)).alias("n"), F.when(c % 3 != 0, user).alias("v")), F.struct((c * 10 + 1).alias("n"), meta.alias("v")), F.struct((c * 10 + 3).alias("n"), F.when(c % 4 != 0, end).alias("v"))), lambda r: r["v"].isNotNull())
    exploded = _table(spark, sf_dir, "customer").select("c_custkey", F.explode(rows).alias("r"))
    return _lines(exploded, F.concat(F.lit("node"), (c % 2).cast("string"), F.lit(".log")), F.col("r.n"), F.col("r.v"))


def _copied(n: Column) -> Column:
    """A slow find of one of five connections."""
    attr = F.struct(F.lit("db.c").alias("ns"), F.struct(F.lit("c").alias("find")).alias("command"), F.concat(F.lit("svc"), (n % 2).cast("string")).alias("appName"), n.alias("durationMillis"))
    return _json(c=F.lit("COMMAND"), ctx=F.concat(F.lit("conn"), (n % 5).cast("string")), msg=F.lit("Slow query"), attr=attr)


def copied_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of one name in two folders."""
    n = F.col("n_nationkey")
    rows = _table(spark, sf_dir, "nation").select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("folder"))
    return _lines(rows, F.concat("folder", F.lit("/db-shard-07-"), F.lit("01.log")), n, _copied(n))


RENDERERS = {
    "events": event_lines, "sharded": lambda spark, sf_dir: event_lines(spark, sf_dir, sharded=True), "writes": write_lines, "ttl": ttl_lines,
    "transactions": transaction_lines, "noise": noise_lines, "commands": command_lines, "connections": connection_lines, "copies": copied_lines,
}
