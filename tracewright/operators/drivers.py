"""Client drivers: metadata lines joined to authentications and to the ends of connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import get, has

D = "doc"
# Drivers of the server itself.
INTERNAL_PREFIX, INTERNAL_NAME = "NetworkInterface", "MongoDB Internal Client"
KEYS = ["driverName", "driverVersion", "osType", "platform", "compressors", "username"]


def authentications(docs: DataFrame) -> DataFrame:
    """The last user of each connection of each file, and one line that says so."""
    rows = docs.filter("component = 'ACCESS' AND msg = 'Successfully authenticated' AND conn_id IS NOT NULL").withColumn("user", get(D, "string", "attr", "user")).filter("user IS NOT NULL")
    return rows.groupBy("file", "conn_id").agg(F.max_by("user", "line_no").alias("username"), F.max_by("value", "line_no").alias("auth_line"))


def metadata(docs: DataFrame) -> DataFrame:
    """Client metadata lines of outside drivers; missing names are empty."""
    text = lambda *keys: F.coalesce(get(D, "string", "attr", *keys), F.lit(""))
    compressors = F.array_join(F.sort_array(F.array_distinct(F.coalesce(F.try_variant_get(D, '$["attr"]["negotiatedCompressors"]', "array<string>"), F.array().cast("array<string>")))), ",")
    rows = docs.filter("component = 'NETWORK' AND msg = 'client metadata' AND conn_id IS NOT NULL").filter(has(D, "attr", "doc", "driver"))
    rows = rows.select("file", "line_no", "conn_id", "t_ms", "value", text("doc", "driver", "name").alias("driverName"), text("doc", "driver", "version").alias("driverVersion"), text("doc", "os", "type").alias("osType"), text("doc", "os", "name").alias("osName"), text("doc", "os", "architecture").alias("platform"), get(D, "string", "attr", "doc", "mongos", "version").alias("serverVersion"), compressors.alias("compressors"), get(D, "string", "attr", "remote").alias("remote"))
    return rows.filter(~F.col("driverName").startswith(INTERNAL_PREFIX) & (F.col("driverName") != INTERNAL_NAME))


def connection_ends(docs: DataFrame) -> DataFrame:
    return docs.filter("component = 'NETWORK' AND msg = 'Connection ended' AND conn_id IS NOT NULL").select("file", "conn_id", "line_no", "t_ms")


def lifetimes(meta: DataFrame, ends: DataFrame, sample: float | None = None) -> DataFrame:
    """Of each metadata line the time to the first end of its connection after it, if above 0.

    Both kinds of lines of a connection are put in order and each takes the next end: no pair is made.
    ``sample`` keeps that share of connections by a hash.
    """
    from pyspark.sql import Window

    starts = meta.select("file", "conn_id", "line_no", "t_ms", F.lit(False).alias("end"))
    both = starts.unionByName(ends.withColumn("end", F.lit(True)))
    after = Window.partitionBy("file", "conn_id").orderBy("line_no", "end").rowsBetween(1, Window.unboundedFollowing)
    out = both.withColumn("ended", F.first(F.when(F.col("end"), F.col("t_ms")), ignorenulls=True).over(after)).filter("NOT end").withColumn("lifetimeMs", F.col("ended") - F.col("t_ms")).filter("lifetimeMs > 0")
    if sample is not None:
        out = out.filter(F.pmod(F.xxhash64("file", "conn_id"), F.lit(10_000)) < int(sample * 10_000))
    return out.select("file", "conn_id", "line_no", "lifetimeMs")


def driver_stats(docs: DataFrame) -> DataFrame:
    """Connections, hosts and lifetimes by driver; J1, J2 and J4."""
    from ..functions.text import host_of

    meta, users = metadata(docs), authentications(docs)
    rows = meta.join(users, ["file", "conn_id"], "left").join(lifetimes(meta, connection_ends(docs)), ["file", "conn_id", "line_no"], "left")
    at = F.struct("file", "line_no")
    known = F.when(F.col("auth_line").isNotNull(), at)
    out = rows.groupBy(*KEYS).agg(
        F.count("*").alias("connectionCount"), F.countDistinct(host_of(F.col("remote"))).alias("uniqueHosts"),
        F.coalesce(F.call_function("div", F.sum("lifetimeMs"), F.nullif(F.count("lifetimeMs"), F.lit(0))), F.lit(0).cast("long")).alias("avgLifetimeMs"), F.coalesce(F.max("lifetimeMs"), F.lit(0).cast("long")).alias("maxLifetimeMs"),
        F.min_by("osName", at).alias("osName"), F.min_by("serverVersion", at).alias("serverVersion"), F.min_by("value", at).alias("sampleMetadata"), F.min_by("auth_line", known).alias("sampleAuth"),
    )
    return out.orderBy(F.desc("connectionCount"), *(F.asc_nulls_first(k) for k in KEYS))
