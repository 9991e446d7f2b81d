"""Parsed lines: promoted columns beside the whole document as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rules import FilterRules
from . import prefilter


def path(*keys: str) -> str:
    """A JSON path whose keys may hold a dollar sign."""
    return "$" + "".join(f'["{k}"]' for k in keys)


def has(doc: Column, *keys: str) -> Column:
    """The key is there, be its value null or not."""
    return F.try_variant_get(doc, path(*keys), "variant").isNotNull()


def get(doc: Column, kind: str, *keys: str) -> Column:
    """A typed value; null where it is missing, null or of another type."""
    return F.try_variant_get(doc, path(*keys), kind)


def kind_of(doc: Column, *keys: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, path(*keys), "variant"))


def is_text(value: Column) -> Column:
    """Of a small VARIANT: it is a string."""
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_object(doc: Column, *keys: str) -> Column:
    return get(doc, "struct<_:variant>", *keys).isNotNull()


def once(column: Column) -> Column:
    """A column that is evaluated once a row.

    The optimizer would copy it into every filter above; it doesn't copy what it takes for not deterministic, and
    this is, though its value never changes.  Columns that nobody reads are pruned all the same.  (A plain comparison of
    a random number with a constant would be folded, hence the sum.)
    """
    return F.when(F.rand(0) + 1 > 0, column)


def staged(lines: DataFrame, rules: FilterRules | None = None) -> DataFrame:
    """Adds stage (oversize, ignored, or kept) and ttl, which is apart from it: an expiry line may be noise or not."""
    value = F.col("value")
    long = prefilter.oversize(value)
    stage = F.when(long, "oversize").when(prefilter.kept(value, rules or FilterRules()), "kept").otherwise("ignored")
    return lines.withColumn("stage", stage).withColumn("ttl", ~long & prefilter.ttl_line(value))


def parsed(lines: DataFrame) -> DataFrame:
    """Adds doc (null where a line isn't JSON) and the columns of the envelope."""
    d = F.col("doc")
    at = get(d, "string", "t", "$date")
    ctx = get(d, "string", "ctx")
    return lines.withColumn("doc", once(F.try_parse_json("value"))).withColumns(
        {
            "t_raw": at,
            "component": get(d, "string", "c"),
            "ctx": ctx,
            "msg": get(d, "string", "msg"),
        }
    ).withColumns(
        {
            "t_ms": F.unix_millis(F.try_to_timestamp("t_raw")),
            "conn_id": F.when(F.col("ctx").startswith("conn"), F.expr("try_cast(substring(ctx, 5) AS BIGINT)")),
        }
    )
