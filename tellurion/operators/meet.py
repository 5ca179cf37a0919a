"""The evidence meet: what a derived record may claim of the records it replaces.

A record has ``provenance`` and ``lineage`` (arrays of strings) and, a channel, a column of the type ``CHANNEL``.
``applicable`` null means: applicable if there is a value or the channel is unavailable. A ``scope`` of null is
unrestricted. The meet of records is a record of the same form, so that meets may follow one another in any
grouping; it consists of built-in aggregates, which Spark computes partially before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNEL = "struct<applicable:boolean,value:double,unavailable:boolean,scope:array<string>>"
#: Fixed order of provenance.
PROVENANCE = ("measured", "interpolated")


def channel(value: Column, applicable: Column | None = None, scope: Column | None = None, unavailable: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        (none if applicable is None else applicable).cast("boolean").alias("applicable"),
        value.cast("double").alias("value"),
        (F.lit(False) if unavailable is None else unavailable).cast("boolean").alias("unavailable"),
        (none if scope is None else scope).cast("array<string>").alias("scope"),
    )


def _applicable(c: str) -> Column:
    return F.coalesce(f"{c}.applicable", F.coalesce(f"{c}.unavailable", F.lit(False)) | F.col(f"{c}.value").isNotNull())


def in_order(found: Column) -> Column:
    """Distinct provenance in the fixed order."""
    return F.filter(F.array(*map(F.lit, PROVENANCE)), lambda p: F.array_contains(found, p))


def union_of(arrays: Column) -> Column:
    return F.array_distinct(F.flatten(F.collect_set(F.coalesce(arrays, F.array().cast("array<string>")))))


def met(c: str) -> Column:
    """One channel's aggregate: the least value of the sources it applies to.

    It is unavailable where it applies to a source without a value, where a source has it as unavailable, or
    where no scope is common to all sources that state one; never the least of the others.
    """
    applies, value = _applicable(c), F.col(f"{c}.value")
    some = F.coalesce(F.bool_or(applies), F.lit(False))
    scopes = F.collect_set(F.when(applies, F.array_sort(F.array_distinct(f"{c}.scope"))))
    common = F.when(F.size(scopes) > 0, F.reduce(F.slice(scopes, 2, F.greatest(F.size(scopes), F.lit(1))), F.get(scopes, F.lit(0)), F.array_intersect))
    lost = F.bool_or((applies & value.isNull()) | F.coalesce(f"{c}.unavailable", F.lit(False))) | F.coalesce(F.size(common) == 0, F.lit(False))
    lost = some & F.coalesce(lost, F.lit(False))
    least = F.min(F.when(applies, value))
    return F.struct(some.alias("applicable"), F.when(~lost, least).alias("value"), lost.alias("unavailable"), F.when(~lost, common).alias("scope"))


def meet(records: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """One record a key: union of provenance and lineage, and every channel's meet."""
    return records.groupBy(*keys).agg(in_order(union_of(F.col("provenance"))).alias("provenance"), *(met(c).alias(c) for c in channels), F.array_sort(union_of(F.col("lineage"))).alias("lineage"))


def corner_meet(corners: DataFrame, keys: list[str], channels: list[str], corner_count: int = 4) -> DataFrame:
    """The meet of a block's corners; no record where one is missing or without any provenance."""
    whole = corners.groupBy(*keys).agg(F.count_if(F.size("provenance") > 0).alias("__corners")).where(F.col("__corners") == corner_count).drop("__corners")
    return meet(corners.join(whole, keys, "left_semi"), keys, channels)


def validated(records: DataFrame, channels: list[str]) -> DataFrame:
    """The records; a value outside 0 to 1 or not finite is an error when they are read."""
    for c in channels:
        value = F.col(f"{c}.value")
        bad = value.isNotNull() & (F.isnan(value) | ~value.between(0, 1))
        records = records.withColumn(c, F.when(bad, F.raise_error(F.concat(F.lit(f"support of channel {c} out of range: "), value.cast("string")))).otherwise(F.col(c)))
    return records


def state(c: str) -> Column:
    return F.when(~F.coalesce(_applicable(c), F.lit(False)), "not_applicable").when(F.col(f"{c}.unavailable"), "unavailable").otherwise("value")
