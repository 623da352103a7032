"""Projections as keyed aggregates of the log, and the reads over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inserted_if_absent(projection: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key isn't there are added, one for each key."""
    new = rows.dropDuplicates([key]).join(projection.select(key), key, "left_anti")
    return projection.unionByName(new, allowMissingColumns=True)


def incremented(keys: DataFrame, hits: DataFrame, key: str, into: str) -> DataFrame:
    """Each key with the number of its hits; hits of other keys do nothing. Hits are counted before the join."""
    n = hits.groupBy(key).agg(F.count("*").alias("__n"))
    return keys.select(key).distinct().join(n, key, "left").select(key, F.coalesce("__n", F.lit(0).cast("long")).alias(into))


def last_write(rows: DataFrame, key: str, value: str, order: str = "event_id") -> DataFrame:
    """The value written last for each key."""
    return rows.groupBy(key).agg(F.max(F.struct(order, value)).alias("w")).select(key, f"w.{value}")


def point(projection: DataFrame, key: str, wanted, value: str, default: int = 0) -> DataFrame:
    """One row: the key's value, or the default."""
    return projection.where(F.col(key) == wanted).agg(F.coalesce(F.max(value), F.lit(default).cast("long")).alias(value))


def ordered(projection: DataFrame, key: str) -> DataFrame:
    return projection.select(key).orderBy(key)
