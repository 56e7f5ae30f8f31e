"""Unions of half-open intervals per key, without putting one key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_within(df: DataFrame, group: Sequence[str], start: str, end: str) -> DataFrame:
    """Merge overlapping or touching [start, end) within each group; a null end is open."""
    order = Window.partitionBy(*group).orderBy(F.col(start))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    far = df.withColumn("_open", F.col(end).isNull())
    marked = far.withColumn("_reach", F.max(end).over(before)).withColumn("_reached_open", F.max("_open").over(before))
    fresh = F.when(F.coalesce(F.col("_reached_open"), F.lit(False)), 0).when(F.col("_reach") >= F.col(start), 0).otherwise(1)
    runs = marked.withColumn("_run", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*group, "_run").agg(F.min(start).alias(start), F.when(F.max("_open"), F.lit(None)).otherwise(F.max(end)).alias(end)).drop("_run")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, bucket: Column) -> DataFrame:
    """Disjoint intervals per key.

    ``bucket`` splits a key by its starts (say, by day), so that a key with a third of all rows is
    first merged piecewise in many tasks; the second merge sees only what is left of each piece.
    Rows with a null start, or an end not after the start, hold no moment and are dropped;
    a null end stays open.  Repeated rows collapse.  Null keys are kept as a key of their own.
    """
    own = df.select(*keys, start, end).where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))).distinct()
    pieces = merge_within(own.withColumn("_bucket", bucket), [*keys, "_bucket"], start, end).drop("_bucket")
    return merge_within(pieces, list(keys), start, end)
