"""Interval tables cut into time buckets, so that range joins become equality joins.

Intervals are half-open on the left, (start, end], like hour-ending stamps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from airmon.operators.calendar import with_bucket

INSTANT = "INTERVAL '0.000001' SECOND"


def within(t: Column, start: Column, end: Column) -> Column:
    """Inside (start, end]; an interval without an end is still open."""
    return (t > start) & (end.isNull() | (t <= end))


def bucket_intervals(
    df: DataFrame, start: str, end: str, hours: int = 24, bucket: str = "_bucket", clip: bool = False,
    extent: tuple[Column, Column] | None = None,
) -> DataFrame:
    """One row per bucket an interval touches, optionally cut at the bucket's edges.

    Bucket ids are those of ``with_bucket``: the first instant after the bucket's left edge.  ``extent`` is
    the first and last stamp that will be looked up: buckets outside are not made, and an interval with
    a NULL end, which is still open, lasts until the last stamp.
    """
    step, instant = F.expr(f"INTERVAL '{hours}' HOUR"), F.expr(INSTANT)
    real, until = df, F.col(end)
    since = F.col(start) + instant
    if extent is not None:
        first, last = extent
        since, until = F.greatest(since, first), F.coalesce(F.least(F.col(end), last), last)
        # an open end is cut when asked to clip, else it stays NULL in the result
        real = real.filter(F.col(end).isNull() | (F.col(start) < F.col(end)))
    else:
        real = real.filter(F.col(start) < F.col(end))
    real = real.withColumn("_from", since).withColumn("_to", until).filter(F.col("_from") <= F.col("_to"))
    ends = with_bucket(with_bucket(real, "_from", hours, "_first"), "_to", hours, "_last")
    out = ends.withColumn(bucket, F.explode(F.sequence("_first", "_last", step))).drop("_from", "_first", "_last")
    if clip:
        edge = F.col(bucket) - instant
        out = out.withColumn(start, F.greatest(F.col(start), edge)).withColumn(
            end, F.least(F.coalesce(F.col(end), F.col("_to")), edge + step))
    return out.drop("_to")


def extent_of(df: DataFrame, dt: str) -> tuple[Column, Column]:
    """First and last stamp of a table, as literals; NULL without any."""
    lo, hi = df.agg(F.min(dt), F.max(dt)).first()
    return tuple(F.lit(x).cast("timestamp_ntz") for x in (lo, hi))


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Disjoint intervals covering the same time, per key.

    The two aggregates come first because they combine in the map tasks: all intervals reaching a
    bucket's left edge become one, and so do all reaching its right edge.  What the window then sorts
    is only the short intervals lying strictly inside one bucket.
    """
    keys = list(keys)
    one_per_start = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    one_per_end = one_per_start.groupBy(*keys, end).agg(F.min(start).alias(start))
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(before)
    opens = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    return (
        one_per_end.withColumn("_opens", opens)
        .withColumn("_island", F.sum("_opens").over(so_far))
        .groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )
