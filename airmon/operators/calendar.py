"""Hour-ending calendar for whole tables of readings.

The column expressions in ``functions.timecol`` add intervals to stamps, which Spark does through
calendar objects.  Spark's tumbling windows do the same on plain numbers at scan speed, but as a
plan node rather than an expression, so they are offered here as operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airmon.functions.timecol import col

_NEVER = "1970-01-01 00:00:00"


def _tumbling(dt: Column | str, width: str, offset: str) -> Column:
    # a window drops rows without a time; the stand-in keeps them
    return F.window(F.coalesce(col(dt), F.lit(_NEVER).cast("timestamp_ntz")), width, width, offset)


def with_hour(df: DataFrame, dt: str, name: str, end: bool = False) -> DataFrame:
    """Start of the clock hour of ``dt``, or its ``end``."""
    edge = _tumbling(dt, "1 hour", "0 seconds")["end" if end else "start"]
    return df.withColumn("_hour", edge).withColumn(name, F.when(F.col(dt).isNotNull(), F.col("_hour"))).drop("_hour")


def with_hour_ending_date(df: DataFrame, dt: str = "datetime", name: str = "date") -> DataFrame:
    """Same as ``timecol.hour_ending_date``: days begin one second after midnight."""
    start = _tumbling(dt, "1 day", "1 second")["start"]
    return df.withColumn("_day", start).withColumn(
        name, F.when(F.col(dt).isNotNull(), F.col("_day").cast("date"))).drop("_day")


def with_bucket(df: DataFrame, dt: str, hours: int = 24, name: str = "_bucket") -> DataFrame:
    """Id of the bucket (b, b + hours] of a stamp; ``hours`` must divide 24."""
    if hours < 1 or 24 % hours:
        raise ValueError("bucket hours must divide 24")
    return df.withColumn(name, _tumbling(dt, f"{hours} hours", "1 microsecond")["start"])
