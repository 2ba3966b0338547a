"""Direction classes and rose tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from airmon.dims import DUST_BREAKS
from airmon.functions import values as val
from airmon.operators.quality import rose_rows


def classify_onlake(df: DataFrame, sectors: DataFrame, key: str = "abrv") -> DataFrame:
    """Add ``onlake``: is the wind inside the site's sector?  Sites without a sector get NULL."""
    return (
        df.join(sectors, key, "left")
        .withColumn("onlake", val.angle_between("wd", "from_deg", "to_deg"))
        .drop("from_deg", "to_deg")
    )


def classify_dunes(df: DataFrame) -> DataFrame:
    return df.withColumn("dunes", val.in_dunes("wd", "abrv"))


def rose_table(
    df: DataFrame,
    value: str = "pm10",
    breaks: Sequence[float] = DUST_BREAKS,
    by: Sequence[str] = ("date", "abrv"),
    sectors: int = 16,
) -> DataFrame:
    """Hours per compass sector and value class, and their share of the rose.

    The share's window runs over the aggregate: a rose has at most sectors x classes rows.
    """
    cells = (
        rose_rows(df, value)
        .groupBy(
            *by,
            val.compass_sector("wd", sectors).alias("sector"),
            val.value_class(value, breaks).alias("class"),
        )
        .agg(F.count(F.lit(1)).alias("hours"))
    )
    whole = F.sum("hours").over(Window.partitionBy(*by))
    return cells.withColumn("label", val.class_label("class", breaks)).withColumn(
        "share", val.steady(F.col("hours") / whole))
