"""Exceedance days, their attribution and the report tables.

Three thresholds are kept apart: the exceedance list tests the unrounded mean (>=), the site table
the rounded mean (>=), and the red label the rounded value (>).
"""

from __future__ import annotations

import datetime as dtm
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airmon.dims import DUNES_SITE, STANDARD
from airmon.functions.values import display_label, flag_color, half_even
from airmon.operators.aggregate import SITE_DAY, backfill_24h, daily_avg


def exceedances(hours: DataFrame, threshold: float = STANDARD, by: Sequence[str] = SITE_DAY) -> DataFrame:
    return daily_avg(hours, by).filter(F.col("pm10_avg") >= threshold)


def exceeding_days(daily: DataFrame, measure: str = "pm10_24", threshold: float = STANDARD) -> DataFrame:
    """Rows of a daily table at or over the threshold, other measures with NULLs as 0."""
    return daily.filter(F.col(measure) >= threshold).na.fill(0)


def zero_empty_sectors(df: DataFrame, sectors: Sequence[str] = ("offlake", "onlake", "dunes")) -> DataFrame:
    """The mean of a sector without hours is 0."""
    return df.withColumns({
        f"pm10_{s}": F.when(F.col(f"n_{s}") == 0, 0.0).otherwise(F.col(f"pm10_{s}")) for s in sectors
    })


def dunes_event(df: DataFrame, threshold: float = STANDARD, site: str = DUNES_SITE) -> DataFrame:
    """``dunes_flag`` is set at the dunes site when its dunes mean reaches the threshold.

    Takes means before backfill.  Elsewhere the dunes columns mean nothing and become NULL.
    """
    here = F.col("abrv") == site
    return df.withColumns({
        "dunes_flag": F.when(here & (F.col("pm10_dunes") >= threshold), True),
        "pm10_dunes": F.when(here, F.col("pm10_dunes")),
        "n_dunes": F.when(here, F.col("n_dunes")),
    })


def event_class(onlake: Column, offlake: Column, threshold: float = STANDARD) -> Column:
    on, off = onlake >= threshold, offlake >= threshold
    return F.when(off & ~on, "offlake").when(on & ~off, "onlake").otherwise("mixed")


def classify_event(df: DataFrame, threshold: float = STANDARD) -> DataFrame:
    """One sector over the threshold names the day; both or neither make it mixed."""
    return df.withColumn("class", event_class(F.col("pm10_onlake"), F.col("pm10_offlake"), threshold))


def attribute_exceedances(exceeding: DataFrame) -> DataFrame:
    """Zero, flag, backfill and classify, in that order."""
    return classify_event(backfill_24h(dunes_event(zero_empty_sectors(exceeding))))


def site_day_breakdown(df: DataFrame, by: Sequence[str] = SITE_DAY, strict: bool = False) -> DataFrame:
    """Everything the daily report needs about a site-day, in one aggregate.

    ``daily_avg`` is the rounded mean of all hours; ``pm10_avg`` the sum of the two rounded sector
    contributions, which the map shows.  Site-days without any known direction have none, or no row when ``strict``.
    """
    n = F.count(F.lit(1))
    known = F.count("onlake")

    def part(hit: Column) -> Column:
        total = F.coalesce(F.sum(F.when(hit, F.col("pm10"))), F.lit(0.0))
        return F.when(known > 0, half_even(total / n))

    out = df.groupBy(*by).agg(
        half_even(F.avg("pm10")).alias("daily_avg"),
        part(F.col("onlake")).alias("onlake"),
        part(~F.col("onlake")).alias("offlake"),
        F.count_if(F.col("onlake")).alias("hrs_onlake"),
        F.count_if(~F.col("onlake")).alias("hrs_offlake"),
        F.max(~F.col("valid")).alias("preliminary"),
    ).withColumn("pm10_avg", F.bround(F.col("onlake") + F.col("offlake"), 0))
    return out.filter(F.col("pm10_avg").isNotNull()) if strict else out


def exceed_site_table_dunes(attributed: DataFrame, sites: DataFrame) -> DataFrame:
    """Site, Onlake, Offlake and Keeler Dunes means of attributed exceedances; dunes only at the dunes site."""
    return attributed.join(sites.select("abrv", "deployment"), "abrv", "left").select(
        "date", display_label("deployment").alias("site"), F.col("pm10_onlake").alias("onlake"),
        F.col("pm10_offlake").alias("offlake"), F.when(F.col("abrv") == DUNES_SITE, F.col("pm10_dunes")).alias("dunes"))


def exceed_site_table(breakdown: DataFrame, sites: DataFrame, threshold: float = STANDARD) -> DataFrame:
    """Site, Onlake, Offlake of the exceeding sites of every day."""
    return (
        breakdown.filter(F.col("daily_avg") >= threshold)
        .join(sites.select("abrv", "deployment"), "abrv", "left")
        .select(
            "date",
            display_label("deployment").alias("site"),
            F.bround("onlake", 0).alias("onlake"),
            F.bround("offlake", 0).alias("offlake"),
        )
    )


def label_offset(abrv: str = "abrv") -> Column:
    """Label offset in metres, above one site and below the others."""
    return F.when(F.col(abrv) == "LT", 1000).otherwise(-1000)


def daily_map_labels(breakdown: DataFrame, sites: DataFrame) -> DataFrame:
    """Position, label value, color and preliminary flag per site-day."""
    return (
        breakdown.join(sites.select("abrv", "deployment", "x", "y"), "abrv", "left")
        .select(
            "date", "abrv", "deployment", "x", "y",
            label_offset().alias("y_offset"),
            "pm10_avg", flag_color("pm10_avg").alias("flag_color"), "preliminary",
        )
    )


def continuity_series(df: DataFrame, value: str = "pm10") -> DataFrame:
    """The readings of every site over time; whoever draws or writes them puts them in order."""
    return df.select("abrv", "datetime", F.col(value).alias("value"))


#: Hours in a bucket of the lowest level, and how many buckets of a level make one of the next.
_PYRAMID_HOURS, _PYRAMID_FAN = 8, 8
PYRAMID = "abrv string, level int, start timestamp_ntz, first double, last double, low double, high double, n long, from_time timestamp_ntz, to_time timestamp_ntz"


def continuity_pyramid(df: DataFrame, value: str = "pm10", levels: int = 6) -> DataFrame:
    """First, last, least and greatest reading of each site by time bucket, at ``levels`` widths of 8, 64, 512, ... hours.

    A level is made from the one below, so readings are summed up once, in the map tasks.  ``n`` readings lie between
    ``from_time`` and ``to_time``; hours without a reading or time are not in it, and buckets without any have no row.  Of
    readings at one time the least is the first and the greatest the last.
    """
    origin = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    hour = F.timestamp_diff("HOUR", origin, F.col("datetime"))
    read = df.filter(F.col("datetime").isNotNull() & F.col(value).isNotNull())
    at, v = F.col("datetime"), F.col(value)
    now = read.groupBy("abrv", F.floor(hour / _PYRAMID_HOURS).alias("bucket")).agg(
        F.min(F.struct(at, v)).alias("a"), F.max(F.struct(at, v)).alias("b"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"))
    now = now.select("abrv", "bucket", F.col(f"a.{value}").alias("first"), F.col(f"b.{value}").alias("last"), "low", "high", "n",
                     F.col("a.datetime").alias("from_time"), F.col("b.datetime").alias("to_time"))
    out, width = [], _PYRAMID_HOURS
    for level in range(levels):
        start = origin + F.make_dt_interval(F.lit(0), (F.col("bucket") * width).cast("int"))
        out.append(now.select("abrv", F.lit(level).alias("level"), start.alias("start"), *now.columns[2:]))
        now = now.groupBy("abrv", F.floor(F.col("bucket") / _PYRAMID_FAN).alias("bucket")).agg(
            F.min_by("first", "from_time").alias("first"), F.max_by("last", "to_time").alias("last"), F.min("low").alias("low"),
            F.max("high").alias("high"), F.sum("n").alias("n"), F.min("from_time").alias("from_time"), F.max("to_time").alias("to_time"))
        width *= _PYRAMID_FAN
    return reduce(DataFrame.unionByName, out)


def continuity_view(pyramid: DataFrame, start: dtm.datetime, end: dtm.datetime, points: int = 2000, levels: int = 6) -> DataFrame:
    """What to draw of a period: buckets of the finest level that has at most ``points`` of them per site in it."""
    hours = (end - start).total_seconds() / 3600
    fits = (k for k in range(levels) if hours / (_PYRAMID_HOURS * _PYRAMID_FAN**k) + 1 <= points)
    level = next(fits, levels - 1)
    return pyramid.filter((F.col("level") == level) & (F.col("to_time") >= F.lit(start)) & (F.col("from_time") <= F.lit(end)))
