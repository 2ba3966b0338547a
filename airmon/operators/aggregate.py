"""Hourly, daily, yearly and per-site aggregates.

All are plain grouped aggregates, so map tasks send partial sums and a hot site costs no more than a
quiet one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from airmon.dims import BACKGROUND, DAY_HOURS
from airmon.functions.values import half_even, steady

SITE_DAY = ("date", "abrv")


def daily_avg(df: DataFrame, by: Sequence[str] = SITE_DAY) -> DataFrame:
    return df.groupBy(*by).agg(steady(F.avg("pm10")).alias("pm10_avg"))


def daily_avg_rounded(df: DataFrame, by: Sequence[str] = SITE_DAY) -> DataFrame:
    return df.groupBy(*by).agg(half_even(F.avg("pm10")).alias("pm10_avg"))


def best_source_daily_avg(hours: DataFrame, by: Sequence[str] = SITE_DAY) -> DataFrame:
    """``daily_avg`` of ``drop_mixed_preliminary`` in one aggregate.

    Keeps both sources' partial sums per site-day and uses the validated ones where there are any,
    so hours need not be moved next to their day first.
    """
    good = F.avg(F.when(F.col("valid"), F.col("pm10")))
    return hours.groupBy(*by).agg(
        steady(F.when(F.max("valid"), good).otherwise(F.avg("pm10"))).alias("pm10_avg"))


def avg_pm10(df: DataFrame, by: Sequence[str] = SITE_DAY) -> DataFrame:
    """Mean of what was measured, 0 when nothing was, and the number of measurements."""
    return df.groupBy(*by).agg(
        F.coalesce(half_even(F.avg("pm10")), F.lit(0.0)).alias("avg_pm10"),
        F.count("pm10").alias("n"),
    )


def onlake_hour_counts(df: DataFrame, by: Sequence[str] = SITE_DAY) -> DataFrame:
    """Off- and onlake hours.  Unknown directions are in neither; a day with no known one has no row."""
    return df.filter(F.col("onlake").isNotNull()).groupBy(*by).agg(
        F.count_if(~F.col("onlake")).alias("hrs_offlake"),
        F.count_if(F.col("onlake")).alias("hrs_onlake"),
    )


def onlake_contribution(df: DataFrame, by: Sequence[str] = SITE_DAY, strict: bool = False) -> DataFrame:
    """What on- and offlake hours each add to the daily average: sector sum over *all* hours.

    ``pm10_avg`` is the sum of the two rounded parts, so hours of unknown direction are not in it.
    A day without any known direction has NULL parts, or no row in ``strict`` mode.
    """
    n = F.count(F.lit(1))
    known = F.count("onlake")

    def part(hit: Column) -> Column:
        total = F.coalesce(F.sum(F.when(hit, F.col("pm10"))), F.lit(0.0))
        return F.when(known > 0, half_even(total / n))

    out = df.groupBy(*by).agg(
        part(F.col("onlake")).alias("onlake"),
        part(~F.col("onlake")).alias("offlake"),
    ).withColumn("pm10_avg", F.bround(F.col("onlake") + F.col("offlake"), 0))
    return out.filter(F.col("pm10_avg").isNotNull()) if strict else out


def daily_contribution(df: DataFrame, by: Sequence[str] = SITE_DAY) -> DataFrame:
    """Daily average and sector contributions over the measured hours of a station."""
    n = F.count("pm10")

    def share(total: Column) -> Column:
        return half_even(F.try_divide(F.coalesce(total, F.lit(0.0)), n))

    return df.groupBy(*by).agg(
        share(F.sum("pm10")).alias("pm10_24"),
        share(F.sum(F.when(F.col("onlake"), F.col("pm10")))).alias("pm10_onlake"),
        share(F.sum(F.when(~F.col("onlake"), F.col("pm10")))).alias("pm10_offlake"),
    )


def sector_conditional_means(df: DataFrame, by: Sequence[str] = SITE_DAY) -> DataFrame:
    """Mean and count of all, onlake, dunes and offlake hours, each over its own hours."""
    def pair(name: str, n_name: str, hit: Column | None) -> list[Column]:
        v = F.col("pm10") if hit is None else F.when(hit, F.col("pm10"))
        return [half_even(F.avg(v)).alias(name), F.count(v).alias(n_name)]

    return df.groupBy(*by).agg(
        *pair("pm10_24", "n", None),
        *pair("pm10_onlake", "n_onlake", F.col("onlake")),
        *pair("pm10_dunes", "n_dunes", F.col("dunes")),
        *pair("pm10_offlake", "n_offlake", ~F.col("onlake")),
    )


BACKFILLED = (
    ("pm10_24", "n"), ("pm10_onlake", "n_onlake"), ("pm10_dunes", "n_dunes"), ("pm10_offlake", "n_offlake"),
)


def backfill_24h(
    df: DataFrame,
    background: float = BACKGROUND,
    hours: int = DAY_HOURS,
    measures: Sequence[tuple[str, str]] = BACKFILLED,
) -> DataFrame:
    """Fill the hours a mean lacks to a full day with the background value."""
    return df.withColumns({
        m: half_even((F.col(m) * F.col(n) + background * (F.lit(hours) - F.col(n))) / hours) for m, n in measures
    })


def yearly_station_summary(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per year: mean and maximum of the daily values, sector maxima, and the share of 365 days."""
    return daily.groupBy(*by, F.year("date").alias("year")).agg(
        steady(F.avg("pm10_24")).alias("avg_pm10"),
        F.max("pm10_24").alias("max_pm10"),
        F.max("pm10_onlake").alias("max_onlake"),
        F.max("pm10_offlake").alias("max_offlake"),
        steady(F.count(F.lit(1)) / F.lit(365)).alias("percent_data"),
    )


def day_completeness(df: DataFrame, by: Sequence[str] = SITE_DAY) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by)


def coverage_by_parameter(df: DataFrame, by: Sequence[str] = ("site_num", "code"), dt: str = "datetime") -> DataFrame:
    return df.groupBy(*by).agg(F.min(dt).alias("start"), F.max(dt).alias("end"))


def site_extent(df: DataFrame, site: str = "abrv", dt: str = "datetime") -> DataFrame:
    return coverage_by_parameter(df, (site,), dt)


def missing_hours(df: DataFrame, site: str = "abrv", dt: str = "datetime") -> DataFrame:
    """Hours from first to last stamp minus rows, so a complete hourly record gives -1."""
    return df.groupBy(site).agg(
        F.min(dt).alias("start"), F.max(dt).alias("end"), F.count(F.lit(1)).alias("data_count"),
    ).withColumn("missing", F.timestamp_diff("HOUR", F.col("start"), F.col("end")) - F.col("data_count"))


#: Hours, and then buckets, that a bucket of the next level has at most (a power of two), and levels for years 1 to 9999.
_BUCKET_BITS, _LEVELS = 9, 3


def missing_ranges(df: DataFrame, site: str = "abrv", dt: str = "datetime") -> DataFrame:
    """One row per gap in an hourly record: first and last missing hour, and how many.

    Gaps are looked for inside buckets of 512 hours; a bucket hands on its first and last hour, which meet in buckets of
    512 buckets, and so on.  So a window has at most 512 rows, however long a site's record is.  Hours before the
    first and after the last reading are not missing; hours that occur twice count once, NULL times not at all.
    """
    origin = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    hour = F.timestamp_diff("HOUR", origin, F.col(dt))
    items = df.filter(F.col(dt).isNotNull()).select(site, hour.alias("first")).distinct().withColumn("last", F.col("first"))
    found = []
    for level in range(1, _LEVELS + 1):
        items = items.withColumn("bucket", F.shiftright("first", _BUCKET_BITS * level))
        before = F.lag("last").over(Window.partitionBy(site, "bucket").orderBy("first"))
        found.append(items.select(site, (before + 1).alias("start"), (F.col("first") - 1).alias("end")).filter("start <= end"))
        items = items.groupBy(site, "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("bucket")
    gaps = reduce(DataFrame.unionByName, found)
    at = {c: origin + F.make_dt_interval(F.lit(0), F.col(c).cast("int")) for c in ("start", "end")}
    return gaps.select(site, at["start"].alias("start"), at["end"].alias("end"), (F.col("end") - F.col("start") + 1).alias("hours"))


def hourly_flux_sum(df: DataFrame, by: Sequence[str] = (), dt: str = "datetime") -> DataFrame:
    """Sums per hour-ending date and hour.  Hours are grouped as windows, named after the aggregate."""
    hour = F.window(dt, "1 hour", "1 hour", "1 second").alias("_hour")
    sums = df.groupBy(*by, hour).agg(F.sum("sand_flux").alias("sand_flux"))
    start = F.col("_hour.start")
    return sums.select(*by, start.cast("date").alias("date"), F.hour(start).alias("hour"), "sand_flux")


def sites_exceeding_per_day(exceeding: DataFrame) -> DataFrame:
    return exceeding.groupBy("date").agg(F.count(F.lit(1)).alias("no_sites_exceeding"))


def site_days_valid_mix(df: DataFrame, by: Sequence[str] = SITE_DAY) -> DataFrame:
    """Site-days that have both validated and preliminary hours."""
    return (
        df.groupBy(*by)
        .agg(F.count_if(F.col("valid")).alias("n_valid"), F.count_if(~F.col("valid")).alias("n_notvalid"))
        .filter((F.col("n_valid") > 0) & (F.col("n_notvalid") > 0))
    )


def distinct_exceed_days(exceeding: DataFrame, sites: Sequence[str] | None = None) -> DataFrame:
    if sites is not None:
        exceeding = exceeding.filter(F.col("abrv").isin(list(sites)))
    return exceeding.select("date").distinct().orderBy("date")


def hours_in_site_day(df: DataFrame, by: Sequence[str] = SITE_DAY) -> DataFrame:
    """Size of its site-day on every row.  Expects one row per site-hour (25 rows per group at most)."""
    return df.withColumn("n_hours", F.count(F.lit(1)).over(Window.partitionBy(*by)))


def sort_site_time(df: DataFrame, by: Sequence[str] = ("abrv", "datetime"), within_files: bool = False) -> DataFrame:
    """Global order by range partitioning, or only inside each partition when writing files."""
    return df.sortWithinPartitions(*by) if within_files else df.orderBy(*by)
