"""Agency splice: agency hours first, preliminary after they end, TEOM besides; station summaries."""

from __future__ import annotations

import datetime as dtm
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from airmon.dims import AGENCY_SITES, DUST_BREAKS_LOW, STANDARD
from airmon.functions import timecol as tc
from airmon.functions.values import flag_color, knots_to_mps, site_code
from airmon.operators import aggregate as agg, direction, quality as qc, reconcile as rec, reshape
from airmon.sources.files import agency_long, read_aqs_json

WIND_PM = ("datetime", "abrv", "date", "ws", "wd", "pm10")


def agency_hours(stacked: DataFrame, start, end) -> DataFrame:
    """Stacked rows to hours with wind in m/s, one row per site-hour.

    The fall-back hour exists twice in UTC; the whole row of the lower UTC stamp wins.  Of several
    instruments at a site the lowest POC gives the value, where the table has that column; then the
    lower value.  UTC dates, stored sites and the year of a table partitioned by it limit what is scanned.
    """
    low, high = tc.as_date(start) - dtm.timedelta(days=1), tc.as_date(end) + dtm.timedelta(days=2)
    rows = stacked.filter(F.col("date_utc").between(F.lit(low), F.lit(high)) & F.col("site_num").isin(list(AGENCY_SITES.values())))
    if "year" in stacked.columns:
        rows = rows.filter(F.col("year").between(low.year, high.year))
    rows = rows.withColumn("_pick", F.struct(F.col("poc") if "poc" in stacked.columns else F.lit(0), "value"))
    local = qc.filter_period(agency_long(rows), start, end)
    instants = reshape.pivot_parameters(local, ["abrv", "datetime", "date", "datetime_utc"], "_pick")
    hours = qc.first_by(reshape.resultant_over_scalar(instants), ["abrv", "datetime"], ["datetime_utc"])
    return hours.withColumn("ws", knots_to_mps("ws")).select(*WIND_PM)


def spliced_hours(agency: DataFrame, preliminary: DataFrame, teom: DataFrame, sectors: DataFrame) -> DataFrame:
    """One row per site-hour with its direction class.

    ``agency`` is read for its rows and for its last day of each year: pass a snapshot of it.  Each
    source has one row per site-hour; where several have the hour, TEOM comes first, then the
    agency, then preliminary.  The winner is chosen before its value is judged.
    """
    def ranked(df: DataFrame, rank: int) -> DataFrame:
        return df.select(*WIND_PM, F.lit(rank).alias("_rank"))

    rows = rec.priority_splice(ranked(agency, 1), ranked(preliminary, 2), ranked(teom, 0))
    first = qc.dedup_site_hour(rows, ["_rank"]).drop("_rank")
    return direction.classify_onlake(qc.qc_bounds(qc.drop_nonexistent_local(first)), sectors)


def station_report(hours: DataFrame) -> dict[str, DataFrame]:
    daily = agg.daily_contribution(hours)
    return {
        "daily": daily.withColumn("flag_color", flag_color("pm10_24")),
        "yearly": agg.yearly_station_summary(daily, ["abrv"]),
        "roses": direction.rose_table(
            hours.withColumn("year", F.year("date")), breaks=DUST_BREAKS_LOW, by=("abrv", "year")),
    }


def agency_days(stacked_daily: DataFrame, start, end) -> DataFrame:
    """The agency's own daily values (date, abrv, pm10, ws_s, wd_s, ws_r, wd_r), always with all columns.

    Of several values of a parameter for a site-day the lowest counts.  Unknown sites go.
    """
    rows = stacked_daily.filter(
        F.col("date").between(F.lit(tc.as_date(start)), F.lit(tc.as_date(end))) & F.col("site_num").isin(list(AGENCY_SITES.values())))
    named = rows.withColumns({"abrv": site_code("site_num", AGENCY_SITES), "_pick": F.col("value")})
    return reshape.pivot_parameters(named, ["date", "abrv"], "_pick")


def daily_chain(hours: DataFrame, stacked_daily: DataFrame, start, end, sites: tuple[str, ...]) -> DataFrame:
    """(date, abrv, pm10_24, year, flag_color): computed daily means, for ``sites`` continued by the agency's daily values."""
    daily = agg.avg_pm10(hours).select("date", "abrv", F.col("avg_pm10").alias("pm10_24"))
    days = agency_days(stacked_daily, start, end).filter(F.col("pm10").isNotNull()).select("date", "abrv", F.col("pm10").alias("pm10_24"))
    tail = rec.after_last_of(days.filter(F.col("abrv").isin(list(sites))), daily, site="abrv")
    return daily.unionByName(tail.select(*daily.columns)).withColumns({"year": F.year("date"), "flag_color": flag_color("pm10_24")})


def daily_with_tail(daily: DataFrame, agency_daily: DataFrame, sites: tuple[str, ...]) -> DataFrame:
    """Computed daily means, continued for ``sites`` by the agency's after their own last day."""
    mine = daily.filter(F.col("abrv").isin(list(sites)))
    tail = rec.after_last_of(agency_daily.filter(F.col("abrv").isin(list(sites))), mine, site="abrv")
    return daily.unionByName(tail.select(*daily.columns))


def exceed_days(daily: DataFrame, groups: DataFrame, value: str = "pm10_24", threshold: float = STANDARD) -> DataFrame:
    """(site_group, date): days on which any site of a group reaches the threshold; ``groups`` is (site_group, abrv)."""
    return daily.filter(F.col(value) >= threshold).join(groups, "abrv").select("site_group", "date").distinct()


def response_coverage(spark: SparkSession, path: str | list[str], sites: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """First and last local hour of every site and parameter in landed API responses."""
    return agg.coverage_by_parameter(read_aqs_json(spark, path, sites, multi_line), ("site_num", "parameter_code"))
