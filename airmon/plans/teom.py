"""TEOM hours of both eras with the wind recorded beside them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from airmon.functions.values import site_code
from airmon.operators import quality as qc, reconcile as rec
from airmon.operators.calendar import with_hour_ending_date
from airmon.sources import tables


def teom_hours(
    old: DataFrame, new: DataFrame, analog: DataFrame, deployments: DataFrame, start, end, change, names: Mapping[str, str],
) -> DataFrame:
    """(datetime, abrv, date, ws, wd, pm10): one row per site-hour of the sites in ``names`` (code -> deployment).

    Where an hour is in both tables the old one has it; of repeated rows of a table the lowest value.  Wind is that of
    the analog record at the same hour, unknown where it has none.
    """
    sites = list(names.values())
    rows = tables.read_teom_by_era(old, new, start, end, change, sites)
    keys = ["deployment", "datetime"]
    pm = qc.first_by(rows.withColumn("_value", F.col("pm10")), keys, ["era", "_value"]).drop("era", "_value")
    met = tables.read_analog_hourly(analog, deployments, start, end, sites)
    wind = met.groupBy(*keys).agg(F.min(F.struct("ws", "wd")).alias("_w")).select(*keys, "_w.*")
    hours = rec.attach_met(pm, wind, keys).withColumn("abrv", site_code("deployment", names))
    return with_hour_ending_date(hours).select("datetime", "abrv", "date", "ws", "wd", "pm10")


#: The fields whose flags make a wind speed and a wind direction invalid.
WIND_FLAGS = {"invalid_ws": 116, "invalid_wd": 117}


def flagged_wind_hours(
    validated: DataFrame, analog: DataFrame, deployments: DataFrame, flags: DataFrame, start, end, sites: Sequence[str], bucket_hours: int = 24,
) -> DataFrame:
    """Validated dust hours (deployment, datetime, pm10) with the wind beside them and whether its speed or direction is flagged.

    (deployment, datetime, date, pm10, ws, wd, invalid_ws, invalid_wd) of the sites and hour-ending days asked for; hours
    without a wind record are left out.
    """
    dust = qc.filter_period(validated.filter(F.col("deployment").isin(list(sites))), start, end).select("deployment", "datetime", "pm10")
    known = deployments.filter(F.col("deployment").isin(list(sites))).select("deployment_id", "deployment")
    wind = analog.join(known, "deployment_id").select("deployment_id", "deployment", "datetime", F.col("ws_wvc").alias("ws"), F.col("wd_wvc").alias("wd"))
    both = rec.join_pm_met_inner(dust, qc.filter_period(wind, start, end))
    flagged = qc.flag_lookup(both, flags, WIND_FLAGS, bucket_hours=bucket_hours)
    return with_hour_ending_date(flagged).select("deployment", "datetime", "date", "pm10", "ws", "wd", *WIND_FLAGS)


def usable_wind_hours(hours: DataFrame) -> DataFrame:
    """Whole rows of flagged hours whose wind is not flagged."""
    return qc.complete_cases(hours.filter(~F.col("invalid_ws") & ~F.col("invalid_wd")).drop(*WIND_FLAGS))
