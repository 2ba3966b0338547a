"""Sand flux: 5-minute counts to hourly flux per collector, with wind, as a rose."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airmon.dims import FLUX_BREAKS
from airmon.functions import timecol as tc
from airmon.functions.values import sand_flux_rate
from airmon.operators import aggregate as agg, direction, quality as qc, reconcile as rec

# fixed value: flag field of the sensor's count
COUNT_FIELD = 90


def sand_flux(counts: DataFrame, periods: DataFrame, deployments: DataFrame, flags: DataFrame | None = None, flag_bucket_hours: int = 24) -> DataFrame:
    """(datetime, csc, sand_flux, invalid) per 5-minute count."""
    rows = rec.collector_name_join(rec.flux_interval_join(counts, periods), deployments)
    rate = sand_flux_rate("sumpc", "sumpc_total", "dwp_mass", "district_mass")
    rows = rows.withColumn("sand_flux", rate)
    if flags is None:
        return rows.select("datetime", "csc", "sand_flux")
    flagged = qc.flag_lookup(
        rows, flags, {"invalid": COUNT_FIELD}, id_col="sensit_deployment_id", bucket_hours=flag_bucket_hours)
    return flagged.select("datetime", "csc", "sand_flux", "invalid")


def hourly_flux_with_wind(flux: DataFrame, met: DataFrame) -> DataFrame:
    """Hourly sums per collector with the wind of one met station, joined on (date, hour).

    A met hour that occurs twice counts once, with its smallest values; clock times that do not exist go.
    """
    hourly = agg.hourly_flux_sum(flux, by=["csc"])
    hours = qc.drop_nonexistent_local(met.groupBy("datetime").agg(F.min(F.struct("ws", "wd")).alias("_w")))
    wind = hours.select("datetime", "_w.*").select(
        tc.hour_ending_date("datetime").alias("date"), tc.hour_ending_hour("datetime").alias("hour"), "ws", "wd")
    return rec.join_on_date_hour(hourly, wind)


def flux_rose(hourly: DataFrame) -> DataFrame:
    return direction.rose_table(hourly, value="sand_flux", breaks=FLUX_BREAKS, by=("csc",))
