"""Wind networks: several stations' hours as one record, its gaps, and roses by season and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from airmon.dims import WIND_BREAKS
from airmon.functions import timecol as tc
from airmon.operators import aggregate as agg, direction, quality as qc, reconcile as rec

WIND = ("deployment", "datetime", "ws", "wd")


def network_hours(parts: Sequence[DataFrame], years: DataFrame, strict: bool = False) -> DataFrame:
    """Hours of all networks that have wind and lie within the years kept of their station, with season and year.

    ``parts`` have deployment, datetime, ws and wd; ``years`` is (deployment, cutoff).  A station
    without an entry keeps its whole record, or goes when ``strict``.
    """
    rows = rec.union_networks(*(qc.nan_to_null(p.select(*WIND)) for p in parts))
    kept = qc.valid_wind(qc.trim_record(rows, years, strict=strict))
    return kept.withColumn("season", tc.season("datetime")).withColumn("year", tc.year_of("datetime"))


def record_gaps(hours: DataFrame) -> DataFrame:
    """First and last hour, number of hours and missing hours of each station."""
    return agg.missing_hours(hours, "deployment")


def network_roses(hours: DataFrame, by: str = "season", season: str = "year") -> DataFrame:
    """Roses of wind speed per station, by ``season`` or by ``year``; ``season`` limits the hours to one."""
    return direction.rose_table(qc.season_filter(hours, season), value="ws", breaks=WIND_BREAKS, by=("deployment", by))
