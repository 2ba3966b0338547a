"""Observation and site tables, landed as Parquet or read over JDBC."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airmon.dims import LOCAL_ZONE, PRELIMINARY_NAMES, VALIDATED_NAMES
from airmon.functions import timecol as tc
from airmon.functions.values import site_code
from airmon.operators.calendar import with_hour, with_hour_ending_date
from airmon.operators.quality import dedup_site_hour, drop_nonexistent_local, nan_to_null, qc_bounds

OBS = ("abrv", "datetime", "date", "ws", "wd", "pm10", "onlake_wd", "valid")


def open_table(spark: SparkSession, location: str | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """Any Spark source; for ``jdbc`` give partitionColumn, bounds and numPartitions to read in parallel."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load(location) if location else reader.load()


def _hourly(
    table: DataFrame, start, end, names: Mapping[str, str], sites: Sequence[str] | None,
    columns: Mapping[str, Column], valid: bool, order: Sequence[str], zone: str,
) -> DataFrame:
    unknown = sorted(set(sites or ()) - set(names))
    if unknown:
        raise ValueError(f"unknown site codes {unknown}; known are {sorted(names)}")
    wanted = [names[s] for s in sites] if sites is not None else list(names.values())
    # period and site tests are on stored columns, so both reach the scan
    rows = table.filter(tc.in_period("datetime", start, end) & F.col("site").isin(wanted))
    obs = rows.select(
        site_code("site", names).alias("abrv"), "datetime",
        *[c.alias(n) for n, c in columns.items()], *order,
    )
    # a skipped clock time is wrong for its whole key, so the costly zone test waits for the few rows left
    hours = drop_nonexistent_local(dedup_site_hour(qc_bounds(nan_to_null(obs)), order), zone=zone)
    return with_hour_ending_date(hours).withColumn("valid", F.lit(valid)).select(*OBS)


def read_preliminary(
    table: DataFrame, start, end, sites: Sequence[str] | None = None, *, order: Sequence[str],
    names: Mapping[str, str] = PRELIMINARY_NAMES, zone: str = LOCAL_ZONE,
) -> DataFrame:
    """Preliminary hours (datetime, site, aspd, dir, teom, from_lake) as observations, ``valid`` false.

    ``order`` names the columns that choose among repeated rows of a site-hour.  Without ``sites`` all sites of
    ``names`` are read, the nine named ones by default; other sites of the table are not.
    """
    columns = {
        "ws": F.col("aspd"), "wd": F.col("dir"), "pm10": F.col("teom"), "onlake_wd": F.col("from_lake"),
    }
    return _hourly(table, start, end, names, sites, columns, False, order, zone)


def read_validated(
    table: DataFrame, start, end, sites: Sequence[str] | None = None, *, order: Sequence[str],
    names: Mapping[str, str] = VALIDATED_NAMES, zone: str = LOCAL_ZONE,
) -> DataFrame:
    """Validated hours (datetime, site, ws, wd, pm10, onlake_wd) as observations, ``valid`` true; as for ``read_preliminary``."""
    columns = {c: F.col(c) for c in ("ws", "wd", "pm10", "onlake_wd")}
    return _hourly(table, start, end, names, sites, columns, True, order, zone)


def _with_deployment(readings: DataFrame, deployments: DataFrame, sites: Iterable[str] | None) -> DataFrame:
    known = deployments.select("deployment_id", "deployment")
    if sites is not None:
        known = known.filter(F.col("deployment").isin(list(sites)))
    return readings.join(known, "deployment_id").drop("deployment_id")


def read_met_hourly(
    met: DataFrame, deployments: DataFrame, start=None, end=None, sites: Iterable[str] | None = None,
) -> DataFrame:
    """Met hours (ws_10m, wd_10m) with their deployment's name: a day, a range, or everything."""
    rows = met.filter(tc.in_period("datetime", start, end or start)) if start is not None else met
    cols = ("datetime", "deployment", F.col("ws_10m").alias("ws"), F.col("wd_10m").alias("wd"))
    return nan_to_null(_with_deployment(rows, deployments, sites).select(*cols))


def read_analog_hourly(
    analog: DataFrame, deployments: DataFrame, start=None, end=None, sites: Iterable[str] | None = None,
) -> DataFrame:
    """Wind recorded next to a TEOM (ws_wvc, wd_wvc) with its deployment's name."""
    rows = analog.filter(tc.in_hour_range("datetime", start, end or start)) if start is not None else analog
    cols = ("datetime", "deployment", F.col("ws_wvc").alias("ws"), F.col("wd_wvc").alias("wd"))
    return nan_to_null(_with_deployment(rows, deployments, sites).select(*cols))


def read_teom_by_era(
    old: DataFrame, new: DataFrame, start, end, change, sites: Iterable[str] | None = None,
) -> DataFrame:
    """TEOM hours from the old table, the new one, or both, by where the range lies to the change.

    Each table is read over the whole range; hours in both are left to ``dedup_site_hour``.  ``era``
    (0 old, 1 new) is there for its tie-break.
    """
    start, end, change = tc.as_date(start), tc.as_date(end), tc.as_date(change)

    def part(table: DataFrame, value: str, era: int) -> DataFrame:
        rows = table.filter(tc.in_hour_range("datetime", start, end) & ~F.col("invalid"))
        if sites is not None:
            rows = rows.filter(F.col("deployment").isin(list(sites)))
        return nan_to_null(with_hour(rows, "datetime", "datetime").select(
            "datetime", "deployment", F.col(value).alias("pm10"), F.lit(era).alias("era")))

    parts = []
    if start <= change:
        parts.append(part(old, "pm10_std_avg", 0))
    if end > change:
        parts.append(part(new, "pm10_1hour_stp", 1))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_site_locations(deployments: DataFrame, sites: Iterable[str] | None = None, names: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct deployments with position, and their code when a code -> name table is given."""
    rows = deployments
    if sites is not None:
        rows = rows.filter(F.col("deployment").isin(list(sites)))
    out = rows.select("deployment", "x", "y").distinct()
    return out.withColumn("abrv", site_code("deployment", names)) if names else out
