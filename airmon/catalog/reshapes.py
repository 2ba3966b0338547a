"""Reshape (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airmon import dims
from airmon.catalog.columns import FIRST
from airmon.catalog.proxy import Proxy
from airmon.catalog.registry import query
from airmon.catalog.sources import EXPORT_SQL, SHEET_SQL, WIDE, teom_sheet
from airmon.functions import timecol as tc, values as val
from airmon.operators import reshape

CODES = ", ".join(f"{FIRST.format(c)} AS {n}" for c, n in dims.PARAMETER_CODES.items())


@query(f"SELECT site_num, datetime_utc, {CODES} FROM p_measurement GROUP BY 1, 2")
def pivot_parameters(p: Proxy):
    return reshape.pivot_parameters(p.measurement, ["site_num", "datetime_utc"], "event_id")


@query(f"""SELECT h.date, h.datetime, {EXPORT_SQL} FROM p_hours h JOIN p_site s ON h.abrv = s.abrv GROUP BY 1, 2""")
def pivot_sites(p: Proxy):
    hours = p.hours.withColumn("deployment", val.lookup("abrv", dims.DEPLOYMENTS))
    return reshape.pivot_sites(hours)


@query("""SELECT date, abrv, coalesce(max(hrs) FILTER (WHERE NOT onlake), 0) AS offlake, coalesce(max(hrs) FILTER (WHERE onlake), 0) AS onlake
FROM (SELECT date, abrv, onlake, count(*) AS hrs FROM p_classified GROUP BY 1, 2, 3) WHERE onlake IS NOT NULL GROUP BY 1, 2""")
def pivot_onlake(p: Proxy):
    hours = p.classified.groupBy("date", "abrv", "onlake").agg(F.count(F.lit(1)).alias("hrs"))
    return reshape.pivot_onlake(hours, "hrs")


_LONG = " UNION ALL ".join(f"SELECT date, hour, '{s}' AS abrv, {s} AS teom FROM sheet" for s in WIDE)


@query(f"SELECT * FROM (WITH sheet AS ({SHEET_SQL}) {_LONG})")
def unpivot_sites(p: Proxy):
    return reshape.unpivot_sites(teom_sheet(p), WIDE)


def met_sheet(p: Proxy):
    """Hours by site and variable, columns like KE_wd."""
    d = tc.one_second_before("datetime")
    rows = p.demixed.select(
        F.date_diff("date", F.lit("1899-12-30").cast("date")).alias("date"), ((F.hour(d) + 1) * 100).alias("hour"),
        "abrv", "ws", "wd")
    return rows.groupBy("date", "hour").agg(*[
        F.max(F.when(F.col("abrv") == s, F.col(v))).alias(f"{s}_{v}") for s in WIDE for v in ("ws", "wd")])


_MET = ", ".join(f"max({v}) FILTER (WHERE abrv = '{s}') AS {s}_{v}" for s in WIDE for v in ("ws", "wd"))
_MET_LONG = " UNION ALL ".join(f"SELECT date, hour, '{s}' AS abrv, {s}_ws AS ws, {s}_wd AS wd FROM sheet" for s in WIDE)


@query(f"""SELECT * FROM (WITH sheet AS (SELECT CAST(date - DATE '1899-12-30' AS INTEGER) AS date,
 CAST((hour(datetime - INTERVAL 1 SECOND) + 1) * 100 AS INTEGER) AS hour, {_MET} FROM p_demixed GROUP BY 1, 2) {_MET_LONG})""")
def unpivot_site_variables(p: Proxy):
    return reshape.unpivot_site_variables(met_sheet(p))
