"""Filters and quality control (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airmon import dims
from airmon.catalog.proxy import Proxy
from airmon.catalog.registry import query
from airmon.functions import timecol as tc
from airmon.operators import quality as qc


@query("""SELECT * FROM p_sensor
WHERE CAST(datetime - INTERVAL 1 SECOND AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""")
def filter_period(p: Proxy):
    return qc.filter_period(p.sensor, "2024-01-08", "2024-01-14")


@query("""SELECT * FROM p_sensor
WHERE datetime BETWEEN TIMESTAMP '2024-01-08 01:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""")
def filter_hour_range(p: Proxy):
    return qc.filter_hour_range(p.sensor, "2024-01-08", "2024-01-14")


@query("""SELECT event_id, abrv, datetime, pm10 FROM p_obs
WHERE abrv IN ('DS', 'SC', 'ST', 'NB', 'LT', 'OL', 'MS', 'KE')""")
def filter_sites(p: Proxy):
    group = dims.site_group_table(p.spark).filter(F.col("site_group") == "Shoreline")
    return qc.filter_sites(p.obs.select("event_id", "abrv", "datetime", "pm10"), group)


@query("SELECT event_id, abrv, datetime, pm10 FROM p_obs WHERE pm10 > -15 AND datetime IS NOT NULL")
def qc_bounds(p: Proxy):
    return qc.qc_bounds(p.obs.select("event_id", "abrv", "datetime", "pm10"))


@query("""SELECT abrv, datetime, event_id, ws, wd, pm10 FROM (
SELECT *, row_number() OVER (PARTITION BY abrv, datetime ORDER BY event_id) AS k FROM p_readings) WHERE k = 1""")
def dedup_site_hour(p: Proxy):
    rows = p.readings.select("abrv", "datetime", "event_id", "ws", "wd", "pm10")
    return qc.dedup_site_hour(rows, ["event_id"])


@query("SELECT event_id, abrv, datetime, ws, wd, nullif(pm10, -9999) AS pm10 FROM p_obs WHERE wd IS NOT NULL AND pm10 <> -9999 AND ws IS NOT NULL")
def complete_cases(p: Proxy):
    rows = p.obs.select("event_id", "abrv", "datetime", "ws", "wd", "pm10")
    return qc.complete_cases(qc.sentinel_to_null(rows))


@query("SELECT event_id, abrv, datetime, pm10 FROM p_obs WHERE event_type <> 'error'")
def drop_invalid_flag(p: Proxy):
    rows = p.obs.withColumn("invalid", F.col("event_type") == "error")
    return qc.drop_invalid_flag(rows).select("event_id", "abrv", "datetime", "pm10")


def _flagged(field: int) -> str:
    return f"""EXISTS (SELECT 1 FROM p_flag f WHERE f.deployment_id = s.deployment_id AND f.field_id = {field}
 AND s.datetime > f.start_datetime AND s.datetime <= f.end_datetime)"""


@query(f"SELECT event_id, deployment_id, datetime, {_flagged(116)} AS invalid_ws, {_flagged(117)} AS invalid_wd FROM p_sensor s")
def flag_lookup(p: Proxy):
    rows = p.sensor.select("event_id", "deployment_id", "datetime")
    return qc.flag_lookup(rows, p.flags, {"invalid_ws": 116, "invalid_wd": 117}, bucket_hours=1)


@query("SELECT row_id, abrv, datetime, ws, wd FROM p_record WHERE ws IS NOT NULL AND wd IS NOT NULL AND ws > 0")
def valid_wind(p: Proxy):
    return qc.valid_wind(p.record.select("row_id", "abrv", "datetime", "ws", "wd"))


YEARS = dict(list(dims.RECORD_YEARS.items()) + [("LizardTl", 2), ("Keeler", 1), ("LonePine", 3)])


@query("""SELECT r.row_id, r.deployment, r.datetime, r.ws, r.wd FROM p_record r
LEFT JOIN (SELECT deployment, min(datetime) AS first FROM p_record GROUP BY 1) f ON f.deployment = r.deployment
LEFT JOIN (VALUES ('LizardTl', 2), ('Keeler', 1), ('LonePine', 3), ('NorthBch', 9)) AS c(deployment, years) ON c.deployment = r.deployment
WHERE c.years IS NULL OR r.datetime <= f.first + c.years * INTERVAL 1 YEAR""")
def trim_record(p: Proxy):
    rows = p.record.select("row_id", "deployment", "datetime", "ws", "wd")
    return qc.trim_record(rows, dims.record_years_table(p.spark, YEARS)).select("row_id", "deployment", "datetime", "ws", "wd")


@query("SELECT abrv, datetime, date, pm10 FROM p_hours WHERE date <> (SELECT max(date) FROM p_hours)")
def drop_incomplete_last_day(p: Proxy):
    return qc.drop_incomplete_last_day(p.hours, source=p.readings).select("abrv", "datetime", "date", "pm10")


@query("SELECT abrv, datetime, date, ws, wd, pm10, valid FROM p_demixed")
def drop_mixed_preliminary(p: Proxy):
    return qc.drop_mixed_preliminary(p.hours).select("abrv", "datetime", "date", "ws", "wd", "pm10", "valid")


@query("""SELECT date, abrv, count(*) FILTER (WHERE pm10 IS NOT NULL AND wd IS NOT NULL) AS n_rows,
 count(*) FILTER (WHERE pm10 IS NOT NULL AND wd IS NOT NULL) = 0 AS placeholder FROM p_demixed GROUP BY 1, 2""")
def rose_subset(p: Proxy):
    return qc.rose_subset(p.demixed)


@query("""SELECT event_id, method_description FROM (
SELECT event_id, 'INSTRUMENTAL-' || CASE WHEN event_type IN ('view', 'click') THEN 'R&P TEOM' ELSE 'BAM' END AS method_description
FROM events) WHERE method_description LIKE '%TEOM%'""")
def regex_method_filter(p: Proxy):
    name = F.when(F.col("event_type").isin("view", "click"), "R&P TEOM").otherwise("BAM")
    rows = p.table("events").select("event_id", F.concat(F.lit("INSTRUMENTAL-"), name).alias("method_description"))
    return qc.method_filter(rows)


@query("""SELECT row_id, abrv, datetime, 'summer' AS season FROM p_record
WHERE month(datetime - INTERVAL 1 SECOND) BETWEEN 7 AND 9""")
def season_filter(p: Proxy):
    rows = p.record.select("row_id", "abrv", "datetime", tc.season("datetime").alias("season"))
    return qc.season_filter(rows, "summer")


@query("""SELECT event_id, datetime FROM (SELECT event_id, date_trunc('hour', ts) + INTERVAL 60 DAY AS datetime FROM events)
WHERE datetime AT TIME ZONE 'America/Los_Angeles' AT TIME ZONE 'UTC' AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' = datetime""")
def drop_nonexistent_local(p: Proxy):
    # moved to spring, so that the skipped hour is among the rows
    local = tc.truncate_to_hour("ts") + F.expr("INTERVAL 60 DAY")
    return qc.drop_nonexistent_local(p.table("events").select("event_id", local.alias("datetime")))
