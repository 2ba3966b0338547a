"""Aggregations (F), windows and ordering (G), set operations (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airmon.catalog.joins import HOURLY_FLUX
from airmon.catalog.proxy import Proxy
from airmon.catalog.registry import query
from airmon.functions import values as val
from airmon.operators import aggregate as agg, direction, quality as qc, reconcile as rec
from airmon.operators.calendar import with_hour_ending_date
from airmon.operators.exceedance import exceedances, exceeding_days
from airmon.plans.shoreline import exceeding_sites_per_day


@query("SELECT date, abrv, pm10_avg FROM p_daily")
def daily_avg(p: Proxy):
    return agg.daily_avg(p.demixed)


@query("SELECT date, abrv, round_even(pm10_avg, 0) AS pm10_avg FROM p_daily")
def daily_avg_rounded(p: Proxy):
    return agg.daily_avg_rounded(p.demixed)


@query("""SELECT date, abrv, coalesce(round_even(round(avg(pm10), 6), 0), 0) AS avg_pm10, count(pm10) AS n FROM (
SELECT CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date, abrv, nullif(pm10, -9999) AS pm10 FROM p_obs) GROUP BY 1, 2""")
def avg_pm10(p: Proxy):
    rows = qc.sentinel_to_null(p.obs.select("abrv", "datetime", "pm10"))
    return agg.avg_pm10(with_hour_ending_date(rows))


@query("SELECT date, abrv, hrs_offlake, hrs_onlake FROM p_contribution WHERE hrs_onlake + hrs_offlake > 0")
def onlake_hour_counts(p: Proxy):
    return agg.onlake_hour_counts(p.classified)


@query("SELECT date, abrv, onlake, offlake, onlake + offlake AS pm10_avg FROM p_contribution")
def onlake_contribution(p: Proxy):
    return agg.onlake_contribution(p.classified)


@query("SELECT * FROM p_conditional")
def sector_conditional_means(p: Proxy):
    return agg.sector_conditional_means(p.classified)


BACKFILL = "round_even(round(({m} * {n} + 20 * (24 - {n})) / 24, 6), 0)"


def backfilled(m: str, n: str) -> str:
    return BACKFILL.format(m=m, n=n) + f" AS {m}"


BACKFILL_SQL = ", ".join(f"{backfilled(m, n)}, {n}" for m, n in agg.BACKFILLED)


@query(f"SELECT date, abrv, {BACKFILL_SQL} FROM p_exceeding")
def backfill_24h(p: Proxy):
    return agg.backfill_24h(exceeding_days(agg.sector_conditional_means(p.classified)))


STATION_DAYS = """SELECT date, abrv, round_even(round(coalesce(sum(pm10), 0) / nullif(count(pm10), 0), 6), 0) AS pm10_24,
 round_even(round(coalesce(sum(pm10) FILTER (WHERE onlake), 0) / nullif(count(pm10), 0), 6), 0) AS pm10_onlake,
 round_even(round(coalesce(sum(pm10) FILTER (WHERE NOT onlake), 0) / nullif(count(pm10), 0), 6), 0) AS pm10_offlake
FROM (SELECT r.*, CASE WHEN from_deg < to_deg THEN wd BETWEEN from_deg AND to_deg
 ELSE wd BETWEEN from_deg AND 360 OR wd BETWEEN 0 AND to_deg END AS onlake
 FROM p_record r JOIN p_site s ON r.abrv = s.abrv) GROUP BY 1, 2"""


@query(f"""SELECT abrv, CAST(year(date) AS INTEGER) AS year, round(avg(pm10_24), 6) AS avg_pm10, max(pm10_24) AS max_pm10,
 max(pm10_onlake) AS max_onlake, max(pm10_offlake) AS max_offlake, round(count(*) / 365, 6) AS percent_data
FROM ({STATION_DAYS}) GROUP BY 1, 2""")
def yearly_station_summary(p: Proxy):
    daily = agg.daily_contribution(direction.classify_onlake(p.record, p.sectors))
    return agg.yearly_station_summary(daily, ["abrv"])


@query("SELECT date, abrv, count(*) AS n FROM p_demixed GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2")
def day_completeness(p: Proxy):
    return agg.day_completeness(p.demixed)


@query("""SELECT site_num, code, min(datetime_utc) AS start, max(datetime_utc) AS "end" FROM p_measurement GROUP BY 1, 2""")
def coverage_by_parameter(p: Proxy):
    return agg.coverage_by_parameter(p.measurement, dt="datetime_utc")


@query("""SELECT abrv, min(datetime) AS start, max(datetime) AS "end" FROM p_record GROUP BY 1""")
def site_extent(p: Proxy):
    return agg.site_extent(p.record)


@query("""SELECT abrv, min(datetime) AS start, max(datetime) AS "end", count(*) AS data_count,
 date_diff('hour', min(datetime), max(datetime)) - count(*) AS missing FROM p_hours GROUP BY 1""")
def missing_hours(p: Proxy):
    return agg.missing_hours(p.hours)


@query("""SELECT abrv, before + INTERVAL 1 HOUR AS start, datetime - INTERVAL 1 HOUR AS "end", date_diff('hour', before, datetime) - 1 AS hours
FROM (SELECT abrv, datetime, lag(datetime) OVER (PARTITION BY abrv ORDER BY datetime) AS before FROM (SELECT DISTINCT abrv, datetime FROM p_record))
WHERE date_diff('hour', before, datetime) > 1""")
def missing_ranges(p: Proxy):
    return agg.missing_ranges(p.record)


@query(HOURLY_FLUX)
def hourly_flux_sum(p: Proxy):
    rate = val.sand_flux_rate("sumpc", "sumpc_total", "dwp_mass", "district_mass")
    hours = agg.hourly_flux_sum(rec.flux_interval_join(p.sensor, p.periods).select("datetime", rate.alias("sand_flux")))
    return hours.withColumn("sand_flux", val.steady("sand_flux"))


@query("SELECT date, count(*) AS no_sites_exceeding FROM p_daily WHERE pm10_avg >= 150 GROUP BY 1")
def sites_exceeding_per_day(p: Proxy):
    cols = ("event_id", "abrv", "datetime", "ws", "wd", "pm10", "onlake_wd", "valid")
    return exceeding_sites_per_day(p.obs.select(*cols), "event_id")


@query("""SELECT date, abrv, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_notvalid
FROM p_hours GROUP BY 1, 2 HAVING count(*) FILTER (WHERE valid) > 0 AND count(*) FILTER (WHERE NOT valid) > 0""")
def site_days_valid_mix(p: Proxy):
    return agg.site_days_valid_mix(p.hours)


ROSE = """SELECT date, abrv, CAST(floor((((wd + 11.25) % 360) / 22.5)) AS INTEGER) AS sector,
 CAST(CASE WHEN pm10 < 20 THEN 0 WHEN pm10 < 50 THEN 1 WHEN pm10 < 100 THEN 2 WHEN pm10 < 150 THEN 3 ELSE 4 END AS INTEGER) AS class,
 CASE WHEN pm10 < 20 THEN '<20' WHEN pm10 < 50 THEN '20-50' WHEN pm10 < 100 THEN '50-100' WHEN pm10 < 150 THEN '100-150' ELSE '>=150' END AS label,
 count(*) AS hours FROM p_demixed WHERE wd IS NOT NULL AND pm10 IS NOT NULL GROUP BY 1, 2, 3, 4, 5"""


@query(f"SELECT *, round(hours / sum(hours) OVER (PARTITION BY date, abrv), 6) AS share FROM ({ROSE})")
def rose_table(p: Proxy):
    return direction.rose_table(p.demixed)


@query("SELECT DISTINCT date FROM p_daily WHERE pm10_avg >= 150 AND abrv IN ('OL', 'KE', 'DS')")
def distinct_exceed_days(p: Proxy):
    return agg.distinct_exceed_days(exceedances(p.demixed), ["OL", "KE", "DS"])


# ---- G ---------------------------------------------------------------------------------------------

@query("SELECT abrv, datetime, pm10, count(*) OVER (PARTITION BY date, abrv) AS n_hours FROM p_hours")
def hours_in_site_day(p: Proxy):
    return agg.hours_in_site_day(p.hours).select("abrv", "datetime", "pm10", "n_hours")


@query("SELECT abrv, datetime, min(event_id) AS first_event_id, count(*) AS n_rows FROM p_readings GROUP BY 1, 2")
def first_in_key(p: Proxy):
    return qc.first_in_key(p.readings, ["abrv", "datetime"], "event_id")


@query("""SELECT m.* FROM (SELECT event_id, deployment_id, datetime, CAST(datetime AS DATE) AS date FROM p_sensor) m
JOIN (SELECT s.site_id, max(h.date) AS last FROM p_hours h JOIN p_site s ON s.abrv = h.abrv
 WHERE h.datetime <= TIMESTAMP '2024-01-12 00:00:00' + s.site_id * INTERVAL 1 DAY GROUP BY 1) l ON l.site_id = m.deployment_id
WHERE m.date > l.last""")
def after_last_of(p: Proxy):
    stop = F.lit("2024-01-12 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("site_id"))
    early = p.hours.join(p.site, "abrv").filter(F.col("datetime") <= stop).select(
        F.col("site_id").alias("deployment_id"), "date")
    later = p.sensor.select("event_id", "deployment_id", "datetime", F.col("datetime").cast("date").alias("date"))
    return rec.after_last_of(later, early, site="deployment_id")


@query("SELECT abrv, date, datetime, pm10 FROM p_demixed ORDER BY abrv, datetime")
def sort_site_time(p: Proxy):
    return agg.sort_site_time(p.demixed.select("abrv", "date", "datetime", "pm10"))


# ---- H ---------------------------------------------------------------------------------------------

@query("""SELECT datetime, prelim AS deployment, ws, wd FROM p_obs
UNION ALL SELECT datetime, deployment, ws_10m, wd_10m FROM p_met
UNION ALL SELECT datetime, deployment, ws, wd FROM p_record""")
def union_networks(p: Proxy):
    cols = ("datetime", "deployment", "ws", "wd")
    preliminary = p.obs.select("datetime", F.col("prelim").alias("deployment"), "ws", "wd")
    met = p.met_table.join(p.deployments, "deployment_id").select(
        "datetime", "deployment", F.col("ws_10m").alias("ws"), F.col("wd_10m").alias("wd"))
    return rec.union_networks(preliminary, met, p.record.select(*cols))


@query("""SELECT row_id, date, abrv, pm10 FROM (
 SELECT r.*, l.last, make_date(CAST(year(r.date) AS INTEGER), 12, 31) AS year_end, r.wd IS NOT NULL AND year(r.date) <> 1997 AND month(r.date) <= 11 AS primary_row
 FROM p_record r LEFT JOIN (SELECT year(date) AS y, max(date) AS last FROM p_record
  WHERE wd IS NOT NULL AND year(date) <> 1997 AND month(date) <= 11 GROUP BY 1) l ON l.y = year(r.date))
WHERE CASE WHEN primary_row THEN last >= year_end OR date < last
 ELSE last IS NULL OR (last < year_end AND date >= last) END""")
def priority_splice(p: Proxy):
    # the primary lacks a year, unknown directions and every December
    rows = p.record.select("row_id", "date", "abrv", "pm10", "wd")
    mine = F.col("wd").isNotNull() & (F.year("date") != 1997) & (F.month("date") <= 11)
    cols = ("row_id", "date", "abrv", "pm10")
    return rec.priority_splice(rows.filter(mine).select(*cols), rows.filter(~mine).select(*cols))


@query("""SELECT abrv, datetime, pm10, valid FROM p_source
WHERE (valid AND date < DATE '2024-01-17') OR (NOT valid AND datetime - INTERVAL 1 SECOND >= TIMESTAMP '2024-01-17 00:00:00')""")
def history_live_splice(p: Proxy):
    cols = ("abrv", "datetime", "pm10", "valid")
    return rec.history_live_splice(p.source(True).select(*cols), p.source(False).select(*cols), "2024-01-17")


AGENCY_DAILY = """SELECT date_utc AS date, abrv, max(value) AS pm10_24 FROM p_measurement WHERE code = 81102 GROUP BY 1, 2"""
VALIDATED_DAILY = """SELECT date, abrv, round_even(round(avg(pm10), 6), 0) AS pm10_24 FROM p_source WHERE valid AND date < DATE '2024-01-20' GROUP BY 1, 2"""


@query(f"""SELECT date, abrv, pm10_24 FROM ({VALIDATED_DAILY})
UNION ALL SELECT date, abrv, pm10_24 FROM ({AGENCY_DAILY}) WHERE abrv = 'KE'
 AND date > (SELECT max(date) FROM ({VALIDATED_DAILY}) WHERE abrv = 'KE')""")
def append_daily_tail(p: Proxy):
    agency = p.measurement.filter(F.col("code") == 81102).groupBy(F.col("date_utc").alias("date"), "abrv").agg(
        F.max("value").alias("pm10_24"))
    before = p.source(True).filter(F.col("date") < F.lit("2024-01-20").cast("date"))
    daily = agg.daily_avg_rounded(before).withColumnRenamed("pm10_avg", "pm10_24")
    stored = p.readings.filter(F.col("valid") & (F.col("date") < F.lit("2024-01-20").cast("date")))
    return rec.append_daily_tail(daily, agency, "KE", source=stored)


@query("SELECT DISTINCT deployment, x, y FROM p_obs")
def distinct_sites(p: Proxy):
    return rec.distinct_sites(p.obs, ["deployment", "x", "y"])
