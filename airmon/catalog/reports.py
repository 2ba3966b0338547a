"""Exceedance and report tables (I), and the whole plans."""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import functions as F

from airmon import dims
from airmon.catalog.aggregates import BACKFILL_SQL
from airmon.catalog.filters import YEARS
from airmon.catalog.joins import NEIGHBOUR_SQL
from airmon.catalog.proxy import Proxy, conditional_means, exceeding_only, in_sector
from airmon.catalog.registry import query
from airmon.catalog.reshapes import met_sheet
from airmon.catalog.sources import land_responses, teom_sheet
from airmon.functions import values as val
from airmon.operators import aggregate as agg, daystate as ds, exceedance as exc, quality as qc
from airmon.plans import agency, flux, history, rolling, shoreline, teom, wind
from airmon.session import scratch_path
from airmon.sources import tables
from airmon.sources.published import Published
from airmon.sources.snapshot import snapshot


def _exceeding(p: Proxy):
    return exc.exceeding_days(agg.sector_conditional_means(p.classified))


@query("SELECT date, abrv, pm10_avg FROM p_daily WHERE pm10_avg >= 150")
def exceedances(p: Proxy):
    return exc.exceedances(p.demixed)


@query("""SELECT date, abrv, pm10_24, pm10_onlake, pm10_offlake,
 CASE WHEN pm10_offlake >= 150 AND pm10_onlake >= 150 THEN 'mixed' WHEN pm10_offlake >= 150 THEN 'offlake'
 WHEN pm10_onlake >= 150 THEN 'onlake' ELSE 'mixed' END AS class FROM """ + f"(SELECT date, abrv, {BACKFILL_SQL} FROM p_exceeding)")
def classify_event(p: Proxy):
    return exc.attribute_exceedances(_exceeding(p)).select(
        "date", "abrv", "pm10_24", "pm10_onlake", "pm10_offlake", "class")


@query("""SELECT date, abrv, CASE WHEN abrv = 'KE' THEN pm10_dunes END AS pm10_dunes, CASE WHEN abrv = 'KE' THEN n_dunes END AS n_dunes,
 CASE WHEN abrv = 'KE' AND pm10_dunes >= 150 THEN TRUE END AS dunes_flag FROM p_exceeding""")
def dunes_event(p: Proxy):
    return exc.dunes_event(exc.zero_empty_sectors(_exceeding(p))).select(
        "date", "abrv", "pm10_dunes", "n_dunes", "dunes_flag")


@query("""SELECT date, abrv, CASE WHEN n_onlake = 0 THEN 0 ELSE pm10_onlake END AS pm10_onlake,
 CASE WHEN n_offlake = 0 THEN 0 ELSE pm10_offlake END AS pm10_offlake,
 CASE WHEN n_dunes = 0 THEN 0 ELSE pm10_dunes END AS pm10_dunes FROM p_conditional""")
def zero_empty_sectors(p: Proxy):
    return exc.zero_empty_sectors(agg.sector_conditional_means(p.classified)).select(
        "date", "abrv", "pm10_onlake", "pm10_offlake", "pm10_dunes")


@query("""SELECT date, CASE WHEN deployment = 'Olancha' THEN 'Olancha*' ELSE deployment END AS site, onlake, offlake
FROM p_contribution JOIN p_site USING (abrv) WHERE daily_avg >= 150""")
def exceed_site_table(p: Proxy):
    return exc.exceed_site_table(exc.site_day_breakdown(p.classified), p.site)


@query("""SELECT date, abrv, deployment, x, y, CAST(CASE WHEN abrv = 'LT' THEN 1000 ELSE -1000 END AS INTEGER) AS y_offset,
 onlake + offlake AS pm10_avg,
 CASE WHEN onlake + offlake > 150 THEN 'red' WHEN onlake + offlake <= 150 THEN 'black' END AS flag_color, preliminary
FROM p_contribution JOIN p_site USING (abrv)""")
def daily_map_labels(p: Proxy):
    return exc.daily_map_labels(exc.site_day_breakdown(p.classified), p.site)


@query("""SELECT abrv, CAST(1 AS INTEGER) AS level, TIMESTAMP '0001-01-01 00:00:00' + CAST(b * 64 AS INTEGER) * INTERVAL 1 HOUR AS start,
 arg_min(pm10, datetime) AS first, arg_max(pm10, datetime) AS last, min(pm10) AS low, max(pm10) AS high, count(*) AS n,
 min(datetime) AS from_time, max(datetime) AS to_time
FROM (SELECT *, date_diff('hour', TIMESTAMP '0001-01-01 00:00:00', datetime) // 64 AS b FROM p_demixed) GROUP BY 1, b""")
def continuity_pyramid(p: Proxy):
    """The second level of the pyramid: 64 hours in a row."""
    return exc.continuity_pyramid(p.demixed).filter("level = 1")


@query("SELECT abrv, datetime, pm10 AS value FROM p_demixed ORDER BY abrv, datetime")
def continuity_series(p: Proxy):
    return exc.continuity_series(p.demixed)


# ---- day sums kept by batches -------------------------------------------------------------------------

def _rolling(p: Proxy) -> rolling.RollingDays:
    """All readings in three batches.  The third that wins comes last, so hours of earlier batches are taken back."""
    days = rolling.RollingDays(Published(p.spark, scratch_path(p.spark, "rolling")), p.sectors)
    for part in (2, 1, 0):
        days.add(p.readings.filter(F.col("event_id") % 3 == part))
    return days


@query("""SELECT date, abrv, d.pm10_avg, onlake, offlake, onlake + offlake AS shown, pm10_24, m.n, pm10_onlake, n_onlake, pm10_dunes, n_dunes, pm10_offlake,
 n_offlake FROM p_daily d JOIN p_contribution c USING (date, abrv) JOIN p_conditional m USING (date, abrv)""")
def rolling_day_state(p: Proxy):
    """Daily averages, contributions and conditional means from sums that three batches have changed."""
    state = _rolling(p).state()
    return (
        ds.daily_avg_of(state)
        .join(ds.contribution_of(state).withColumnRenamed("pm10_avg", "shown"), ["date", "abrv"])
        .join(ds.conditional_means_of(state), ["date", "abrv"]))


@query("""SELECT abrv, CAST(year(date) AS INTEGER) AS year, round(avg(pm10_24), 6) AS avg_pm10, max(pm10_24) AS max_pm10,
 max(pm10_onlake) AS max_onlake, max(pm10_offlake) AS max_offlake, round(count(*) / 365, 6) AS percent_data
FROM (SELECT date, abrv, round_even(round(sum(pm10) / count(pm10), 6), 0) AS pm10_24,
 round_even(round(coalesce(sum(pm10) FILTER (WHERE onlake), 0) / count(pm10), 6), 0) AS pm10_onlake,
 round_even(round(coalesce(sum(pm10) FILTER (WHERE NOT onlake), 0) / count(pm10), 6), 0) AS pm10_offlake
 FROM p_classified GROUP BY 1, 2) GROUP BY 1, 2""")
def rolling_yearly_summary(p: Proxy):
    return agg.yearly_station_summary(ds.daily_contribution_of(_rolling(p).state()), ["abrv"])


# ---- whole reports ----------------------------------------------------------------------------------

JANUARY = ("2024-01-01", "2024-01-31")


@query("""SELECT date, CASE WHEN deployment = 'Olancha' THEN 'Olancha*' ELSE deployment END AS site,
 CASE WHEN known > 0 THEN round_even(round(coalesce(on_sum, 0) / n, 6), 0) END AS onlake,
 CASE WHEN known > 0 THEN round_even(round(coalesce(off_sum, 0) / n, 6), 0) END AS offlake
FROM (SELECT date, abrv, count(*) AS n, count(onlake_wd) AS known, sum(pm10) FILTER (WHERE onlake_wd) AS on_sum,
 sum(pm10) FILTER (WHERE NOT onlake_wd) AS off_sum FROM p_demixed GROUP BY 1, 2
 HAVING round_even(round(avg(pm10), 6), 0) >= 150) JOIN p_site USING (abrv)""")
def shoreline_report(p: Proxy):
    """Site table of every exceedance day, from the two source tables on."""
    hours = shoreline.report_hours(
        tables.read_validated(p.validated_table, *JANUARY, order=["event_id"]),
        tables.read_preliminary(p.preliminary_table, *JANUARY, order=["event_id"]))
    return shoreline.report_tables(hours, p.site)["site_table"]


@query("""SELECT date, CASE WHEN deployment = 'Olancha' THEN 'Olancha*' ELSE deployment END AS site,
 round_even(round(coalesce(on_sum, 0) / n, 6), 0) AS onlake, round_even(round(coalesce(off_sum, 0) / n, 6), 0) AS offlake
FROM (SELECT date, abrv, count(*) AS n, count(dir) AS known, sum(pm10) FILTER (WHERE dir) AS on_sum,
 sum(pm10) FILTER (WHERE NOT dir) AS off_sum
 FROM (SELECT *, CASE WHEN abrv = 'OL' AND date = DATE '2024-01-17' THEN TRUE WHEN abrv IN ('DS', 'NB') THEN NULL ELSE onlake_wd END AS dir
  FROM p_demixed) GROUP BY 1, 2
 HAVING round_even(round(avg(pm10), 6), 0) >= 150) JOIN p_site USING (abrv) WHERE known > 0""")
def shoreline_report_strict(p: Proxy):
    """The site table without site-days of unknown direction (two sites have none), one day's direction overridden."""
    blind = [t.withColumn("onlake_wd", F.when(~F.col("abrv").isin("DS", "NB"), F.col("onlake_wd"))) for t in (
        tables.read_validated(p.validated_table, *JANUARY, order=["event_id"]),
        tables.read_preliminary(p.preliminary_table, *JANUARY, order=["event_id"]))]
    fixed = dims.local_table(p.spark, {"abrv": ["OL"], "date": [dtm.date(2024, 1, 17)], "onlake_override": [True]})
    return shoreline.report_tables(shoreline.report_hours(*blind, overrides=fixed), p.site, strict=True)["site_table"]


@query(f"""SELECT date, CASE WHEN deployment = 'Olancha' THEN 'Olancha*' ELSE deployment END AS site, pm10_onlake AS onlake,
 pm10_offlake AS offlake, CASE WHEN abrv = 'KE' THEN pm10_dunes END AS dunes FROM (
SELECT date, abrv, {BACKFILL_SQL} FROM p_exceeding) JOIN p_site USING (abrv)""")
def exceed_site_table_dunes(p: Proxy):
    return exc.exceed_site_table_dunes(exc.attribute_exceedances(_exceeding(p)), p.site)


_CODE = "max(v) FILTER (WHERE code = {})"


@query(f"""SELECT date, abrv, pm10_24, pm10_onlake, pm10_offlake,
 CASE WHEN pm10_24 > 150 THEN 'red' WHEN pm10_24 <= 150 THEN 'black' END AS flag_color FROM (
WITH a AS (SELECT abrv, datetime_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS datetime, code,
 min_by(value, event_id) AS v FROM p_measurement WHERE site_num <> '0099' GROUP BY 1, 2, 3),
agency AS (SELECT abrv, datetime, CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date, {_CODE.format(81102)} AS pm10,
 coalesce({_CODE.format(61104)}, {_CODE.format(61102)}) AS wd FROM a
 WHERE CAST(datetime - INTERVAL 1 SECOND AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-25' GROUP BY 1, 2, 3),
last AS (SELECT year(date) AS yr, max(date) AS last FROM agency GROUP BY 1),
spliced AS (
 SELECT abrv, datetime, date, wd, pm10, 1 AS rank FROM agency JOIN last ON yr = year(date) WHERE month(last) = 12 AND day(last) = 31 OR date < last
 UNION ALL SELECT abrv, datetime, date, wd, pm10, 2 FROM p_source LEFT JOIN last ON yr = year(date)
  WHERE NOT valid AND (last IS NULL OR (NOT (month(last) = 12 AND day(last) = 31) AND date >= last))
 UNION ALL SELECT abrv, datetime, date, wd, pm10, 0 FROM p_source WHERE valid AND abrv = 'OL'),
first AS (SELECT *, row_number() OVER (PARTITION BY abrv, datetime ORDER BY rank) AS k FROM spliced),
hours AS (SELECT f.*, {in_sector("wd", "from_deg", "to_deg")} AS onlake FROM first f JOIN p_site s ON s.abrv = f.abrv WHERE k = 1 AND pm10 > -15)
SELECT date, abrv, round_even(round(sum(pm10) / count(pm10), 6), 0) AS pm10_24,
 round_even(round(coalesce(sum(pm10) FILTER (WHERE onlake), 0) / count(pm10), 6), 0) AS pm10_onlake,
 round_even(round(coalesce(sum(pm10) FILTER (WHERE NOT onlake), 0) / count(pm10), 6), 0) AS pm10_offlake
FROM hours GROUP BY 1, 2)""")
def agency_station_report(p: Proxy):
    """Daily station table of agency hours spliced with preliminary and TEOM hours."""
    keys = ["site_num", "date_utc", "hour_utc", "code"]
    stacked = qc.first_by(p.measurement.select(*keys, "value", "event_id"), keys, ["event_id"])
    hours = snapshot(agency.agency_hours(stacked, "2024-01-01", "2024-01-25"), scratch_path(p.spark, "agency"))
    spliced = agency.spliced_hours(
        hours, p.source(False), p.source(True).filter(F.col("abrv") == "OL"), p.sectors)
    return agency.station_report(spliced)["daily"]


@query("""SELECT *, round(hours / sum(hours) OVER (PARTITION BY csc), 6) AS share FROM (
SELECT csc, CAST(floor(((wd + 11.25) % 360) / 22.5) AS INTEGER) AS sector,
 CAST(CASE WHEN sand_flux < 2 THEN 0 WHEN sand_flux < 4 THEN 1 WHEN sand_flux < 6 THEN 2 WHEN sand_flux < 8 THEN 3 ELSE 4 END AS INTEGER) AS class,
 CASE WHEN sand_flux < 2 THEN '<2' WHEN sand_flux < 4 THEN '2-4' WHEN sand_flux < 6 THEN '4-6' WHEN sand_flux < 8 THEN '6-8' ELSE '>=8' END AS label,
 count(*) AS hours
FROM (SELECT 'csc-' || s.abrv AS csc, CAST(f.datetime - INTERVAL 1 SECOND AS DATE) AS date, hour(f.datetime - INTERVAL 1 SECOND) AS hour,
 round(sum(sand_flux), 6) AS sand_flux FROM p_flux f JOIN p_site s ON s.site_id + 100 = f.csc_deployment_id
 WHERE NOT EXISTS (SELECT 1 FROM p_flag g WHERE g.deployment_id = f.sensit_deployment_id AND g.field_id = 90
  AND f.datetime > g.start_datetime AND f.datetime <= g.end_datetime) GROUP BY 1, 2, 3) h
JOIN (SELECT CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date, hour(datetime - INTERVAL 1 SECOND) AS hour, wd_10m AS wd
 FROM p_met WHERE deployment = 'Keeler') m ON m.date = h.date AND m.hour = h.hour
WHERE wd IS NOT NULL GROUP BY 1, 2, 3, 4)""")
def sand_flux_rose(p: Proxy):
    """Roses of hourly flux per collector with one station's wind, flagged counts left out."""
    counts = flux.sand_flux(p.sensor, p.periods, p.collectors, p.flags, flag_bucket_hours=1)
    met = tables.read_met_hourly(p.met_table, p.deployments, sites=["Keeler"])
    return flux.flux_rose(flux.hourly_flux_with_wind(qc.drop_invalid_flag(counts), met))


@query(f"""SELECT date, abrv, pm10_24, pm10_onlake, pm10_offlake, n,
 CASE WHEN pm10_offlake >= 150 AND pm10_onlake < 150 THEN 'offlake' WHEN pm10_onlake >= 150 AND pm10_offlake < 150 THEN 'onlake'
 ELSE 'mixed' END AS class FROM (
WITH n AS ({NEIGHBOUR_SQL}),
r AS (SELECT n.abrv, n.datetime, n.pm10, coalesce(n.wd, m.wd_10m) AS wd FROM n
 LEFT JOIN p_met m ON n.abrv IN ('MS', 'KE') AND m.deployment = 'Lone Pine' AND m.datetime = n.datetime),
h AS (SELECT r.*, CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date, {in_sector("wd", "from_deg", "to_deg")} AS onlake,
 wd BETWEEN 296 AND 337 AND r.abrv = 'KE' AS dunes FROM r JOIN p_site s ON s.abrv = r.abrv),
c AS ({conditional_means("h")}), e AS ({exceeding_only("c")})
SELECT date, abrv, {BACKFILL_SQL} FROM e)""")
def workbook_exceedances(p: Proxy):
    """Exceedances of a gap-filled workbook, backfilled to full days and classified."""
    station = tables.read_met_hourly(p.met_table, p.deployments, sites=["Lone Pine"])
    hours = history.workbook_hours(teom_sheet(p), met_sheet(p), station)
    return history.attributed_days(hours, p.sectors).select(
        "date", "abrv", "pm10_24", "pm10_onlake", "pm10_offlake", "n", "class")


WIND_SQL = """SELECT r.deployment, r.datetime, r.ws, r.wd,
 CASE WHEN month(r.datetime - INTERVAL 1 SECOND) BETWEEN 7 AND 9 THEN 'summer' ELSE 'winter' END AS season,
 CAST(year(r.datetime - INTERVAL 1 SECOND) AS INTEGER) AS year
FROM p_record r LEFT JOIN (SELECT deployment, min(datetime) AS first FROM p_record GROUP BY 1) f ON f.deployment = r.deployment
LEFT JOIN (VALUES ('LizardTl', 2), ('Keeler', 1), ('LonePine', 3), ('NorthBch', 9)) AS c(deployment, years) ON c.deployment = r.deployment
WHERE (c.years IS NULL OR r.datetime <= f.first + c.years * INTERVAL 1 YEAR) AND r.ws > 0 AND r.wd IS NOT NULL"""


def wind_rose_sql(by: str) -> str:
    return f"""SELECT *, round(hours / sum(hours) OVER (PARTITION BY deployment, {by}), 6) AS share FROM (
SELECT deployment, {by}, CAST(floor(((wd + 11.25) % 360) / 22.5) AS INTEGER) AS sector,
 CAST(CASE WHEN ws < 3 THEN 0 WHEN ws < 6 THEN 1 WHEN ws < 9 THEN 2 WHEN ws < 12 THEN 3 ELSE 4 END AS INTEGER) AS class,
 CASE WHEN ws < 3 THEN '<3' WHEN ws < 6 THEN '3-6' WHEN ws < 9 THEN '6-9' WHEN ws < 12 THEN '9-12' ELSE '>=12' END AS label,
 count(*) AS hours FROM ({WIND_SQL}) GROUP BY 1, 2, 3, 4, 5)"""


def wind_hours(p: Proxy):
    """The wind record as three networks, joined again."""
    parts = [p.record.filter(F.col("row_id") % 3 == k) for k in range(3)]
    return wind.network_hours(parts, dims.record_years_table(p.spark, YEARS))


@query(wind_rose_sql("season"))
def wind_network_rose(p: Proxy):
    return wind.network_roses(wind_hours(p))


@query(wind_rose_sql("year"))
def wind_network_rose_by_year(p: Proxy):
    return wind.network_roses(wind_hours(p), by="year")


@query(f"""SELECT deployment, min(datetime) AS start, max(datetime) AS "end", count(*) AS data_count,
 date_diff('hour', min(datetime), max(datetime)) - count(*) AS missing FROM ({WIND_SQL}) GROUP BY 1""")
def wind_record_gaps(p: Proxy):
    return wind.record_gaps(wind_hours(p))


@query("""SELECT * FROM (WITH t AS (SELECT datetime, deployment, abrv, pm10, row_number() OVER (PARTITION BY deployment, datetime
  ORDER BY datetime >= TIMESTAMP '2024-01-15 00:00:00', pm10) AS k FROM p_obs
 WHERE event_type <> 'error' AND datetime BETWEEN TIMESTAMP '2024-01-05 01:00:00' AND TIMESTAMP '2024-01-26 00:00:00')
SELECT t.datetime, t.abrv, CAST(t.datetime - INTERVAL 1 SECOND AS DATE) AS date, m.ws_10m AS ws, m.wd_10m AS wd, t.pm10
FROM t LEFT JOIN p_met m ON m.deployment = t.deployment AND m.datetime = t.datetime WHERE k = 1 AND t.abrv IN ('KE', 'OL', 'DS'))""")
def teom_hours(p: Proxy):
    """TEOM hours of two eras with the wind beside them."""
    rows = p.obs.select("datetime", "deployment", "pm10", (F.col("event_type") == "error").alias("invalid"))
    change = F.lit("2024-01-15").cast("date").cast("timestamp_ntz")
    old = rows.filter(F.col("datetime") < change).withColumnRenamed("pm10", "pm10_std_avg")
    new = rows.filter(F.col("datetime") >= change).withColumnRenamed("pm10", "pm10_1hour_stp")
    analog = p.met_table.withColumnsRenamed({"ws_10m": "ws_wvc", "wd_10m": "wd_wvc"})
    names = {s: dims.DEPLOYMENTS[s] for s in ("KE", "OL", "DS")}
    return teom.teom_hours(old, new, analog, p.deployments, "2024-01-05", "2024-01-25", "2024-01-15", names)


@query("""SELECT * FROM (WITH mine AS (SELECT date, abrv, round_even(pm10_avg, 0) AS pm10_24 FROM p_daily WHERE abrv <> 'KE' OR date <= DATE '2024-01-20'),
tail AS (SELECT date, abrv, max(pm10) AS pm10_24 FROM p_hours WHERE abrv = 'KE' GROUP BY 1, 2
 HAVING date > (SELECT max(date) FROM mine WHERE abrv = 'KE')),
every AS (SELECT * FROM mine UNION ALL SELECT * FROM tail)
SELECT DISTINCT g.site_group, e.date FROM every e
JOIN (VALUES ('near', 'KE'), ('near', 'OL'), ('far', 'DS'), ('far', 'OL')) AS g(site_group, abrv) ON g.abrv = e.abrv WHERE pm10_24 >= 150)""")
def station_exceed_days(p: Proxy):
    """Exceedance days by site group, one site's means continued by another source."""
    daily = agg.daily_avg(p.demixed).select("date", "abrv", val.half_even("pm10_avg").alias("pm10_24"))
    mine = daily.filter((F.col("abrv") != "KE") | (F.col("date") <= F.lit("2024-01-20").cast("date")))
    other = p.hours.groupBy("date", "abrv").agg(F.max("pm10").alias("pm10_24"))
    groups = dims.local_table(p.spark, {"site_group": ["near", "near", "far", "far"], "abrv": ["KE", "OL", "DS", "OL"]})
    return agency.exceed_days(agency.daily_with_tail(mine, other, ("KE",)), groups)


CUTOVER = dtm.date(2024, 1, 16)
SPLICED_SQL = f"""WITH n AS ({NEIGHBOUR_SQL}),
w AS (SELECT n.abrv, n.datetime, n.pm10, coalesce(n.ws, m.ws_10m) AS ws, coalesce(n.wd, m.wd_10m) AS wd FROM n
 LEFT JOIN p_met m ON n.abrv IN ('MS', 'KE') AND m.deployment = 'Lone Pine' AND m.datetime = n.datetime AND year(m.datetime) = 2024)
SELECT abrv, datetime, pm10, ws, wd FROM w WHERE datetime <= TIMESTAMP '2024-01-16 00:00:00'
UNION ALL SELECT abrv, datetime, pm10, ws, wd FROM p_demixed WHERE datetime > TIMESTAMP '2024-01-16 00:00:00'"""


def _spliced(p: Proxy):
    station = tables.read_met_hourly(p.met_table, p.deployments, sites=["Lone Pine"])
    book = history.workbook_hours(teom_sheet(p), met_sheet(p), station, start_year=2012, reference_year=2024)
    return history.spliced_hours(book, p.demixed, p.site, CUTOVER)


@query(f"SELECT s.*, deployment, x, y FROM ({SPLICED_SQL}) s JOIN p_site USING (abrv)")
def workbook_live_hours(p: Proxy):
    """Gap-filled workbook hours until a day, live hours from then on, with the sites' places."""
    return _spliced(p)


@query(f"""SELECT date, abrv, pm10_24, pm10_onlake, pm10_offlake, n,
 CASE WHEN pm10_offlake >= 150 AND pm10_onlake < 150 THEN 'offlake' WHEN pm10_onlake >= 150 AND pm10_offlake < 150 THEN 'onlake'
 ELSE 'mixed' END AS class FROM (
WITH r AS ({SPLICED_SQL}),
h AS (SELECT r.*, CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date, {in_sector("wd", "from_deg", "to_deg")} AS onlake,
 wd BETWEEN 296 AND 337 AND r.abrv = 'KE' AS dunes FROM r JOIN p_site s ON s.abrv = r.abrv),
c AS ({conditional_means("h")}), e AS ({exceeding_only("c")})
SELECT date, abrv, {BACKFILL_SQL} FROM e)""")
def workbook_live_exceedances(p: Proxy):
    """Classified exceedances over the splice of workbook and live hours."""
    return history.attributed_days(_spliced(p), p.sectors).select(
        "date", "abrv", "pm10_24", "pm10_onlake", "pm10_offlake", "n", "class")


AGENCY_DAYS_SQL = """SELECT date_utc AS date, abrv, min(value) FILTER (WHERE code = 81102) AS pm10, min(value) FILTER (WHERE code = 61101) AS ws_s,
 min(value) FILTER (WHERE code = 61102) AS wd_s, min(value) FILTER (WHERE code = 61103) AS ws_r, min(value) FILTER (WHERE code = 61104) AS wd_r
FROM p_measurement WHERE site_num <> '0099' AND date_utc BETWEEN DATE '2024-01-01' AND DATE '2024-01-28' GROUP BY 1, 2"""


def _agency_daily(p: Proxy):
    return p.measurement.select("site_num", F.col("date_utc").alias("date"), "code", "desc", "value", "units")


@query(AGENCY_DAYS_SQL)
def agency_daily(p: Proxy):
    """The agency's daily values, a column for each parameter."""
    return agency.agency_days(_agency_daily(p), "2024-01-01", "2024-01-28")


@query(f"""SELECT *, CAST(year(date) AS INTEGER) AS year, CASE WHEN pm10_24 > 150 THEN 'red' WHEN pm10_24 <= 150 THEN 'black' END AS flag_color FROM (
WITH mine AS (SELECT date, abrv, round_even(round(avg(pm10), 6), 0) AS pm10_24 FROM p_demixed WHERE date <= DATE '2024-01-20' GROUP BY 1, 2)
SELECT * FROM mine UNION ALL
SELECT date, abrv, pm10 AS pm10_24 FROM ({AGENCY_DAYS_SQL}) a WHERE abrv IN ('KE', 'SC') AND pm10 IS NOT NULL
 AND date > coalesce((SELECT max(date) FROM mine WHERE mine.abrv = a.abrv), DATE '0001-01-01'))""")
def agency_daily_chain(p: Proxy):
    """Computed daily means until a day, continued at two sites by the agency's daily values."""
    hours = p.demixed.filter(F.col("date") <= F.lit("2024-01-20").cast("date"))
    return agency.daily_chain(hours, _agency_daily(p), "2024-01-01", "2024-01-28", ("KE", "SC"))


@query("""SELECT site_num, CAST(code AS VARCHAR) AS parameter_code, min(t) AS start, max(t) AS "end" FROM (
SELECT *, datetime_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS t FROM p_measurement WHERE site_num <> '0099') GROUP BY 1, 2""")
def response_coverage(p: Proxy):
    """Coverage of landed responses by site and parameter, from the files on."""
    return agency.response_coverage(p.spark, land_responses(p), list(dims.AGENCY_SITES.values()))


def _wind_flag(field: int) -> str:
    return f"""EXISTS (SELECT 1 FROM p_flag f WHERE f.deployment_id = m.deployment_id AND f.field_id = {field}
 AND m.datetime > f.start_datetime AND m.datetime <= f.end_datetime)"""


@query(f"""SELECT h.deployment, h.datetime, h.date, h.pm10, m.ws_10m AS ws, m.wd_10m AS wd, {_wind_flag(116)} AS invalid_ws, {_wind_flag(117)} AS invalid_wd
FROM (SELECT s.deployment, r.datetime, r.date, r.pm10 FROM p_source r JOIN p_site s ON s.abrv = r.abrv WHERE valid AND r.abrv IN ('KE', 'OL', 'SC')
 AND date BETWEEN DATE '2024-01-04' AND DATE '2024-01-26') h
JOIN p_met m ON m.deployment = h.deployment AND m.datetime = h.datetime""")
def teom_flagged_wind(p: Proxy):
    """Validated dust hours of three sites with their wind, its speed and direction looked up in the flags."""
    dust = p.source(True).withColumn("deployment", val.lookup("abrv", dims.DEPLOYMENTS))
    analog = p.met_table.withColumnsRenamed({"ws_10m": "ws_wvc", "wd_10m": "wd_wvc"})
    names = [dims.DEPLOYMENTS[s] for s in ("KE", "OL", "SC")]
    return teom.flagged_wind_hours(dust, analog, p.deployments, p.flags, "2024-01-04", "2024-01-26", names, bucket_hours=1)
