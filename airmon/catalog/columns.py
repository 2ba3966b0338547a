"""Projections and scalar functions (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airmon import dims
from airmon.catalog.proxy import Proxy
from airmon.catalog.registry import query
from airmon.catalog.sources import SHEET_SQL, teom_sheet
from airmon.functions import timecol as tc, values as val
from airmon.operators import aggregate as agg, direction, quality as qc, reconcile as rec, reshape
from airmon.operators.calendar import with_hour, with_hour_ending_date


@query("SELECT event_id, datetime, CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date FROM p_obs")
def hour_ending_date(p: Proxy):
    return with_hour_ending_date(p.obs.select("event_id", "datetime"))


@query("SELECT event_id, datetime, CAST(hour(datetime - INTERVAL 1 SECOND) AS INTEGER) AS hour FROM p_obs")
def hour_ending_hour(p: Proxy):
    return p.obs.select("event_id", "datetime", tc.hour_ending_hour("datetime").alias("hour"))


@query("""SELECT event_id, abrv, wd, onlake_wd AS inside, wd BETWEEN 90 AND 270 AS plain,
 wd BETWEEN 350 AND 360 OR wd BETWEEN 0 AND 10 AS north, wd BETWEEN 90 AND 360 OR wd BETWEEN 0 AND 90 AS closed
FROM p_obs""")
def angle_between(p: Proxy):
    return p.obs.join(p.sectors, "abrv").select(
        "event_id", "abrv", "wd",
        val.angle_between("wd", "from_deg", "to_deg").alias("inside"),
        val.angle_between("wd", 90, 270).alias("plain"),
        val.angle_between("wd", 350, 10).alias("north"),
        val.angle_between("wd", 90, 90).alias("closed"))


@query("SELECT abrv, datetime, wd, onlake FROM p_classified")
def classify_onlake(p: Proxy):
    return direction.classify_onlake(p.demixed, p.sectors).select("abrv", "datetime", "wd", "onlake")


@query("SELECT abrv, datetime, wd, dunes FROM p_classified")
def classify_dunes(p: Proxy):
    return direction.classify_dunes(p.demixed).select("abrv", "datetime", "wd", "dunes")


@query("""SELECT event_id, utc, utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS local
FROM (SELECT event_id, date_trunc('hour', ts) + INTERVAL 300 DAY AS utc FROM events)""")
def utc_to_local(p: Proxy):
    # moved to autumn, so that the repeated hour is among the rows
    utc = tc.truncate_to_hour("ts") + F.expr("INTERVAL 300 DAY")
    parts = p.table("events").select("event_id", utc.alias("utc"))
    return parts.select("event_id", "utc", tc.utc_to_local("utc").alias("local"))


@query("SELECT event_id, date_utc, hour_utc, datetime_utc AS datetime FROM p_measurement")
def local_from_parts(p: Proxy):
    return p.measurement.select(
        "event_id", "date_utc", "hour_utc", tc.local_from_parts("date_utc", "hour_utc").alias("datetime"))


@query("""SELECT event_id, date, code, CAST(date AS TIMESTAMP) + CAST(code / 100 AS INTEGER) * INTERVAL 1 HOUR AS datetime
FROM (SELECT event_id, CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date,
 CAST((hour(datetime - INTERVAL 1 SECOND) + 1) * 100 AS INTEGER) AS code FROM p_obs)""")
def hour_code_to_datetime(p: Proxy):
    coded = p.obs.select(
        "event_id", tc.hour_ending_date("datetime").alias("date"),
        ((tc.hour_ending_hour("datetime") + 1) * 100).alias("code"))
    return coded.withColumn("datetime", tc.hour_code_to_datetime("date", "code"))


@query("SELECT date AS serial, hour, DATE '1899-12-30' + date AS date FROM (" + SHEET_SQL + ")")
def excel_serial_date(p: Proxy):
    return teom_sheet(p).select(
        F.col("date").alias("serial"), "hour", tc.excel_serial_date("date").alias("date"))


@query("SELECT event_id, ts, date_trunc('hour', ts) AS hour FROM events")
def truncate_to_hour(p: Proxy):
    return with_hour(p.table("events").select("event_id", "ts"), "ts", "hour")


@query("""SELECT event_id, prelim, validated, abrv AS from_prelim, abrv AS from_validated,
 CAST(NULL AS VARCHAR) AS unknown, deployment AS name,
 CASE abrv WHEN 'ST' THEN 'ST' WHEN 'NB' THEN 'NB' ELSE abrv END AS renamed FROM p_obs""")
def map_site_code(p: Proxy):
    old = F.when(F.col("abrv") == "ST", "AP").when(F.col("abrv") == "NB", "DE").otherwise(F.col("abrv"))
    return p.obs.select(
        "event_id", "prelim", "validated",
        val.site_code("prelim", dims.PRELIMINARY_NAMES).alias("from_prelim"),
        val.site_code("validated", dims.VALIDATED_NAMES).alias("from_validated"),
        val.lookup(F.concat(F.col("abrv"), F.lit("?")), dims.DEPLOYMENTS).alias("unknown"),
        val.lookup("abrv", dims.DEPLOYMENTS).alias("name"),
        val.recode(old, dims.RENAMED_SITES).alias("renamed"))


@query("SELECT event_id, value AS knots, round(value * 0.5144, 6) AS mps FROM events")
def knots_to_mps(p: Proxy):
    return p.table("events").select(
        "event_id", F.col("value").alias("knots"), F.round(val.knots_to_mps("value"), 6).alias("mps"))


@query("""SELECT event_id, abrv || '_' || CASE WHEN event_type = 'view' THEN 'ws' ELSE 'wd' END AS key, abrv,
 CASE WHEN event_type = 'view' THEN 'ws' ELSE 'wd' END AS var1 FROM p_obs""")
def split_site_variable(p: Proxy):
    kind = F.when(F.col("event_type") == "view", "ws").otherwise("wd")
    return reshape.split_site_variable(p.obs.select("event_id", F.concat_ws("_", "abrv", kind).alias("key")))


@query("""SELECT row_id, datetime,
 CASE WHEN month(datetime - INTERVAL 1 SECOND) BETWEEN 7 AND 9 THEN 'summer' ELSE 'winter' END AS season FROM p_record""")
def season(p: Proxy):
    return p.record.select("row_id", "datetime", tc.season("datetime").alias("season"))


@query("SELECT row_id, datetime, CAST(year(datetime - INTERVAL 1 SECOND) AS INTEGER) AS year FROM p_record")
def year_of(p: Proxy):
    return p.record.select("row_id", "datetime", tc.year_of("datetime").alias("year"))


@query("SELECT event_id, nullif(ws, -9999) AS ws, nullif(wd, -9999) AS wd, nullif(pm10, -9999) AS pm10 FROM p_obs")
def sentinel_to_null(p: Proxy):
    return qc.sentinel_to_null(p.obs.select("event_id", "ws", "wd", "pm10"))


@query("""SELECT date, abrv, onlake + offlake AS pm10_avg,
 CASE WHEN onlake + offlake > 150 THEN 'red' WHEN onlake + offlake <= 150 THEN 'black' END AS flag_color FROM p_contribution""")
def flag_color(p: Proxy):
    return agg.onlake_contribution(p.classified).select(
        "date", "abrv", "pm10_avg", val.flag_color("pm10_avg").alias("flag_color"))


@query("SELECT event_id, datetime, deployment_id, round(sand_flux, 9) AS sand_flux FROM p_flux")
def sand_flux_rate(p: Proxy):
    rate = val.sand_flux_rate("sumpc", "sumpc_total", "dwp_mass", "district_mass")
    return rec.flux_interval_join(p.sensor, p.periods).select(
        "event_id", "datetime", "deployment_id", F.round(rate, 9).alias("sand_flux"))


@query('SELECT site_num, parameter_code, first_max_value FROM '
       '(SELECT site_num, code AS parameter_code, value AS first_max_value FROM p_measurement)')
def normalise_names(p: Proxy):
    spoken = p.measurement.select(
        F.col("site_num").alias("Site Num"), F.col("code").alias("Parameter.Code"), F.col("value").alias("First Max Value"))
    return reshape.normalise_names(spoken)


@query("""SELECT date, abrv, CASE WHEN deployment = 'Olancha' THEN 'Olancha*' ELSE deployment END AS label,
 CASE WHEN preliminary THEN '(from preliminary, unvalidated data)' ELSE '' END AS subtitle
FROM p_contribution JOIN p_site USING (abrv)""")
def display_label(p: Proxy):
    days = p.demixed.groupBy("date", "abrv").agg(F.max(~F.col("valid")).alias("preliminary"))
    return days.join(p.site, "abrv").select(
        "date", "abrv", val.display_label("deployment").alias("label"),
        val.report_subtitle("preliminary").alias("subtitle"))


@query("""SELECT abrv, datetime, pm10, CAST(NULL AS DOUBLE) AS ws_r, ws FROM p_demixed""")
def ensure_columns(p: Proxy):
    return reshape.ensure_columns(p.demixed, ["abrv", "datetime", "pm10", "ws_r", "ws"])


FIRST = "min_by(value, event_id) FILTER (WHERE code = {})"


@query(f"""SELECT site_num, datetime_utc, {FIRST.format(81102)} AS pm10,
 coalesce({FIRST.format(61103)}, {FIRST.format(61101)}) AS ws, coalesce({FIRST.format(61104)}, {FIRST.format(61102)}) AS wd
FROM p_measurement GROUP BY 1, 2""")
def coalesce_resultant_scalar(p: Proxy):
    wide = reshape.pivot_parameters(p.measurement, ["site_num", "datetime_utc"], "event_id")
    return reshape.resultant_over_scalar(wide)
