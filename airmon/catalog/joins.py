"""Joins and reconciliation (D)."""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import functions as F

from airmon import dims
from airmon.catalog.proxy import Proxy
from airmon.catalog.registry import query
from airmon.functions import timecol as tc, values as val
from airmon.operators import aggregate as agg, quality as qc, reconcile as rec
from airmon.sources.tables import read_met_hourly


@query("SELECT abrv, datetime, date, ws, wd, pm10, onlake_wd, valid FROM p_hours")
def reconcile_sources(p: Proxy):
    return rec.reconcile_sources(p.source(True), p.source(False))


@query("""SELECT pm.abrv, pm.datetime, pm.pm10, met.ws, met.wd
FROM (SELECT * FROM p_source WHERE valid) pm
LEFT JOIN (SELECT * FROM p_source WHERE NOT valid) met ON met.abrv = pm.abrv AND met.datetime = pm.datetime""")
def attach_met(p: Proxy):
    return rec.attach_met(p.source(True).select("abrv", "datetime", "pm10"), p.source(False))


@query(f"""SELECT pm.deployment, pm.datetime, pm.pm10, m.ws_10m AS ws, m.wd_10m AS wd,
 CAST(pm.datetime - INTERVAL 1 SECOND AS DATE) AS date,
 EXISTS (SELECT 1 FROM p_flag f WHERE f.deployment_id = m.deployment_id AND f.field_id = 116
  AND m.datetime > f.start_datetime AND m.datetime <= f.end_datetime) AS invalid_ws,
 EXISTS (SELECT 1 FROM p_flag f WHERE f.deployment_id = m.deployment_id AND f.field_id = 117
  AND m.datetime > f.start_datetime AND m.datetime <= f.end_datetime) AS invalid_wd
FROM (SELECT s.deployment, h.datetime, h.pm10 FROM p_hours h JOIN p_site s ON s.abrv = h.abrv) pm
JOIN p_met m ON m.deployment = pm.deployment AND m.datetime = pm.datetime""")
def join_pm_met_inner(p: Proxy):
    pm = p.hours.withColumn("deployment", val.lookup("abrv", dims.DEPLOYMENTS)).select("deployment", "datetime", "pm10")
    met = p.met_table.join(p.deployments, "deployment_id").select(
        "deployment_id", "deployment", "datetime", F.col("ws_10m").alias("ws"), F.col("wd_10m").alias("wd"))
    both = rec.join_pm_met_inner(pm, met)
    flagged = qc.flag_lookup(both, p.flags, {"invalid_ws": 116, "invalid_wd": 117}, bucket_hours=1)
    return flagged.withColumn("date", tc.hour_ending_date("datetime")).drop("deployment_id")


@query("""SELECT event_id, deployment_id, datetime, start_datetime, collection_datetime, dwp_mass, district_mass FROM p_flux""")
def flux_interval_join(p: Proxy):
    return rec.flux_interval_join(p.sensor, p.periods).select(
        "event_id", "deployment_id", "datetime", "start_datetime", "collection_datetime", "dwp_mass", "district_mass")


@query("""SELECT event_id, datetime, 'csc-' || s.abrv AS csc FROM p_flux f JOIN p_site s ON s.site_id + 100 = f.csc_deployment_id""")
def collector_name_join(p: Proxy):
    joined = rec.flux_interval_join(p.sensor, p.periods)
    return rec.collector_name_join(joined, p.collectors).select("event_id", "datetime", "csc")


FILL_STEP = """{name} AS (SELECT a.abrv, a.datetime, a.pm10,
 CASE WHEN a.abrv = '{target}' AND a.wd IS NULL THEN coalesce(a.ws, b.ws) ELSE a.ws END AS ws,
 CASE WHEN a.abrv = '{target}' AND a.wd IS NULL THEN b.wd ELSE a.wd END AS wd
FROM {source} a LEFT JOIN {source} b ON b.abrv = '{donor}' AND b.datetime = a.datetime)"""
_steps, _source = [], "f0"
for _i, (_t, _d) in enumerate(dims.GAP_FILL_PAIRS, start=1):
    _steps.append(FILL_STEP.format(name=f"f{_i}", target=_t, donor=_d, source=_source))
    _source = f"f{_i}"
NEIGHBOUR_SQL = f"""SELECT * FROM (WITH f0 AS (SELECT abrv, datetime, pm10, ws, wd FROM p_demixed),
{", ".join(_steps)} SELECT abrv, datetime, pm10, ws, wd FROM {_source})"""


@query(NEIGHBOUR_SQL)
def gap_fill_from_neighbour(p: Proxy):
    return rec.gap_fill_from_neighbour(p.demixed.select("abrv", "datetime", "pm10", "ws", "wd"))


@query("""SELECT h.abrv, h.datetime, h.pm10, coalesce(h.ws, r.ws_10m) AS ws, coalesce(h.wd, r.wd_10m) AS wd
FROM p_demixed h LEFT JOIN p_met r ON h.abrv IN ('MS', 'KE') AND r.deployment = 'Lone Pine' AND r.datetime = h.datetime""")
def gap_fill_from_reference(p: Proxy):
    station = read_met_hourly(p.met_table, p.deployments, sites=["Lone Pine"])
    return rec.gap_fill_from_reference(p.demixed.select("abrv", "datetime", "pm10", "ws", "wd"), station)


@query("""SELECT abrv, datetime, pm10, deployment, x, y FROM p_demixed JOIN p_site USING (abrv)""")
def attach_site(p: Proxy):
    return rec.attach_site(p.demixed.select("abrv", "datetime", "pm10"), p.site.select("abrv", "deployment", "x", "y"))


HOURLY_FLUX = """SELECT CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date, CAST(hour(datetime - INTERVAL 1 SECOND) AS INTEGER) AS hour,
 round(sum(sand_flux), 6) AS sand_flux FROM p_flux GROUP BY 1, 2"""


@query(f"""SELECT f.date, f.hour, f.sand_flux, m.ws, m.wd FROM ({HOURLY_FLUX}) f
LEFT JOIN (SELECT CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date, hour(datetime - INTERVAL 1 SECOND) AS hour, ws_10m AS ws, wd_10m AS wd
 FROM p_met WHERE deployment = 'Keeler') m ON m.date = f.date AND m.hour = f.hour""")
def join_on_date_hour(p: Proxy):
    rate = val.sand_flux_rate("sumpc", "sumpc_total", "dwp_mass", "district_mass")
    flux = rec.flux_interval_join(p.sensor, p.periods).select("datetime", rate.alias("sand_flux"))
    met = p.met_table.join(p.deployments.filter(F.col("deployment") == "Keeler"), "deployment_id").select(
        tc.hour_ending_date("datetime").alias("date"), tc.hour_ending_hour("datetime").alias("hour"),
        F.col("ws_10m").alias("ws"), F.col("wd_10m").alias("wd"))
    hourly = agg.hourly_flux_sum(flux).withColumn("sand_flux", val.steady("sand_flux"))
    return rec.join_on_date_hour(hourly, met)


@query("""SELECT date, abrv, onlake, offlake, CASE WHEN hrs_onlake + hrs_offlake > 0 THEN hrs_onlake END AS hrs_onlake,
 CASE WHEN hrs_onlake + hrs_offlake > 0 THEN hrs_offlake END AS hrs_offlake FROM p_contribution""")
def attach_hour_counts(p: Proxy):
    parts = agg.onlake_contribution(p.classified).select("date", "abrv", "onlake", "offlake")
    return rec.attach_hour_counts(parts, agg.onlake_hour_counts(p.classified))


@query("""SELECT site_id AS deployment_id, deployment FROM p_site
WHERE site_id IN (SELECT deployment_id FROM p_sensor) AND deployment <> 'Lone Pine'""")
def sites_in_network(p: Proxy):
    return rec.sites_in_network(p.deployments.select("deployment_id", "deployment"), p.sensor, without=["Lone Pine"])


@query("""SELECT abrv, datetime, date, CASE WHEN abrv = 'OL' AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'
 THEN TRUE ELSE onlake END AS onlake FROM p_classified""")
def override_direction(p: Proxy):
    days = [dtm.date(2024, 1, d) for d in (10, 11, 12)]
    fixes = dims.local_table(p.spark, {"abrv": ["OL"] * 3, "date": days, "onlake_override": [True] * 3})
    return rec.override_direction(p.classified.select("abrv", "datetime", "date", "onlake"), fixes)
