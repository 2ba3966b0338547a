"""Readers (A) and writers (J)."""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import functions as F

from airmon import dims, schemas
from airmon.catalog.proxy import SITES, Proxy
from airmon.catalog.registry import query
from airmon.functions import timecol as tc, values as val
from airmon.operators import reconcile as rec, reshape
from airmon.plans import shoreline
from airmon.session import scratch_path
from airmon.sources import bucketed, files, quarantine, sinks, tables
from airmon.sources.published import Published
from airmon.sources.snapshot import snapshot

START, END = "2024-01-03", "2024-01-25"


def _one_source(valid: str) -> str:
    return f"""SELECT abrv, datetime, date, ws, wd, pm10, onlake_wd, valid FROM p_source
WHERE {valid} AND date BETWEEN DATE '{START}' AND DATE '{END}'"""


@query(_one_source("NOT valid"))
def read_preliminary(p: Proxy):
    return tables.read_preliminary(p.preliminary_table, START, END, order=["event_id"])


@query(_one_source("valid"))
def read_validated(p: Proxy):
    return tables.read_validated(p.validated_table, START, END, order=["event_id"])


AGENCY_COLS = ("site_num", "date_utc", "hour_utc", "code", "desc", "value", "units")


@query('SELECT site_num, date_utc, hour_utc, code, "desc", value, units FROM p_measurement')
def read_aqs_hourly(p: Proxy):
    path = p.land(p.measurement.select(*AGENCY_COLS), "csv", "hourly", header=True)
    return files.read_aqs_hourly(p.spark, path)


@query("""SELECT site_num, date_utc AS date, code, "desc", max(value) AS value, units FROM p_measurement
GROUP BY 1, 2, 3, 4, 6""")
def read_aqs_daily(p: Proxy):
    daily = p.measurement.groupBy("site_num", F.col("date_utc").alias("date"), "code", "desc", "units").agg(
        F.max("value").alias("value"))
    cols = ("site_num", "date", "code", "desc", "value", "units")
    return files.read_aqs_daily(p.spark, p.land(daily.select(*cols), "csv", "daily", header=True))


def _bulk(p: Proxy):
    """Measurements in the layout of the national files; another county's rows among them."""
    known = {
        "State Code": F.lit("06"),
        "County Code": F.when(F.col("event_type") == "view", "029").otherwise("027"),
        "Site Num": F.col("site_num"),
        "POC": (F.col("event_id") % 3 + 1).cast("string"),
        "Parameter Code": F.col("code").cast("string"),
        "Parameter Name": F.col("desc"),
        "Date GMT": F.col("date_utc").cast("string"),
        "Time GMT": F.col("hour_utc"),
        "Sample Measurement": F.col("value").cast("string"),
        "Units of Measure": F.col("units"),
    }
    cols = [known.get(f.name, F.lit("")).alias(f.name) for f in schemas.BULK_HOURLY]
    return p.land(p.measurement.select(*cols), "csv", "bulk", header=True)


@query("""SELECT site_num, date_utc, hour_utc, code, "desc", value, units, CAST(event_id % 3 + 1 AS INTEGER) AS poc FROM p_measurement
WHERE event_type <> 'view' AND site_num IN ('1001', '0021', '0022', '0025', '0026')""")
def stack_aqs_bulk(p: Proxy):
    return files.stack_aqs_hourly(p.spark, _bulk(p))


@query("""SELECT site_num, date_utc AS date, code, "desc", value, units FROM p_measurement
WHERE event_type <> 'view' AND site_num IN ('1001', '0021', '0022', '0025', '0026')""")
def stack_aqs_daily(p: Proxy):
    known = {
        "State Code": F.lit("06"), "County Code": F.when(F.col("event_type") == "view", "029").otherwise("027"), "Site Num": F.col("site_num"),
        "Parameter Code": F.col("code").cast("string"), "Parameter Name": F.col("desc"), "Date Local": F.col("date_utc").cast("string"),
        "Arithmetic Mean": F.col("value").cast("string"), "Units of Measure": F.col("units")}
    cols = [known.get(f.name, F.lit("")).alias(f.name) for f in schemas.BULK_DAILY]
    return files.stack_aqs_daily(p.spark, p.land(p.measurement.select(*cols), "csv", "bulk_daily", header=True))


@query("""SELECT site_num, CAST(code AS VARCHAR) AS parameter_code, CAST(value AS VARCHAR) AS sample_measurement,
 datetime_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS datetime
FROM p_measurement WHERE site_num <> '0099'""")
def read_aqs_json(p: Proxy):
    rows = files.read_aqs_json(p.spark, land_responses(p), list(dims.AGENCY_SITES.values()))
    return rows.select("site_num", "parameter_code", "sample_measurement", "datetime")


def land_responses(p: Proxy) -> str:
    """Measurements as landed API responses."""
    response = p.measurement.select(
        F.lit("06").alias("State Code"), F.lit("027").alias("County Code"), F.col("site_num").alias("Site Num"),
        F.col("code").cast("string").alias("Parameter Code"), F.col("date_utc").cast("string").alias("Date GMT"),
        F.col("hour_utc").alias("24 Hour GMT"), F.col("value").cast("string").alias("Sample Measurement"))
    return p.land(response, "json", "api")


@query("""SELECT abrv, site_num, value AS pm10, '1 HOUR' AS sample_duration, datetime_utc AS datetime,
 CAST(datetime_utc - INTERVAL 1 SECOND AS DATE) AS date, CAST(year(datetime_utc - INTERVAL 1 SECOND) AS INTEGER) AS year
FROM p_measurement WHERE event_type IN ('view', 'click') AND site_num <> '0099'""")
def read_aqs_api_csv(p: Proxy):
    method = F.when(F.col("event_type").isin("view", "click"), "INSTRUMENTAL-TEOM").otherwise("BETA ATTENUATION")
    response = p.measurement.select(
        F.col("site_num").cast("int").cast("string").alias("Site.Num"),
        F.col("date_utc").cast("string").alias("Date.Local"), F.col("hour_utc").alias("X24.Hour.Local"),
        F.col("value").cast("string").alias("Sample.Measurement"), F.lit("1 HOUR").alias("Sample.Duration"),
        method.alias("Method.Description"))
    return files.read_aqs_api_csv(p.spark, p.land(response, "csv", "api", header=True))


@query("""SELECT datetime, deployment, ws_10m AS ws, wd_10m AS wd FROM p_met
WHERE CAST(datetime - INTERVAL 1 SECOND AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def read_met_hourly(p: Proxy):
    return tables.read_met_hourly(p.met_table, p.deployments, "2024-01-05", "2024-01-20")


@query("""SELECT datetime, deployment, ws_10m AS ws, wd_10m AS wd FROM p_met
WHERE datetime BETWEEN TIMESTAMP '2024-01-05 01:00:00' AND TIMESTAMP '2024-01-21 00:00:00'""")
def read_analog_hourly(p: Proxy):
    analog = p.met_table.withColumnsRenamed({"ws_10m": "ws_wvc", "wd_10m": "wd_wvc"})
    return tables.read_analog_hourly(analog, p.deployments, "2024-01-05", "2024-01-20")


@query("""SELECT datetime, deployment, pm10, CAST(CASE WHEN datetime < TIMESTAMP '2024-01-15 00:00:00' THEN 0 ELSE 1 END AS INTEGER) AS era
FROM p_obs WHERE event_type <> 'error'
AND datetime BETWEEN TIMESTAMP '2024-01-05 01:00:00' AND TIMESTAMP '2024-01-26 00:00:00'""")
def read_teom_by_era(p: Proxy):
    rows = p.obs.select("datetime", "deployment", "pm10", (F.col("event_type") == "error").alias("invalid"))
    change = F.lit("2024-01-15").cast("date").cast("timestamp_ntz")
    old = rows.filter(F.col("datetime") < change).withColumnRenamed("pm10", "pm10_std_avg")
    new = rows.filter(F.col("datetime") >= change).withColumnRenamed("pm10", "pm10_1hour_stp")
    return tables.read_teom_by_era(old, new, "2024-01-05", "2024-01-25", "2024-01-15")


@query("""SELECT DISTINCT deployment, x, y, abrv FROM p_obs
WHERE deployment IN ('Dirty Socks', 'Stanley', 'Olancha', 'Keeler', 'Haiwee')""")
def read_site_locations(p: Proxy):
    wanted = ["Dirty Socks", "Stanley", "Olancha", "Keeler", "Haiwee"]
    return tables.read_site_locations(p.obs, wanted, dims.DEPLOYMENTS)


WIDE = [s for s in SITES]


def teom_sheet(p: Proxy):
    """Hours by sites with serial date and hour code, missing values marked."""
    d = tc.one_second_before("datetime")
    rows = p.demixed.select(
        F.date_diff("date", F.lit("1899-12-30").cast("date")).alias("serial"), ((F.hour(d) + 1) * 100).alias("hour"),
        "abrv", "pm10")
    wide = reshape.pivot_sites(rows, "pm10", WIDE, ("serial", "hour"), by="abrv")
    return wide.withColumnRenamed("serial", "date").na.fill(dims.SENTINEL)


SHEET_SQL = f"""SELECT CAST(date - DATE '1899-12-30' AS INTEGER) AS date,
 CAST((hour(datetime - INTERVAL 1 SECOND) + 1) * 100 AS INTEGER) AS hour,
 {", ".join(f"coalesce(max(pm10) FILTER (WHERE abrv = '{s}'), -9999) AS {s}" for s in WIDE)}
FROM p_demixed GROUP BY 1, 2"""


@query(f"SELECT date, hour, DS, KE FROM ({SHEET_SQL})")
def read_wide_workbook(p: Proxy):
    path = p.land(teom_sheet(p), "csv", "sheet", header=True)
    return files.read_wide_workbook(p.spark, path, ["date", "hour", *WIDE], ["date", "hour", "DS", "KE"])


@query("SELECT datetime, ws_10m, wd_10m FROM p_met")
def read_hour_code_csv(p: Proxy):
    date, hour = tc.hour_ending_date("datetime"), (tc.hour_ending_hour("datetime") + 1) * 100
    text = F.when(F.day(date) < 20, F.date_format(date, "M/d/yyyy")).otherwise(F.date_format(date, "MM/dd/yy"))
    rows = p.met_table.select(text.alias("date"), hour.alias("hour"), "ws_10m", "wd_10m")
    return files.read_hour_code_csv(p.spark, p.land(rows, "csv", "met", header=True))


@query("""SELECT date_trunc('second', datetime) AS datetime, 'csc-' || CAST(deployment_id AS VARCHAR) AS csc, sumpc AS sand_flux,
 FALSE AS invalid FROM p_sensor""")
def read_flux_csv(p: Proxy):
    rows = p.sensor.select(
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        F.concat(F.lit("csc-"), F.col("deployment_id").cast("string")).alias("csc"),
        F.col("sumpc").alias("sand_flux"), F.lit(False).alias("invalid"))
    return files.read_flux_csv(p.spark, p.land(rows, "csv", "flux", header=True))


@query("SELECT abrv, datetime, date, ws, wd, pm10, onlake_wd, valid FROM p_hours", name="snapshot")
def snapshot_hours(p: Proxy):
    path = scratch_path(p.spark, "hours")
    hours = p.hours.select(*tables.OBS)
    snapshot(hours, path)
    return snapshot(hours, path, refresh=False)


@query("""SELECT file, reason, count(*) AS count FROM (
 SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS file, unnest([
  CASE WHEN event_id % 41 = 0 THEN 'Site Num: missing' END, CASE WHEN event_id % 7 = 0 THEN 'Date GMT: no date' END,
  CASE WHEN event_id % 11 = 0 THEN 'Time GMT: no clock' END, CASE WHEN event_id % 13 = 0 THEN 'Sample Measurement: no number' END]) AS reason
 FROM p_measurement) WHERE reason IS NOT NULL GROUP BY 1, 2""")
def quarantine_counts(p: Proxy):
    """Faults planted in two files of a national extract, kept apart by the pass that lands the good rows, and counted."""
    e = F.col("event_id")
    known = {
        "State Code": F.lit("06"), "County Code": F.lit("027"), "POC": F.lit("1"),
        "Site Num": F.when(e % 41 == 0, "").otherwise(F.col("site_num")), "Parameter Code": F.col("code").cast("string"),
        "Date GMT": F.when(e % 7 == 0, "tomorrow").otherwise(F.col("date_utc").cast("string")),
        "Time GMT": F.when(e % 11 == 0, "25:00").otherwise(F.col("hour_utc")),
        "Sample Measurement": F.when(e % 13 == 0, "n/k").when(e % 17 == 0, "NA").otherwise(F.col("value").cast("string"))}
    cols = [known.get(f.name, F.lit("x")).alias(f.name) for f in schemas.BULK_HOURLY]
    rows = p.measurement.select(F.when(e % 2 == 0, "even").otherwise("odd").alias("part"), *cols)
    path, out, layout = scratch_path(p.spark, "landed"), scratch_path(p.spark, "checked"), quarantine.LAYOUTS["bulk_hourly"]
    rows.write.partitionBy("part").csv(path, header=True)
    files_ = [f"{path}/part={x}" for x in ("even", "odd")]
    quarantine.land(quarantine.checked(p.spark, files_, layout), out)
    counts = quarantine.fault_counts(quarantine.landed(p.spark, out, layout, "quarantine"))
    part = F.regexp_extract("file", "part=([a-z]+)/", 1)
    return counts.groupBy(part.alias("file"), "reason").agg(F.sum("count").alias("count"))


@query("""SELECT abrv, datetime, h.ws, h.wd, pm10, valid, m.ws_10m AS met_ws, m.wd_10m AS met_wd FROM p_hours h JOIN p_site s USING (abrv)
LEFT JOIN p_met m USING (deployment, datetime)""")
def reconcile_bucketed(p: Proxy):
    """Both sources and the met hours stored by site-hour, then joined without moving a row."""
    n = 8
    sources = [bucketed.store_by_site_hour(p.source(v).select(*tables.OBS), n) for v in (True, False)]
    met = p.met_table.join(p.deployments, "deployment_id").select("abrv", "datetime", F.col("ws_10m").alias("ws"), F.col("wd_10m").alias("wd"))
    met = bucketed.store_by_site_hour(met, n).withColumnsRenamed({"ws": "met_ws", "wd": "met_wd"})
    hours = rec.reconcile_sources(*sources).drop("date", "onlake_wd")
    return hours.join(met, ["abrv", "datetime"], "left")


CORRECTED, GONE = ("2024-01-04", "2024-01-11", "2024-01-22"), "2024-01-17"
IN_CORRECTED = ", ".join(f"DATE '{d}'" for d in CORRECTED)
READINGS = "event_id long, abrv string, datetime timestamp_ntz, ws double, wd double, pm10 double, onlake_wd boolean, valid boolean"


@query(f"""SELECT abrv, datetime, date, ws, wd, CASE WHEN date IN ({IN_CORRECTED}) THEN pm10 + 100 ELSE pm10 END AS pm10, onlake_wd, valid
FROM p_hours WHERE date <> DATE '{GONE}'""")
def snapshot_refresh(p: Proxy):
    """Hours assembled from landed readings, brought up to date after three days were corrected and one was withdrawn."""
    store = Published(p.spark, scratch_path(p.spark, "store"))
    rows = p.readings.withColumn("table", F.lit("readings"))
    every = (dtm.date(2024, 1, 1), dtm.date(2024, 12, 31))
    store.write(rows, {"readings": every})

    def build(days):
        return rec.reconcile_hours(store.read("readings", READINGS, days), "event_id").select(*tables.OBS)

    store.refresh("hours", store.state("readings"), build)
    corrected = rows.filter(F.col("date").isin(list(CORRECTED))).withColumn("pm10", F.col("pm10") + 100)
    store.write(corrected, {"readings": [dtm.date.fromisoformat(d) for d in (*CORRECTED, GONE)]})
    store.refresh("hours", store.state("readings"), build)
    return store.read("hours", "abrv string, datetime timestamp_ntz, ws double, wd double, pm10 double, onlake_wd boolean, valid boolean")


# ---- J ---------------------------------------------------------------------------------------------

DAYS = [f"2024-01-{d:02d}" for d in (3, 4, 17, 18, 24, 27)]
EXPORT_SQL = ", ".join(
    f"max(pm10) FILTER (WHERE deployment = '{d}') AS \"{d}\"" for d in dims.EXPORT_SITES)


@query(f"""SELECT h.date, h.datetime, {EXPORT_SQL} FROM p_hours h JOIN p_site s ON h.abrv = s.abrv
WHERE h.date IN ({", ".join(f"DATE '{d}'" for d in DAYS)}) GROUP BY 1, 2""")
def write_daily_wide_csv(p: Proxy):
    path = scratch_path(p.spark, "daily")
    hours = p.hours.join(p.site.select("abrv", "deployment"), "abrv")
    sinks.write_daily_wide_csv(hours, path, days=DAYS)
    columns = ", ".join(f"`{s}` double" for s in dims.EXPORT_SITES)
    return p.spark.read.schema(f"datetime timestamp_ntz, {columns}, date date").csv(f"{path}/pm10", header=True)


@query("SELECT abrv, datetime, ws, wd, pm10 FROM p_hours")
def write_sorted_csv(p: Proxy):
    path = scratch_path(p.spark, "sorted")
    sinks.write_sorted_csv(p.hours.select("abrv", "datetime", "ws", "wd", "pm10"), path, ["datetime", "abrv"])
    schema = "abrv string, datetime timestamp_ntz, ws double, wd double, pm10 double"
    return p.spark.read.schema(schema).csv(path, header=True)


@query("""SELECT site_num, date_utc, hour_utc, code, "desc", value, units, CAST(event_id % 3 + 1 AS INTEGER) AS poc,
 CAST(year(date_utc) AS INTEGER) AS year
FROM p_measurement WHERE event_type <> 'view' AND site_num IN ('1001', '0021', '0022', '0025', '0026')""")
def write_stacked_aqs(p: Proxy):
    path = scratch_path(p.spark, "stacked")
    sinks.write_stacked_aqs(files.stack_aqs_hourly(p.spark, _bulk(p)), path)
    return p.spark.read.parquet(path)


@query("""SELECT e.date, e.abrv, e.pm10_avg, n.no_sites_exceeding, c.onlake, c.offlake FROM p_daily e
JOIN (SELECT date, count(*) AS no_sites_exceeding FROM p_daily WHERE pm10_avg >= 150 GROUP BY 1) n ON n.date = e.date
JOIN p_contribution c ON c.date = e.date AND c.abrv = e.abrv
WHERE e.pm10_avg >= 150""")
def write_report_tables(p: Proxy):
    path = scratch_path(p.spark, "report")
    hours = snapshot(p.classified, f"{path}/hours")
    sinks.write_report_tables(shoreline.report_tables(hours, p.site), path)
    read = p.spark.read.parquet
    table = read(f"{path}/site_table").join(
        p.site.select("abrv", F.when(F.col("abrv") == "OL", "Olancha*").otherwise(F.col("deployment")).alias("site")), "site")
    return (
        read(f"{path}/exceedances")
        .join(read(f"{path}/sites_per_day"), "date")
        .join(table.drop("site"), ["date", "abrv"])
        .select("date", "abrv", "pm10_avg", "no_sites_exceeding", "onlake", "offlake")
    )


WITHDRAWN = "2024-01-12"


@query(f"""SELECT e.date, e.abrv, e.pm10_avg, n.no_sites_exceeding, c.onlake, c.offlake, c.onlake + c.offlake AS shown, c.preliminary, r.hours
FROM p_daily e
JOIN (SELECT date, count(*) AS no_sites_exceeding FROM p_daily WHERE pm10_avg >= 150 GROUP BY 1) n ON n.date = e.date
JOIN p_contribution c ON c.date = e.date AND c.abrv = e.abrv
LEFT JOIN (SELECT date, abrv, CAST(count(*) AS BIGINT) AS hours FROM p_classified WHERE wd IS NOT NULL AND pm10 IS NOT NULL GROUP BY 1, 2) r
 ON r.date = e.date AND r.abrv = e.abrv
WHERE e.pm10_avg >= 150 AND e.date <> DATE '{WITHDRAWN}'""")
def publish_report_tables(p: Proxy):
    """The five report tables published at once, and again after validation has withdrawn one day's exceedances."""
    store = Published(p.spark, scratch_path(p.spark, "report"))
    hours = snapshot(p.classified, scratch_path(p.spark, "hours"))
    every = (dtm.date(2024, 1, 1), dtm.date(2024, 12, 31))
    shoreline.publish_report(store, hours, p.site, every)
    lower = F.when(F.col("date") == WITHDRAWN, F.col("pm10") / 1000).otherwise(F.col("pm10"))
    shoreline.publish_report(store, hours.withColumn("pm10", lower), p.site, every)
    read = {t: shoreline.read_report(store, t) for t in shoreline.REPORT}
    site = p.site.select("abrv", val.display_label("deployment").alias("site"))
    rose = read["roses"].groupBy("date", "abrv").agg(F.sum("hours").alias("hours"))
    return (
        read["exceedances"].join(read["sites_per_day"], "date")
        .join(read["site_table"].join(site, "site").drop("site"), ["date", "abrv"])
        .join(read["map_labels"].select("date", "abrv", F.col("pm10_avg").alias("shown"), "preliminary"), ["date", "abrv"])
        .join(rose, ["date", "abrv"], "left")
        .select("date", "abrv", "pm10_avg", "no_sites_exceeding", "onlake", "offlake", "shown", "preliminary", "hours")
    )
