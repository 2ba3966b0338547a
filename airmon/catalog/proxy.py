"""Monitoring tables derived from the given tables, in Spark and in SQL.

``events`` stand for hourly readings of nine sites in January 2024, unclean on purpose: several
readings per site-hour, missing directions and sentinels, both sources.  ``orders`` stand for a
multi-year wind record.  ``VIEWS`` holds the same definitions in SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from airmon import dims
from airmon.functions import values as val
from airmon.operators import direction, quality as qc, reconcile as rec
from airmon.operators.calendar import with_hour, with_hour_ending_date
from airmon.session import scratch_path

SITES = ("DS", "SC", "ST", "NB", "LT", "OL", "MS", "LP", "KE")
UNKNOWN_AGENCY_SITE = "0099"
NAMES = {81102: "PM10", 61101: "Wind Speed - Scalar", 61102: "Wind Direction - Scalar",
         61103: "Wind Speed - Resultant", 61104: "Wind Direction - Resultant"}


# given, so that opening a table reads no footers
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
}


class Proxy:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def land(self, df: DataFrame, fmt: str, name: str, **options) -> str:
        """Write a derived table as files of the kind a reader expects."""
        path = scratch_path(self.spark, name)
        df.write.format(fmt).options(**options).save(path)
        return path

    @cached_property
    def site(self) -> DataFrame:
        n = range(len(SITES))
        return dims.local_table(self.spark, {
            "site_id": pa.array(n, pa.int32()),
            "abrv": list(SITES),
            "deployment": [dims.DEPLOYMENTS[s] for s in SITES],
            "prelim": [dims.PRELIMINARY_NAMES[s] for s in SITES],
            "validated": [dims.VALIDATED_NAMES[s] for s in SITES],
            "site_num": [dims.AGENCY_SITES.get(s, UNKNOWN_AGENCY_SITE) for s in SITES],
            "from_deg": [dims.ONLAKE_SECTORS[s][0] for s in SITES],
            "to_deg": [dims.ONLAKE_SECTORS[s][1] for s in SITES],
            "x": [405000.0 + 2500 * i for i in n],
            "y": [4013000.0 + 4000 * i for i in n],
        })

    @cached_property
    def sectors(self) -> DataFrame:
        return dims.sector_table(self.spark)

    @cached_property
    def deployments(self) -> DataFrame:
        return self.site.select(F.col("site_id").alias("deployment_id"), "deployment", "abrv", "x", "y")

    # ---- events -----------------------------------------------------------------------------------

    @cached_property
    def obs(self) -> DataFrame:
        e = with_hour(self.table("events"), "ts", "datetime", end=True)
        day = F.day("ts") % 5
        return e.join(self.site, F.col("user_id") % 9 == F.col("site_id")).select(
            "event_id", "event_type", F.col("site_id").alias("deployment_id"), "abrv", "deployment",
            "prelim", "validated", "site_num", "x", "y",
            "datetime",
            (F.col("value") / 10).alias("ws"),
            F.when(F.col("event_id") % 11 != 0, ((F.col("event_id") * 37) % 360).cast("double")).alias("wd"),
            F.when(F.col("event_id") % 97 == 0, dims.SENTINEL).otherwise(F.col("value") * 3).alias("pm10"),
            (((F.col("event_id") % 2 == 0) | (day == 1)) & (day != 0)).alias("valid"),
            "from_deg", "to_deg",
        ).withColumn("onlake_wd", val.angle_between("wd", "from_deg", "to_deg")).drop("from_deg", "to_deg")

    @cached_property
    def readings(self) -> DataFrame:
        """Quality-controlled readings of both sources, still several per site-hour."""
        cols = ("event_id", "abrv", "datetime", "ws", "wd", "pm10", "onlake_wd", "valid")
        clean = qc.qc_bounds(qc.sentinel_to_null(self.obs.select(*cols)))
        return with_hour_ending_date(clean)

    def source(self, valid: bool) -> DataFrame:
        """One source, one row per site-hour."""
        rows = self.readings.filter(F.col("valid") if valid else ~F.col("valid"))
        return qc.dedup_site_hour(rows, ["event_id"])

    @cached_property
    def hours(self) -> DataFrame:
        return rec.reconcile_hours(self.readings, "event_id")

    @cached_property
    def demixed(self) -> DataFrame:
        return qc.drop_mixed_preliminary(self.hours)

    @cached_property
    def classified(self) -> DataFrame:
        return direction.classify_dunes(direction.classify_onlake(self.demixed, self.sectors))

    @cached_property
    def preliminary_table(self) -> DataFrame:
        return self.obs.filter(~F.col("valid")).select(
            "event_id", "deployment_id", "datetime", F.col("prelim").alias("site"), F.col("ws").alias("aspd"),
            F.col("wd").alias("dir"), F.col("pm10").alias("teom"), F.col("onlake_wd").alias("from_lake"))

    @cached_property
    def validated_table(self) -> DataFrame:
        return self.obs.filter("valid").select(
            "event_id", "deployment_id", "datetime", F.col("validated").alias("site"), "ws", "wd", "pm10", "onlake_wd")

    @cached_property
    def met_table(self) -> DataFrame:
        """One met row per deployment-hour."""
        rows = self.obs.select("event_id", "deployment_id", "datetime", "ws", "wd")
        return qc.dedup_site_hour(rows, ["event_id"], ["deployment_id", "datetime"]).select(
            "deployment_id", "datetime", F.col("ws").alias("ws_10m"), F.col("wd").alias("wd_10m"))

    @cached_property
    def measurement(self) -> DataFrame:
        code = F.when(F.col("event_id") % 5 == 0, 81102)
        for i, c in enumerate((61101, 61102, 61103, 61104), start=1):
            code = code.when(F.col("event_id") % 5 == i, c)
        hour = F.col("datetime_utc")
        return with_hour(self.table("events"), "ts", "datetime_utc").join(self.site, F.col("user_id") % 9 == F.col("site_id")).select(
            "event_id", "event_type", "abrv", "site_num", hour, hour.cast("date").alias("date_utc"),
            F.concat(F.lpad(F.hour(hour).cast("string"), 2, "0"), F.lit(":00")).alias("hour_utc"),
            code.alias("code"), val.lookup(code.cast("string"), {str(k): v for k, v in NAMES.items()}).alias("desc"),
            "value", F.lit("units").alias("units"))

    @cached_property
    def sensor(self) -> DataFrame:
        return self.table("events").select(
            "event_id", (F.col("user_id") % 9).cast("int").alias("deployment_id"), F.col("ts").alias("datetime"),
            F.col("value").alias("sumpc"))

    @cached_property
    def periods(self) -> DataFrame:
        """Weekly collections."""
        day = F.col("datetime").cast("date")
        monday = F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")
        week = self.sensor.groupBy("deployment_id", monday.alias("start_datetime")).agg(
            val.steady(F.sum("sumpc")).alias("total"))
        d = F.col("deployment_id")
        return week.select(
            d.alias("sensit_deployment_id"), (d + 100).alias("csc_deployment_id"), "start_datetime",
            (F.col("start_datetime") + F.expr("INTERVAL 7 DAY")).alias("collection_datetime"),
            F.when(d == 4, 0.0).otherwise(F.col("total")).alias("sumpc_total"),
            F.when(d % 2 == 0, 12.0).alias("dwp_mass"), F.when(d != 7, 8.0).alias("district_mass"))

    @cached_property
    def collectors(self) -> DataFrame:
        return self.site.select(
            (F.col("site_id") + 100).alias("deployment_id"), F.concat(F.lit("csc-"), "abrv").alias("deployment"))

    @cached_property
    def flags(self) -> DataFrame:
        """An error opens a flag for an hour: field 116 after even events, 117 after odd ones, and always 90."""
        hit = self.table("events").filter(F.col("event_type") == "error").select(
            (F.col("user_id") % 9).cast("int").alias("deployment_id"),
            F.explode(F.array(F.lit(90), F.when(F.col("event_id") % 2 == 0, 116).otherwise(117))).alias("field_id"),
            F.col("ts").alias("start_datetime"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end_datetime"))
        return hit

    # ---- orders -----------------------------------------------------------------------------------

    @cached_property
    def record(self) -> DataFrame:
        o = self.table("orders")
        k = F.col("o_orderkey")
        return with_hour_ending_date(o.join(self.site, F.col("o_custkey") % 9 == F.col("site_id")).select(
            k.alias("row_id"), "abrv", F.col("prelim").alias("deployment"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 24 + 1).cast("int"))).alias("datetime"),
            F.when(k % 13 != 0, (k % 97).cast("double") / 8).alias("ws"),
            F.when(k % 11 != 0, ((k * 37) % 360).cast("double")).alias("wd"),
            (F.col("o_totalprice") / 1000).alias("pm10"),
        ))


def _values() -> str:
    rows = []
    for i, s in enumerate(SITES):
        lo, hi = dims.ONLAKE_SECTORS[s]
        rows.append(
            f"({i}, '{s}', '{dims.DEPLOYMENTS[s]}', '{dims.PRELIMINARY_NAMES[s]}', '{dims.VALIDATED_NAMES[s]}', "
            f"'{dims.AGENCY_SITES.get(s, UNKNOWN_AGENCY_SITE)}', {lo}, {hi}, {405000.0 + 2500 * i}, {4013000.0 + 4000 * i})")
    return ",\n ".join(rows)


def in_sector(wd: str, lo: str, hi: str) -> str:
    return (f"CASE WHEN {lo} < {hi} THEN {wd} BETWEEN {lo} AND {hi} "
            f"ELSE {wd} BETWEEN {lo} AND 360 OR {wd} BETWEEN 0 AND {hi} END")


def conditional_means(source: str) -> str:
    return f"""SELECT date, abrv,
 round_even(round(avg(pm10), 6), 0) AS pm10_24, count(pm10) AS n,
 round_even(round(avg(pm10) FILTER (WHERE onlake), 6), 0) AS pm10_onlake, count(pm10) FILTER (WHERE onlake) AS n_onlake,
 round_even(round(avg(pm10) FILTER (WHERE dunes), 6), 0) AS pm10_dunes, count(pm10) FILTER (WHERE dunes) AS n_dunes,
 round_even(round(avg(pm10) FILTER (WHERE NOT onlake), 6), 0) AS pm10_offlake,
 count(pm10) FILTER (WHERE NOT onlake) AS n_offlake
FROM {source} GROUP BY 1, 2"""


def exceeding_only(source: str) -> str:
    return f"""SELECT date, abrv, pm10_24, n, coalesce(pm10_onlake, 0) AS pm10_onlake, n_onlake,
 coalesce(pm10_dunes, 0) AS pm10_dunes, n_dunes, coalesce(pm10_offlake, 0) AS pm10_offlake, n_offlake
FROM {source} WHERE pm10_24 >= 150"""


VIEWS: dict[str, str] = {
    "p_site": f"""SELECT site_id, abrv, deployment, prelim, validated, site_num,
 CAST(from_deg AS DOUBLE) AS from_deg, CAST(to_deg AS DOUBLE) AS to_deg, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y
FROM (VALUES
 {_values()}
) AS t(site_id, abrv, deployment, prelim, validated, site_num, from_deg, to_deg, x, y)""",
    "p_obs": f"""SELECT e.*, {in_sector("wd", "from_deg", "to_deg")} AS onlake_wd FROM (
SELECT event_id, event_type, site_id AS deployment_id, abrv, deployment, prelim, validated, site_num, x, y, from_deg, to_deg,
 date_trunc('hour', ts) + INTERVAL 1 HOUR AS datetime,
 value / 10 AS ws,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id * 37) % 360 AS DOUBLE) END AS wd,
 CASE WHEN event_id % 97 = 0 THEN CAST(-9999 AS DOUBLE) ELSE value * 3 END AS pm10,
 (event_id % 2 = 0 OR day(ts) % 5 = 1) AND day(ts) % 5 <> 0 AS valid
FROM events JOIN p_site ON user_id % 9 = site_id) e""",
    "p_readings": """SELECT *, CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date FROM p_obs
WHERE pm10 > -15""",
    "p_source": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY valid, abrv, datetime ORDER BY event_id) AS rn
FROM p_readings) WHERE rn = 1""",
    "p_hours": """SELECT coalesce(v.abrv, p.abrv) AS abrv, coalesce(v.datetime, p.datetime) AS datetime,
 coalesce(v.date, p.date) AS date, coalesce(v.ws, p.ws) AS ws, coalesce(v.wd, p.wd) AS wd,
 coalesce(v.pm10, p.pm10) AS pm10, coalesce(v.onlake_wd, p.onlake_wd) AS onlake_wd, coalesce(v.valid, p.valid) AS valid
FROM (SELECT * FROM p_source WHERE valid) v
FULL JOIN (SELECT * FROM p_source WHERE NOT valid) p ON v.abrv = p.abrv AND v.datetime = p.datetime""",
    "p_demixed": """SELECT * EXCLUDE (any_valid) FROM (
 SELECT *, bool_or(valid) OVER (PARTITION BY date, abrv) AS any_valid FROM p_hours) WHERE valid OR NOT any_valid""",
    "p_classified": f"""SELECT d.*, {in_sector("wd", "from_deg", "to_deg")} AS onlake,
 wd BETWEEN 296 AND 337 AND d.abrv = 'KE' AS dunes
FROM p_demixed d JOIN p_site s ON d.abrv = s.abrv""",
    "p_met": """SELECT deployment_id, deployment, datetime, ws AS ws_10m, wd AS wd_10m FROM (
 SELECT *, row_number() OVER (PARTITION BY deployment_id, datetime ORDER BY event_id) AS rn FROM p_obs) WHERE rn = 1""",
    "p_measurement": """SELECT *, CASE code WHEN 81102 THEN 'PM10' WHEN 61101 THEN 'Wind Speed - Scalar'
 WHEN 61102 THEN 'Wind Direction - Scalar' WHEN 61103 THEN 'Wind Speed - Resultant'
 ELSE 'Wind Direction - Resultant' END AS "desc", 'units' AS units,
 strftime(datetime_utc, '%H:00') AS hour_utc, CAST(datetime_utc AS DATE) AS date_utc FROM (
SELECT event_id, event_type, abrv, site_num, date_trunc('hour', ts) AS datetime_utc,
 CAST(CASE event_id % 5 WHEN 0 THEN 81102 WHEN 1 THEN 61101 WHEN 2 THEN 61102 WHEN 3 THEN 61103 ELSE 61104 END AS INTEGER) AS code,
 value FROM events JOIN p_site ON user_id % 9 = site_id)""",
    "p_sensor": "SELECT event_id, CAST(user_id % 9 AS INTEGER) AS deployment_id, ts AS datetime, value AS sumpc FROM events",
    "p_csc": """SELECT deployment_id AS sensit_deployment_id, deployment_id + 100 AS csc_deployment_id,
 CAST(date_trunc('week', datetime) AS TIMESTAMP) AS start_datetime,
 CAST(date_trunc('week', datetime) AS TIMESTAMP) + INTERVAL 7 DAY AS collection_datetime,
 CASE WHEN deployment_id = 4 THEN 0 ELSE round(sum(sumpc), 6) END AS sumpc_total,
 CASE WHEN deployment_id % 2 = 0 THEN CAST(12 AS DOUBLE) END AS dwp_mass,
 CASE WHEN deployment_id = 7 THEN NULL ELSE CAST(8 AS DOUBLE) END AS district_mass
FROM p_sensor GROUP BY 1, 2, 3, 4, deployment_id""",
    "p_flag": """SELECT CAST(user_id % 9 AS INTEGER) AS deployment_id, f.field_id, ts AS start_datetime,
 ts + INTERVAL 1 HOUR AS end_datetime
FROM events, unnest([90, CASE WHEN event_id % 2 = 0 THEN 116 ELSE 117 END]) AS f(field_id) WHERE event_type = 'error'""",
    "p_flux": """SELECT s.event_id, s.datetime, s.deployment_id, s.sumpc, c.* ,
 CASE WHEN sumpc_total > 0 THEN (sumpc / sumpc_total) * (coalesce(dwp_mass, district_mass) / 1.2) ELSE 0 END AS sand_flux
FROM p_sensor s JOIN p_csc c ON c.sensit_deployment_id = s.deployment_id
 AND s.datetime > c.start_datetime AND s.datetime <= c.collection_datetime
WHERE coalesce(dwp_mass, district_mass) IS NOT NULL""",
    "p_record": """SELECT *, CAST(datetime - INTERVAL 1 SECOND AS DATE) AS date FROM (
SELECT o_orderkey AS row_id, abrv, prelim AS deployment,
 o_orderdate + CAST(o_orderkey % 24 + 1 AS INTEGER) * INTERVAL 1 HOUR AS datetime,
 CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 97 AS DOUBLE) / 8 END AS ws,
 CASE WHEN o_orderkey % 11 <> 0 THEN CAST((o_orderkey * 37) % 360 AS DOUBLE) END AS wd,
 o_totalprice / 1000 AS pm10
FROM orders JOIN p_site ON o_custkey % 9 = site_id)""",
    "p_conditional": conditional_means("p_classified"),
    "p_exceeding": exceeding_only("p_conditional"),
    "p_contribution": """SELECT date, abrv, n, hrs_onlake, hrs_offlake, preliminary, daily_avg,
 CASE WHEN hrs_onlake + hrs_offlake > 0 THEN round_even(round(coalesce(on_sum, 0) / n, 6), 0) END AS onlake,
 CASE WHEN hrs_onlake + hrs_offlake > 0 THEN round_even(round(coalesce(off_sum, 0) / n, 6), 0) END AS offlake
FROM (SELECT date, abrv, count(*) AS n, sum(pm10) FILTER (WHERE onlake) AS on_sum, sum(pm10) FILTER (WHERE NOT onlake) AS off_sum,
 count(*) FILTER (WHERE onlake) AS hrs_onlake, count(*) FILTER (WHERE NOT onlake) AS hrs_offlake,
 bool_or(NOT valid) AS preliminary, round_even(round(avg(pm10), 6), 0) AS daily_avg
FROM p_classified GROUP BY 1, 2)""",
    "p_daily": """SELECT date, abrv, round(avg(pm10), 6) AS pm10_avg FROM p_demixed GROUP BY 1, 2""",
}


def with_views(sql: str) -> str:
    """Prefix a statement with the views it uses, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bp_[a-z]+\b", text):
            if name in VIEWS and name not in needed:
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    return f"WITH {ctes}\n{sql}" if ctes else sql
