"""Daily shoreline report: reconcile, find exceedance days, attribute them by wind sector."""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import Column, DataFrame, Window, functions as F

from airmon.dims import DUST_BREAKS, STANDARD
from airmon.functions import values as val
from airmon.operators import aggregate as agg, direction, exceedance as exc, quality as qc, reconcile as rec
from airmon.sources.published import Published


def exceeding_sites_per_day(readings: DataFrame, order: str, threshold: float = STANDARD) -> DataFrame:
    """Flagship: exceedance days and how many sites exceed on each.

    ``readings`` is the union of both sources before de-duplication.  Three exchanges, each of rows
    already combined in the map tasks: site-hours, site-days, days.
    """
    hours = rec.reconcile_hours(qc.qc_bounds(qc.sentinel_to_null(readings)), order)
    daily = agg.best_source_daily_avg(hours)
    return agg.sites_exceeding_per_day(daily.filter(daily["pm10_avg"] >= threshold))


def report_hours(validated: DataFrame, preliminary: DataFrame, sectors: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """De-mixed hours of both sources with their direction class.

    The class is the one the sources carry, or is worked out anew when ``sectors`` are given.
    """
    hours = qc.drop_mixed_preliminary(rec.reconcile_sources(validated, preliminary))
    if sectors is not None:
        hours = direction.classify_onlake(hours, sectors)
    else:
        hours = hours.withColumn("onlake", hours["onlake_wd"])
    return rec.override_direction(hours, overrides) if overrides is not None else hours


def report_tables(hours: DataFrame, sites: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """All days of the report at once, keyed by date.

    The tables share ``hours``: pass a snapshot of it, as each table is a query of its own.  ``strict`` leaves
    site-days without any known direction out of the site table and the labels.
    """
    breakdown = exc.site_day_breakdown(hours, strict=strict)
    exceeding = exc.exceedances(hours)
    # one row per calendar day, a proven bound: the hours need not move to find theirs
    days = F.broadcast(exceeding.select("date").distinct())
    return {
        "exceedances": exceeding,
        "sites_per_day": agg.sites_exceeding_per_day(exceeding),
        "site_table": exc.exceed_site_table(breakdown, sites),
        "map_labels": exc.daily_map_labels(breakdown.join(days, "date", "left_semi"), sites),
        "roses": direction.rose_table(hours.join(days, "date", "left_semi"), breaks=DUST_BREAKS),
    }


#: The columns of each table of :func:`report_rows`, without the date.
REPORT = {
    "exceedances": "abrv string, pm10_avg double",
    "sites_per_day": "no_sites_exceeding long",
    "site_table": "site string, onlake double, offlake double",
    "map_labels": "abrv string, deployment string, x double, y double, y_offset int, pm10_avg double, flag_color string, preliminary boolean",
    "roses": "abrv string, sector int, class int, hours long, label string, share double",
}


def report_rows(hours: DataFrame, sites: DataFrame, strict: bool = False, threshold: float = STANDARD) -> DataFrame:
    """All tables of :func:`report_tables` as one: (table, date, every table's columns), others' columns NULL.

    One scan and one exchange, by date: hours are summed by site-day, compass sector and value class; site-days and days
    are sums over these cells, in windows of one day of the network, and each row is tagged with the tables it is in.
    """
    cell = ["date", "abrv", "sector", "class"]
    at = hours.select(
        "date", "abrv", val.compass_sector("wd").alias("sector"), val.value_class("pm10", DUST_BREAKS).alias("class"), "pm10", "onlake", "valid")

    def total(hit: Column) -> Column:
        return F.coalesce(F.sum(F.when(hit, F.col("pm10"))), F.lit(0.0))

    cells = at.repartition("date").groupBy(*cell).agg(
        F.count(F.lit(1)).alias("hours"), F.count("pm10").alias("read"), F.sum("pm10").alias("sum"), F.count("onlake").alias("known"),
        total(F.col("onlake")).alias("on"), total(~F.col("onlake")).alias("off"), F.max(~F.col("valid")).alias("prelim"))
    of_site, of_day = Window.partitionBy("date", "abrv"), Window.partitionBy("date")
    in_rose = F.col("sector").isNotNull() & F.col("class").isNotNull()
    days = cells.withColumns({
        "first": F.row_number().over(of_site.orderBy("sector", "class")) == 1,
        "mean": val.steady(F.try_divide(F.sum("sum").over(of_site), F.sum("read").over(of_site))),
        "n": F.sum("hours").over(of_site), "some": F.sum("known").over(of_site) > 0,
        "on": F.sum("on").over(of_site), "off": F.sum("off").over(of_site),
        "preliminary": F.max("prelim").over(of_site),
        "whole": F.sum(F.when(in_rose, F.col("hours"))).over(of_site),
    }).withColumns({
        "sites": F.count_if(F.col("first") & (F.col("mean") >= threshold)).over(of_day),
        "opens": F.row_number().over(of_day.orderBy("abrv", "sector", "class")) == 1,
        "onlake": F.when(F.col("some"), val.half_even(F.col("on") / F.col("n"))),
        "offlake": F.when(F.col("some"), val.half_even(F.col("off") / F.col("n"))),
    }).withColumn("shown", F.bround(F.col("onlake") + F.col("offlake"), 0))
    labelled = F.col("first") & (F.lit(not strict) | F.col("shown").isNotNull())
    within = F.col("sites") > 0
    tags = {
        "exceedances": F.col("first") & (F.col("mean") >= threshold), "sites_per_day": F.col("opens") & within,
        "site_table": labelled & (F.bround("mean", 0) >= threshold), "map_labels": labelled & within, "roses": in_rose & within}
    tagged = days.withColumn("table", F.explode(F.array_compact(F.array(*(F.when(hit, F.lit(t)) for t, hit in tags.items())))))
    tagged = tagged.join(sites.select("abrv", "deployment", "x", "y"), "abrv", "left")
    made = {
        "pm10_avg": F.when(F.col("table") == "map_labels", F.col("shown")).otherwise(F.col("mean")), "no_sites_exceeding": F.col("sites"),
        "site": val.display_label("deployment"), "onlake": F.bround("onlake", 0), "offlake": F.bround("offlake", 0),
        "y_offset": exc.label_offset(), "flag_color": val.flag_color("shown"), "label": val.class_label("class", DUST_BREAKS),
        "share": val.steady(F.col("hours") / F.col("whole"))}
    owners: dict[str, list[str]] = {}
    for table, columns in REPORT.items():
        for c in columns.split(", "):
            owners.setdefault(c.split()[0], []).append(table)
    return tagged.select("table", "date", *(F.when(F.col("table").isin(t), made.get(c, F.col(c))).alias(c) for c, t in owners.items()))


def publish_report(
    store: Published, hours: DataFrame, sites: DataFrame, covers: tuple[dtm.date, dtm.date], strict: bool = False,
) -> int:
    """Publish all report tables of the days from first to last at once; the version they are in.

    A day that had an exceedance and has none now is withdrawn from every table by the same switch.
    """
    rows = report_rows(hours.filter(F.col("date").between(*covers)), sites, strict)
    return store.write(rows, {t: covers for t in REPORT}, dealt=True)


def read_report(store: Published, table: str) -> DataFrame:
    return store.read(table, REPORT[table])
