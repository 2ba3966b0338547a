"""Historical workbook spliced with live hours, then backfilled and classified exceedances."""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import DataFrame, functions as F

from airmon.dims import RENAMED_SITES, STANDARD
from airmon.functions import timecol as tc
from airmon.functions.values import recode
from airmon.operators import aggregate as agg, direction, exceedance as exc, quality as qc, reconcile as rec, reshape
from airmon.session import scratch_path
from airmon.sources.snapshot import snapshot


def workbook_hours(
    teom_sheet: DataFrame, met_sheet: DataFrame, reference: DataFrame | None = None, start_year: int | None = None,
    reference_year: int | None = None,
) -> DataFrame:
    """Two wide sheets (serial date, hour code) to gap-filled hours (abrv, datetime, pm10, ws, wd).

    Hours before ``start_year`` are left out before gaps are filled; of the reference station only ``reference_year`` is used.
    """
    sites = [c for c in teom_sheet.columns if c not in ("date", "hour")]
    teom = reshape.unpivot_sites(teom_sheet, sites).withColumn("abrv", recode("abrv", RENAMED_SITES))
    met = reshape.unpivot_site_variables(met_sheet).withColumn("abrv", recode("abrv", RENAMED_SITES))
    # sentinels only in readings: the keys of the join are dates and hour codes
    both = qc.sentinel_to_null(teom.join(met, ["date", "hour", "abrv"], "left"))
    hours = both.select(
        "abrv",
        tc.hour_code_to_datetime(tc.excel_serial_date("date"), "hour").alias("datetime"),
        F.col("teom").alias("pm10"), "ws", "wd",
    )
    if start_year is not None:
        # by hour-ending time: the year's first midnight belongs to the year before
        hours = hours.filter(F.col("datetime") > tc.ntz(dtm.datetime(start_year, 1, 1)))
    # the gap filling reads its rows three times
    filled = rec.gap_fill_from_neighbour(snapshot(hours, scratch_path(hours.sparkSession, "workbook")))
    if reference is not None:
        if reference_year is not None:
            reference = reference.filter(F.col("datetime").between(
                tc.ntz(dtm.datetime(reference_year, 1, 1)), tc.ntz(dtm.datetime(reference_year, 12, 31, 23, 59, 59))))
        filled = rec.gap_fill_from_reference(filled, reference)
    return filled.filter(F.col("pm10").isNotNull())


def attributed_days(hours: DataFrame, sectors: DataFrame, threshold: float = STANDARD) -> DataFrame:
    """Exceeding site-days with sector means backfilled to 24 h and an event class."""
    labelled = direction.classify_dunes(direction.classify_onlake(hours, sectors))
    daily = agg.sector_conditional_means(labelled.withColumn("date", tc.hour_ending_date("datetime")))
    return exc.attribute_exceedances(exc.exceeding_days(daily, threshold=threshold))


def spliced_hours(workbook: DataFrame, live: DataFrame, sites: DataFrame, cutover) -> DataFrame:
    """The workbook's hours before a day and live hours (abrv, datetime, pm10, ws, wd) from it, each with its site's place.

    An hour of either source counts once; sites without an entry keep their hours, without a place.
    """
    columns = ("abrv", "datetime", "pm10", "ws", "wd")
    both = rec.history_live_splice(workbook.select(*columns), live.select(*columns), cutover)
    return rec.attach_site(qc.first_by(both, ["abrv", "datetime"], ["pm10", "ws", "wd"]), sites.select("abrv", "deployment", "x", "y"))
