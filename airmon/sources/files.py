"""Landed agency, workbook and instrument files.

Schemas are given, so no file is read twice to infer one, and Spark's CSV reader parses only the
columns a query uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from airmon import schemas
from airmon.dims import AGENCY_SITES, LOCAL_ZONE
from airmon.functions import timecol as tc
from airmon.functions.values import site_code
from airmon.operators.quality import method_filter, nan_to_null
from airmon.operators.reshape import normalise_names


def number(text: str) -> Column:
    """A number from text; NULL for what is none, such as ``NA`` or ``NaN``."""
    value = F.col(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def read_aqs_hourly(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AGENCY_HOURLY).csv(path, header=True)


def read_aqs_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AGENCY_DAILY).csv(path, header=True)


def _bulk(spark: SparkSession, path, schema: T.StructType, state: str, county: str, sites: Sequence[str]) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True).filter(
        (F.col("`State Code`") == state) & (F.col("`County Code`") == county) & F.col("`Site Num`").isin(list(sites)))


# fixed values: county and sites kept from the national files
STATE, COUNTY = "06", "027"
BULK_SITES = ("1001", "0021", "0022", "0025", "0026")


def stack_aqs_hourly(
    spark: SparkSession, path: str | list[str], state: str = STATE, county: str = COUNTY,
    sites: Sequence[str] = BULK_SITES,
) -> DataFrame:
    """Many national hourly files, filtered, projected and stacked in one scan.

    Five sites of one county by default.  ``poc`` tells instruments at one site apart.
    """
    return _bulk(spark, path, schemas.BULK_HOURLY, state, county, sites).select(
        F.col("`Site Num`").alias("site_num"),
        F.col("`Date GMT`").try_cast("date").alias("date_utc"),
        F.col("`Time GMT`").alias("hour_utc"),
        F.col("`Parameter Code`").try_cast("int").alias("code"),
        F.col("`Parameter Name`").alias("desc"),
        number("`Sample Measurement`").alias("value"),
        F.col("`Units of Measure`").alias("units"),
        F.col("POC").try_cast("int").alias("poc"),
    )


def stack_aqs_daily(
    spark: SparkSession, path: str | list[str], state: str = STATE, county: str = COUNTY,
    sites: Sequence[str] = BULK_SITES,
) -> DataFrame:
    return _bulk(spark, path, schemas.BULK_DAILY, state, county, sites).select(
        F.col("`Site Num`").alias("site_num"),
        F.col("`Date Local`").try_cast("date").alias("date"),
        F.col("`Parameter Code`").try_cast("int").alias("code"),
        F.col("`Parameter Name`").alias("desc"),
        number("`Arithmetic Mean`").alias("value"),
        F.col("`Units of Measure`").alias("units"),
    )


def read_aqs_json(spark: SparkSession, path: str | list[str], sites: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Landed API responses with cleaned names and local time.

    ``multi_line`` reads whole-file JSON arrays, one task per response; landing them as JSON lines
    keeps large files splittable.  An empty response holds only the end marker, which is dropped.
    """
    raw = spark.read.schema(schemas.API_JSON).json(path, multiLine=multi_line)
    rows = normalise_names(raw.filter(~F.col(f"`{raw.columns[0]}`").eqNullSafe(schemas.END_OF_FILE)))
    if sites is not None:
        rows = rows.filter(F.col("site_num").isin(list(sites)))
    utc = tc.local_from_parts("date_gmt", "24_hour_gmt")
    return rows.withColumn("datetime", tc.utc_to_local(utc))


def read_aqs_api_csv(
    spark: SparkSession, path: str | list[str], sites: dict[str, str] = AGENCY_SITES, pattern: str = "TEOM",
) -> DataFrame:
    """Landed yearly CSV responses: TEOM methods of known sites, in local time."""
    rows = normalise_names(spark.read.schema(schemas.API_CSV).csv(path, header=True))
    return (
        method_filter(rows, pattern)
        .withColumn("site_num", F.lpad("site_num", 4, "0"))
        .filter(F.col("site_num").isin(list(sites.values())))
        .select(
            site_code("site_num", sites).alias("abrv"),
            "site_num",
            number("sample_measurement").alias("pm10"),
            "sample_duration",
            tc.local_from_parts("date_local", "x24_hour_local").alias("datetime"),
        )
        .withColumn("date", tc.hour_ending_date("datetime"))
        .withColumn("year", F.year("date"))
    )


def agency_long(hourly: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Stacked hourly rows with site code, UTC and local time and hour-ending date; unknown sites go."""
    return (
        hourly.withColumn("abrv", site_code("site_num", AGENCY_SITES))
        .filter(F.col("abrv").isNotNull())
        .withColumn("datetime_utc", tc.local_from_parts("date_utc", "hour_utc"))
        .withColumn("datetime", tc.utc_to_local("datetime_utc", zone))
        .withColumn("date", tc.hour_ending_date("datetime"))
    )


def read_wide_workbook(spark: SparkSession, path: str, columns: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """A wide sheet exported as CSV: serial date, hour code, then one column per site or variable.

    ``columns`` names the file's columns in order.  Preamble and heading lines have neither a number nor a date
    in the date column, which tells them from data wherever a file split begins.  A serial may be exported
    as ``41000``, ``41000.0`` or a date; other cells that hold no number are NULL.
    """
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path, header=False)
    kept = list(keep) if keep else list(columns)
    ids = [c for c in ("date", "hour") if c in kept]
    # fixed value: day 0 of the serial calendar
    serial = F.coalesce(F.floor(number("date")), F.date_diff(F.col("date").try_cast("date"), F.lit("1899-12-30").cast("date")))
    whole = {"date": serial, "hour": F.floor(number("hour")) if "hour" in columns else F.lit(None)}
    return raw.filter(serial.isNotNull()).select(
        *[whole[c].cast("int").alias(c) for c in ids],
        *[number(c).alias(c) for c in kept if c not in ids],
    )


def read_hour_code_csv(spark: SparkSession, path: str) -> DataFrame:
    """Met hours keyed by date and hour code; dates come with four- or two-digit years."""
    raw = spark.read.schema(schemas.HOUR_CODE_MET).csv(path, header=True)
    # fixed values: the two date formats
    day = F.coalesce(
        F.try_to_timestamp("date", F.lit("M/d/yyyy")), F.try_to_timestamp("date", F.lit("M/d/yy"))).cast("date")
    return nan_to_null(raw.select(
        tc.hour_code_to_datetime(day, "hour").alias("datetime"), "ws_10m", "wd_10m"))


def read_flux_csv(spark: SparkSession, path: str) -> DataFrame:
    """5-minute flux with local times."""
    raw = spark.read.schema(schemas.FLUX_5MIN).csv(path, header=True)
    # fixed value: time format of the export
    t = F.try_to_timestamp("datetime", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return nan_to_null(raw.withColumn("datetime", t))
