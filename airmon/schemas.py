"""Schemas of landed files.  Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# ---- fixed values: published column layouts of the agency's files ----------------------------------

#: stacked hourly extract
AGENCY_HOURLY = T.StructType([
    T.StructField("site_num", T.StringType()),
    T.StructField("date_utc", T.DateType()),
    T.StructField("hour_utc", T.StringType()),
    T.StructField("code", T.IntegerType()),
    T.StructField("desc", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("units", T.StringType()),
])
#: stacked daily extract
AGENCY_DAILY = T.StructType([
    T.StructField("site_num", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("code", T.IntegerType()),
    T.StructField("desc", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("units", T.StringType()),
])
#: national bulk files, in file order
BULK_HOURLY = _strings((
    "State Code", "County Code", "Site Num", "Parameter Code", "POC", "Latitude", "Longitude", "Datum",
    "Parameter Name", "Date Local", "Time Local", "Date GMT", "Time GMT", "Sample Measurement",
    "Units of Measure", "MDL", "Uncertainty", "Qualifier", "Method Type", "Method Code", "Method Name",
    "State Name", "County Name", "Date of Last Change",
))
BULK_DAILY = _strings((
    "State Code", "County Code", "Site Num", "Parameter Code", "POC", "Latitude", "Longitude", "Datum",
    "Parameter Name", "Sample Duration", "Pollutant Standard", "Date Local", "Units of Measure",
    "Event Type", "Observation Count", "Observation Percent", "Arithmetic Mean", "1st Max Value",
    "1st Max Hour", "AQI", "Method Code", "Method Name", "Local Site Name", "Address", "State Name",
    "County Name", "City Name", "CBSA Name", "Date of Last Change",
))
#: API responses
API_JSON = _strings((
    "State Code", "County Code", "Site Num", "Parameter Code", "Date Local", "24 Hour Local", "Date GMT",
    "24 Hour GMT", "Sample Measurement", "Units",
))
API_CSV = _strings((
    "Site.Num", "Date.Local", "X24.Hour.Local", "Sample.Measurement", "Sample.Duration",
    "Method.Description",
))
END_OF_FILE = "END OF FILE"
#: met export with hour codes, and 5-minute flux export
HOUR_CODE_MET = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("ws_10m", T.DoubleType()),
    T.StructField("wd_10m", T.DoubleType()),
])
FLUX_5MIN = T.StructType([
    T.StructField("datetime", T.StringType()),
    T.StructField("csc", T.StringType()),
    T.StructField("sand_flux", T.DoubleType()),
    T.StructField("invalid", T.BooleanType()),
])
