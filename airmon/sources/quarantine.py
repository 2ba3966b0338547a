"""Landed rows that do not hold what they should: named, counted and kept apart on the pass that lands the others.

Files are read as text.  A check looks at one cell; a row with any fault goes to the quarantine with all its cells, its
file and its reasons, instead of turning into a row with a NULL nobody asks about.  An empty cell and one that says that
a value is missing (``NA``, ``NaN``) are no faults where a value may be missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from airmon import schemas

#: What cells of a row the parser could not place, and where the row came from.
RECORD, FILE, REASONS = "_record", "_file", "_reasons"
MISSING = ("", "NA", "NaN")


@dataclass(frozen=True)
class Check:
    """A cell and what it must be; ``kind`` is one of KINDS."""

    column: str
    kind: str
    required: bool = True


def _time(text: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in patterns))


#: Conditions that hold for a good cell.
KINDS = {
    "number": lambda c: c.try_cast("double").isNotNull() & ~F.isnan(c.try_cast("double")),
    "whole": lambda c: c.try_cast("bigint").isNotNull(),
    "date": lambda c: c.try_cast("date").isNotNull(),
    "clock": lambda c: c.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9]$"),
    "hour code": lambda c: c.try_cast("int").between(100, 2400) & (c.try_cast("int") % 100 == 0),
    "serial or date": lambda c: c.try_cast("double").isNotNull() | c.try_cast("date").isNotNull(),
    # fixed values: the two date formats of the met export and the time format of the flux export
    "short date": lambda c: _time(c, "M/d/yyyy", "M/d/yy").isNotNull(),
    "local time": lambda c: _time(c, "yyyy-MM-dd HH:mm:ss").isNotNull(),
    "truth": lambda c: F.lower(c).isin("true", "false"),
    "site": lambda c: c.rlike(r"^[0-9]{1,4}$"),
}

#: Of each kind of landed file: its columns, how it is read, and what its cells must be.
LAYOUTS: Mapping[str, tuple[T.StructType, str, Sequence[Check]]] = {
    "bulk_hourly": (schemas.BULK_HOURLY, "csv", (
        Check("Site Num", "site"), Check("Date GMT", "date"), Check("Time GMT", "clock"), Check("Parameter Code", "whole"),
        Check("Sample Measurement", "number", False), Check("POC", "whole", False))),
    "bulk_daily": (schemas.BULK_DAILY, "csv", (
        Check("Site Num", "site"), Check("Date Local", "date"), Check("Parameter Code", "whole"), Check("Arithmetic Mean", "number", False))),
    "api_json": (schemas.API_JSON, "json", (
        Check("Site Num", "site"), Check("Date GMT", "date"), Check("24 Hour GMT", "clock"), Check("Sample Measurement", "number", False))),
    "api_csv": (schemas.API_CSV, "csv", (
        Check("Site.Num", "site"), Check("Date.Local", "date"), Check("X24.Hour.Local", "clock"), Check("Sample.Measurement", "number", False))),
    "met": (schemas.HOUR_CODE_MET, "csv", (
        Check("date", "short date"), Check("hour", "hour code"), Check("ws_10m", "number", False), Check("wd_10m", "number", False))),
    "flux": (schemas.FLUX_5MIN, "csv", (
        Check("datetime", "local time"), Check("sand_flux", "number", False), Check("invalid", "truth", False))),
}


def workbook_layout(columns: Sequence[str]) -> tuple[T.StructType, str, Sequence[Check]]:
    """A wide sheet: date, hour code and readings.  Its preamble and headings are lines of faults, too."""
    names = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return names, "csv", (Check("date", "serial or date"), Check("hour", "hour code"), *(
        Check(c, "number", False) for c in columns if c not in ("date", "hour")))


def reason(check: Check, missing: bool = False) -> str:
    return f"{check.column}: missing" if missing else f"{check.column}: no {check.kind}"


def checked(spark: SparkSession, path: str | list[str], layout: tuple[T.StructType, str, Sequence[Check]], header: bool = True) -> DataFrame:
    """Landed rows as text with ``_file``, the parser's ``_record`` if it could not place the cells, and ``_reasons``."""
    columns, fmt, checks = layout
    text = T.StructType([*(T.StructField(f.name, T.StringType()) for f in columns), T.StructField(RECORD, T.StringType())])
    reader = spark.read.schema(text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).format(fmt)
    raw = (reader.option("header", header) if fmt == "csv" else reader).load(path)
    faults = [F.when(F.col(RECORD).isNotNull(), F.lit("record: no row of this layout"))]
    for c in checks:
        cell = F.trim(F.col(f"`{c.column}`"))
        empty = cell.isNull() | cell.isin(*MISSING)
        good = F.coalesce(KINDS[c.kind](cell), F.lit(False))
        faults.append(F.when(~empty & ~good, F.lit(reason(c))).when(empty & F.lit(c.required), F.lit(reason(c, True))))
    return raw.withColumns({FILE: F.col("_metadata.file_path"), REASONS: F.array_compact(F.array(*faults))})


def land(rows: DataFrame, path: str, seen: Observation | None = None) -> None:
    """Write checked rows below ``path``: ``state=good`` and ``state=quarantine``.  ``seen`` counts both on this pass."""
    state = F.when(F.size(REASONS) > 0, "quarantine").otherwise("good")
    rows = rows.withColumn("state", state)
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("state") == "quarantine").alias("quarantine"))
    rows.write.mode("overwrite").partitionBy("state").parquet(path)


def landed(spark: SparkSession, path: str, layout: tuple[T.StructType, str, Sequence[Check]], state: str = "good") -> DataFrame:
    """The rows of one state, as text: what a reader of that layout takes, or what is to be looked at."""
    names = [f.name for f in layout[0]]
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in (*names, RECORD, FILE)), T.StructField(REASONS, T.ArrayType(T.StringType())),
                           T.StructField("state", T.StringType())])
    rows = spark.read.schema(schema).parquet(path).filter(F.col("state") == state)
    return rows.select(*(f"`{n}`" for n in names)) if state == "good" else rows.drop("state")


def fault_counts(quarantine: DataFrame) -> DataFrame:
    """(file, reason, count): faults by file; a row with several counts under each."""
    return quarantine.select(F.col(FILE).alias("file"), F.explode(REASONS).alias("reason")).groupBy("file", "reason").agg(
        F.count(F.lit(1)).alias("count"))
