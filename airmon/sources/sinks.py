"""Writers.

Partitioned outputs are rebalanced on their partition columns first: each folder gets few files, and
adaptive execution splits a folder that is too large for one task.  A write replaces the folders that it
has rows for.  Told which partitions it ``covers``, it also removes those that are stored and have no row any
more; all others stay as they are.  Readers that must never see a half-written day take the tables of
``published`` instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from airmon.operators.reshape import pivot_sites


REPLACE = ("partitionOverwriteMode", "dynamic")


def write_partitioned(
    df: DataFrame, path: str, by: str, covers: Iterable | None = None, within: Sequence[str] = (), fmt: str = "parquet", **options: str,
) -> None:
    """Write folders ``by=...``, each sorted ``within``; covered ones without rows are removed."""
    seen = Observation()
    rows = df.hint("rebalance", by)
    rows = rows.sortWithinPartitions(by, *within) if within else rows
    if covers is not None:
        # seen on the way to the files: no second pass; a partition value per folder comes back
        rows = rows.observe(seen, F.collect_set(F.col(by).cast("string")).alias("parts"))
    rows.write.mode("overwrite").option(*REPLACE).partitionBy(by).format(fmt).options(**options).save(path)
    if covers is not None:
        _withdraw(df.sparkSession, path, by, {str(x) for x in covers} - set(seen.get["parts"]))


def _withdraw(spark: SparkSession, path: str, by: str, gone: Iterable[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for value in gone:
        fs.delete(hadoop.Path(f"{path}/{by}={value}"), True)


def write_daily_wide_csv(
    df: DataFrame, path: str, value: str = "pm10", days: Sequence | None = None, covers: Iterable | None = None, **pivot,
) -> None:
    """A folder per variable and day with the hours-by-sites table, in time order: ``path/value/date=...``.

    Listed ``days`` are covered.
    """
    wide = pivot_sites(df, value, days=days, **pivot)
    write_partitioned(wide, f"{path}/{value}", "date", days if covers is None else covers, ["datetime"], "csv", header=True)


def write_sorted_csv(df: DataFrame, path: str, by: Sequence[str] = ("datetime",)) -> None:
    """Part files follow each other in order: the sort is by range over all tasks."""
    df.orderBy(*by).write.mode("overwrite").csv(path, header=True)


def write_stacked_aqs(df: DataFrame, path: str, date: str = "date_utc", years: Iterable[int] | None = None) -> None:
    """A folder per year; stored ``years`` of the extract that have no rows now are removed."""
    write_partitioned(df.withColumn("year", F.year(date)), path, "year", years)


def write_report_tables(tables: dict[str, DataFrame], path: str, covers: Iterable | None = None) -> None:
    """Every table of the daily report under its name, by day; days covered without rows are removed."""
    covers = None if covers is None else list(covers)
    for name, table in tables.items():
        write_partitioned(table, f"{path}/{name}", "date", covers)
