"""Written tables: the saved assembly of a run, and small tables whose size Spark should know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from airmon.session import scratch_path


def snapshot(df: DataFrame, path: str, refresh: bool = True, partition_by: Sequence[str] = ()) -> DataFrame:
    """Save the assembled table when ``refresh``, else take what an earlier run saved."""
    if refresh:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Write a table that is small by nature to the shared folder and read it back.

    The file's size is known, so ``autoBroadcastJoinThreshold`` decides between broadcasting it and
    a shuffled join, and lost executors do not cost its recomputation.
    """
    return snapshot(df, scratch_path(df.sparkSession, "settled"))
