"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from airmon.session import scratch_path

#: The words of the contracts: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``written`` in as many buckets of ``keys`` as a shuffle has partitions: what groups or joins by all of them needs no exchange.

    The catalog knows the table only until it is read back; its files stay in the shared folder.
    """
    spark, known = df.sparkSession, f"airmon_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *keys).format("parquet").option("path", scratch_path(spark, name)).saveAsTable(known)
    out = spark.table(known)
    spark.sql(f"DROP TABLE {known}")
    return out


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (0, 1, ...) of each row in its group, nulls first, and ``total``, the rows of the group.

    One exchange by range puts the rows in order; a task numbers its own rows and only counts per task and group
    are summed up.  So no task holds a group.  Rows equal in ``order`` must be equal altogether.
    """
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*group, *order) if (*group, *order) else df
    rows = written(rows.sortWithinPartitions(*group, *order).withColumn("at", at), name)
    rows = rows.withColumn("task", F.shiftright("at", 33))
    runs = rows.groupBy(*group, "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of = Window.partitionBy(*group)
    before = F.sum("n").over(of.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    runs = runs.select(*(F.col(c).alias(f"run_{c}") for c in group), F.col("task").alias("run_task"), "first",
                       before.alias("before"), F.sum("n").over(of).alias("total"))
    same = rows["task"] == runs["run_task"]
    for c in group:
        same = same & rows[c].eqNullSafe(runs[f"run_{c}"])
    return rows.join(runs, same).select(*df.columns, (F.col("at") - F.col("first") + F.col("before")).alias("rank"), "total")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with ``value`` computed once, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def splitmix(x: "numpy.ndarray", seed: int) -> "numpy.ndarray":  # noqa: F821
    """A fixed bijective mixer of unsigned 64-bit integers, other for each seed."""
    import numpy as np

    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
