"""Session and scratch-folder helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(
    app: str = "airmon", master: str | None = None, partitions: int | None = None, **extra: str
) -> SparkSession:
    """A session with the settings the operators expect.

    On a cluster leave ``master`` and ``partitions`` unset: the submit command names the master, and
    adaptive execution coalesces from ``spark.sql.shuffle.partitions`` down to what the data needs.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # no call-site capture per Column: plans here are built from many small expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in extra.items():
        b = b.config(key, value)
    return b.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's scratch folder."""
    return f"{scratch_folder(spark)}/{uuid.uuid4().hex}/{name}"


def scratch_folder(spark: SparkSession) -> str:
    """Where this application keeps what it writes for itself, in the shared folder of ``spark.checkpoint.dir``.

    Where that is unset it is kept in the warehouse, which a cluster shares as well; behaviour
    does not depend on the kind of master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{base.rstrip('/')}/airmon-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all settled tables of this application; results read from them are gone then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
