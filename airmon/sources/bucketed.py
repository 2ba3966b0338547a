"""Tables stored by site-hour, so that joins and first-row aggregates on it need no exchange.

Rows are dealt into a fixed number of buckets by the hash of their keys, one file each, in the order of the keys.  Two
tables of equal keys and buckets lie together: a join or a grouping on the keys reads a bucket of each and moves nothing.
The catalog must know the tables, which live in the warehouse.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

SITE_HOUR = ("abrv", "datetime")


def store_by_site_hour(df: DataFrame, buckets: int, name: str | None = None, keys: Sequence[str] = SITE_HOUR) -> DataFrame:
    """Store a table under a name (a new one where none is given) and read it back.

    Buckets should be a multiple of the tasks that run at once, and large enough that one fits a task.  Site and
    hour together are many keys, so a hot site is dealt over all buckets.
    """
    name = name or f"airmon_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, *keys)
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
