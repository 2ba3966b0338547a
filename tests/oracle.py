"""Compare a query with its SQL, strictly: columns, types and values."""

from __future__ import annotations

import datetime as dtm
import math
from collections import Counter

import duckdb
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

DUCK_TYPES = {
    T.LongType: {"BIGINT"}, T.IntegerType: {"INTEGER"}, T.DoubleType: {"DOUBLE"}, T.StringType: {"VARCHAR"},
    T.BooleanType: {"BOOLEAN"}, T.DateType: {"DATE"}, T.TimestampNTZType: {"TIMESTAMP"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, dtm.datetime):
        return v.isoformat()
    return v


def compare(df, con, sql: str) -> list[str]:
    """Differences found; empty when the two agree."""
    rel = con.sql(sql)
    problems = []
    duck_cols = dict(zip(rel.columns, [str(t) for t in rel.types]))
    spark_cols = {f.name: f.dataType for f in df.schema}
    if sorted(duck_cols) != sorted(spark_cols):
        return [f"columns {sorted(spark_cols)} <> {sorted(duck_cols)}"]
    for c, t in spark_cols.items():
        if duck_cols[c] not in DUCK_TYPES[type(t)]:
            problems.append(f"type of {c}: {t} <> {duck_cols[c]}")
    order = sorted(spark_cols)
    mine = Counter(tuple(canonical(r[c]) for c in order) for r in df.collect())
    idx = [rel.columns.index(c) for c in order]
    theirs = Counter(tuple(canonical(r[i]) for i in idx) for r in rel.fetchall())
    if mine != theirs:
        a, b = mine - theirs, theirs - mine
        problems.append(f"rows {sum(mine.values())} <> {sum(theirs.values())}; only spark {list(a)[:3]}; only sql {list(b)[:3]}")
    if not mine:
        problems.append("no rows")
    return problems
