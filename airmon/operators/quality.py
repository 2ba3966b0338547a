"""Filters, quality control and de-duplication."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from airmon.dims import LOCAL_ZONE, PM10_FLOOR, SENTINEL
from airmon.functions import timecol as tc
from airmon.operators.calendar import with_bucket
from airmon.operators.intervals import bucket_intervals, extent_of, merge_intervals, within
from airmon.sources.snapshot import settle


def filter_period(df: DataFrame, start, end, dt: str = "datetime") -> DataFrame:
    return df.filter(tc.in_period(dt, start, end))


def filter_hour_range(df: DataFrame, start, end, dt: str = "datetime") -> DataFrame:
    return df.filter(tc.in_hour_range(dt, start, end))


def filter_sites(df: DataFrame, sites: Iterable[str] | DataFrame, col: str = "abrv") -> DataFrame:
    """Keep sites of a list (pushed to the scan) or of a table that has the same column."""
    if isinstance(sites, DataFrame):
        return df.join(sites.select(col), col, "left_semi")
    return df.filter(F.col(col).isin(list(sites)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares above every number in Spark, so readings must not keep it."""
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema
    ])


def sentinel_to_null(df: DataFrame, sentinel: float = SENTINEL) -> DataFrame:
    """The missing-value marker becomes NULL in every numeric column."""
    return df.select(*[
        F.nullif(F.col(f.name), F.lit(sentinel).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, T.NumericType) else F.col(f.name)
        for f in df.schema
    ])


def qc_bounds(df: DataFrame, floor: float = PM10_FLOOR, value: str = "pm10", dt: str = "datetime") -> DataFrame:
    """Readings with a time and a value above the floor.  NaN, which compares above every number, is no value."""
    return df.filter(F.col(dt).isNotNull() & (F.col(value) > floor) & ~F.isnan(F.col(value).cast("double")))


def _rank(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the lowest ``order``, which must be unique and not NULL in a key.

    An aggregate rather than a ranking window: each map task keeps one row per key, so a hot key
    never travels whole.  With a single numeric ``order`` and fixed-width columns it is a hash
    aggregate.
    """
    rank = _rank(order)
    aggs = [
        (F.min(c) if list(order) == [c] else F.min_by(c, rank)).alias(c)
        for c in df.columns if c not in keys
    ]
    return df.groupBy(*keys).agg(*aggs).select(*df.columns)


def dedup_site_hour(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("abrv", "datetime")) -> DataFrame:
    return first_by(df, keys, order)


def first_in_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Which row wins its key and how many rows competed."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_" + order), F.count(F.lit(1)).alias("n_rows"))


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def drop_invalid_flag(df: DataFrame, flag: str = "invalid") -> DataFrame:
    return df.filter(~F.col(flag))


def valid_wind(df: DataFrame) -> DataFrame:
    """Calm hours have no direction, so they go as well."""
    return df.filter(F.col("ws").isNotNull() & F.col("wd").isNotNull() & (F.col("ws") > 0))


def method_filter(df: DataFrame, pattern: str = "TEOM", col: str = "method_description") -> DataFrame:
    return df.filter(F.col(col).rlike(pattern))


def season_filter(df: DataFrame, wanted: str, col: str = "season") -> DataFrame:
    return df if wanted == "year" else df.filter(F.col(col) == wanted)


def drop_nonexistent_local(df: DataFrame, dt: str = "datetime", zone: str = LOCAL_ZONE) -> DataFrame:
    return df.filter(F.col(dt).isNotNull() & tc.exists_in_zone(dt, zone))


def drop_incomplete_last_day(df: DataFrame, date: str = "date", source: DataFrame | None = None) -> DataFrame:
    """Without the last day.  The day is a scalar subquery, so rows do not move.

    It is looked up in ``source``, by default ``df`` itself, whose steps then run twice: give the stored rows
    that ``df`` was made of when it is costly and keeps their days.
    """
    return df.filter(F.col(date) != (df if source is None else source).select(F.max(date)).scalar())


def drop_mixed_preliminary(df: DataFrame) -> DataFrame:
    """A site-day with any validated hour loses its preliminary hours.

    Expects one row per site-hour, so a window group is one day of one site.
    """
    day = Window.partitionBy("date", "abrv")
    return (
        df.withColumn("_any_valid", F.max("valid").over(day))
        .filter(F.col("valid") | ~F.col("_any_valid"))
        .drop("_any_valid")
    )


def record_limits(df: DataFrame, years: DataFrame, site: str = "deployment", dt: str = "datetime") -> DataFrame:
    """First and last stamp per site, the stop ``cutoff`` years after the first, and whether it cuts."""
    extent = df.groupBy(site).agg(F.min(dt).alias("start"), F.max(dt).alias("end"))
    stop = F.expr("start + make_ym_interval(cutoff, 0)")
    return (
        extent.join(years, site, "left")
        .withColumn("stop", stop)
        .withColumn("check", F.col("stop") < F.col("end"))
    )


def trim_record(
    df: DataFrame, years: DataFrame, site: str = "deployment", dt: str = "datetime", strict: bool = False
) -> DataFrame:
    """Drop rows later than the stop of their site.

    Sites without an entry keep all rows, or lose all in ``strict`` mode.  The limits hold one row
    per site; they are settled first so that Spark knows their size and readings need no shuffle.
    """
    limits = settle(record_limits(df, years, site, dt).select(site, "stop"))
    keep = F.col(dt) <= F.col("stop")
    if not strict:
        keep = keep | F.col("stop").isNull()
    return df.join(limits, site, "left").filter(keep).drop("stop")


def rose_rows(df: DataFrame, value: str = "pm10") -> DataFrame:
    """Rows a rose can use."""
    return df.filter(F.col(value).isNotNull() & F.col("wd").isNotNull())


def rose_subset(df: DataFrame, value: str = "pm10", by: Sequence[str] = ("date", "abrv")) -> DataFrame:
    """Usable rows per site-day; a site-day without any stays with 0, the placeholder of an empty rose."""
    usable = F.col(value).isNotNull() & F.col("wd").isNotNull()
    return df.groupBy(*by).agg(
        F.count_if(usable).alias("n_rows"),
        (F.count_if(usable) == 0).alias("placeholder"),
    )


def flag_lookup(
    df: DataFrame,
    flags: DataFrame,
    fields: Mapping[str, int],
    id_col: str = "deployment_id",
    dt: str = "datetime",
    bucket_hours: int = 24,
) -> DataFrame:
    """Add one boolean per field: is the reading inside a flag interval (start, end] of that field?

    ``flags`` is (deployment_id, field_id, start_datetime, end_datetime).  Intervals are cut at bucket
    edges and merged, so a reading meets at most one and the join can neither multiply rows nor pair
    a hot deployment's readings with all of its flags.  A flag without an end is still open; only buckets
    between the first and last reading are made, however long a flag lasts.  Readings without a time
    match nothing and are kept apart from the join.  Buckets no longer than the usual flag keep the
    merged table smallest.  It is settled, so readings are shuffled only if it is too large to broadcast.
    """
    lo, hi = "start_datetime", "end_datetime"
    keys = [id_col, "field_id", "_bucket"]
    wanted = flags.filter(F.col("field_id").isin(list(fields.values()))).select(
        F.col("deployment_id").alias(id_col), "field_id", F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    cut = bucket_intervals(wanted, "_lo", "_hi", bucket_hours, clip=True, extent=extent_of(df, dt))
    merged = settle(merge_intervals(cut, keys, "_lo", "_hi"))
    timeless = df.filter(F.col(dt).isNull()).withColumns({name: F.lit(False) for name in fields})
    out = with_bucket(df.filter(F.col(dt).isNotNull()), dt, bucket_hours)
    for name, field in fields.items():
        hit = out.alias("r").join(
            merged.filter(F.col("field_id") == field).alias("f"),
            (F.col(f"r.{id_col}") == F.col(f"f.{id_col}"))
            & (F.col("r._bucket") == F.col("f._bucket"))
            & within(F.col(f"r.{dt}"), F.col("f._lo"), F.col("f._hi")),
            "left",
        )
        out = hit.select("r.*", F.col("f._lo").isNotNull().alias(name))
    return out.drop("_bucket").unionByName(timeless)
