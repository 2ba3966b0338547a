"""Long to wide, wide to long, and fixed column sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from airmon.dims import EXPORT_SITES, PARAMETER_CODES
from airmon.functions import values as val


def _pivot(df: DataFrame, keys: Sequence[str], by: str, names: Mapping[str, object], pick) -> DataFrame:
    """A column per name, for its value of ``by``, in one aggregate; ``pick(condition)`` builds it.

    With the values given, conditional aggregates need one exchange where ``pivot`` plans two.
    """
    return df.groupBy(*keys).agg(*[pick(F.col(by) == v).alias(n) for n, v in names.items()])


def pivot_parameters(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    names: Mapping[int, str] = PARAMETER_CODES,
    code: str = "code",
    value: str = "value",
) -> DataFrame:
    """(keys, code, value) to one column per parameter.  The lowest ``order`` wins a repeated code."""
    return _pivot(df, keys, code, {n: v for v, n in names.items()}, lambda hit: F.min_by(value, F.when(hit, F.col(order))))


def pivot_sites(
    df: DataFrame,
    value: str = "pm10",
    sites: Sequence[str] = EXPORT_SITES,
    keys: Sequence[str] = ("date", "datetime"),
    by: str = "deployment",
    days: Sequence | None = None,
) -> DataFrame:
    """Hours by sites, always with all sites in the given order; missing ones are NULL columns."""
    if days is not None:
        df = df.filter(F.col("date").isin(list(days)))
    df = df.filter(F.col(by).isin(list(sites)))
    return _pivot(df, keys, by, {s: s for s in sites}, lambda hit: F.max(F.when(hit, F.col(value))))


def pivot_onlake(long: DataFrame, value: str, keys: Sequence[str] = ("date", "abrv")) -> DataFrame:
    """(keys, onlake, value) to columns ``offlake`` and ``onlake``, 0 where a class is absent.

    The class of unknown direction gets no column, and keys with nothing else get no row.
    """
    known = long.filter(F.col("onlake").isNotNull())
    wide = _pivot(
        known, keys, "onlake", {"offlake": False, "onlake": True}, lambda hit: F.max(F.when(hit, F.col(value))))
    return wide.na.fill(0, ["offlake", "onlake"])


def unpivot_sites(wide: DataFrame, sites: Sequence[str], ids: Sequence[str] = ("date", "hour"), value: str = "teom") -> DataFrame:
    return wide.unpivot(list(ids), list(sites), "abrv", value)


def unpivot_site_variables(
    wide: DataFrame, ids: Sequence[str] = ("date", "hour"), variables: Sequence[str] = ("ws", "wd")
) -> DataFrame:
    """Columns named like ``KE_wd`` to one row per site with a column per variable.

    The columns of a site are gathered into one struct per site and exploded, which needs no exchange;
    unpivot, split and pivot back would shuffle every value.
    """
    sites = list(dict.fromkeys(c[0:2] for c in wide.columns if c not in ids))
    have = set(wide.columns)
    rows = [
        F.struct(F.lit(s).alias("abrv"), *[
            (F.col(f"{s}_{v}") if f"{s}_{v}" in have else F.lit(None).cast("double")).cast("double").alias(v)
            for v in variables
        ])
        for s in sites
    ]
    return wide.select(*ids, F.explode(F.array(*rows)).alias("s")).select(*ids, "s.*")


def split_site_variable(long: DataFrame, key: str = "key") -> DataFrame:
    return long.withColumn("abrv", val.site_of_key(key)).withColumn("var1", val.variable_of_key(key))


def ensure_columns(df: DataFrame, names: Sequence[str], dtype: str = "double") -> DataFrame:
    """Exactly these columns in this order; absent ones are NULL."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast(dtype).alias(n) for n in names])


def resultant_over_scalar(df: DataFrame) -> DataFrame:
    """``ws`` and ``wd`` from the resultant columns, else the scalar ones, whichever exist."""
    def pick(v: str) -> Column:
        have = [c for c in (f"{v}_r", f"{v}_s") if c in df.columns]
        return (F.coalesce(*have) if have else F.lit(None).cast("double")).alias(v)

    parts = {"ws_r", "ws_s", "wd_r", "wd_s"}
    return df.select(*[c for c in df.columns if c not in parts], pick("ws"), pick("wd"))


def normalise_names(df: DataFrame, drop_suffix: str = "") -> DataFrame:
    def clean(n: str) -> str:
        n = n.lower().replace(" ", "_").replace(".", "_")
        return n.removesuffix(drop_suffix) if drop_suffix else n

    return df.toDF(*[clean(n) for n in df.columns])
