"""Day sums that can be merged and taken back.

A state has one row per site-day: hours, readings and sums of all, onlake, offlake and dunes hours, for validated and
preliminary hours apart, as which of them count is known only when all hours of the day are there.  Readings are whole
numbers of 1/SCALE, so sums are exact: states merge in any order, and hours that were replaced are taken back without
a trace.  Daily averages, contributions, conditional means and yearly summaries follow from a state alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airmon.functions.values import half_even, steady
from airmon.operators.aggregate import SITE_DAY

SCALE = 1_000_000
SOURCES = ("good", "other")
#: Of each source: hours, hours of known direction, then readings and their sum by class of hours.
CLASSES = ("all", "on", "off", "dunes")
MEASURES = tuple(f"{x}_{s}" for s in SOURCES for x in ("hours", "known", *(f"{m}_{c}" for c in CLASSES for m in ("n", "s"))))
STATE = "abrv string, " + ", ".join(f"{m} long" for m in MEASURES)


def _parts(sign: int) -> Iterator[Column]:
    value = F.round(F.col("pm10") * SCALE).cast("long")
    for source in SOURCES:
        own = F.col("valid") if source == "good" else ~F.col("valid")
        yield (F.count_if(own) * sign).alias(f"hours_{source}")
        yield (F.count_if(own & F.col("onlake").isNotNull()) * sign).alias(f"known_{source}")
        for c, hit in zip(CLASSES, (own, own & F.col("onlake"), own & ~F.col("onlake"), own & F.col("dunes"))):
            yield (F.count(F.when(hit, value)) * sign).alias(f"n_{c}_{source}")
            yield (F.coalesce(F.sum(F.when(hit, value)), F.lit(0)) * sign).alias(f"s_{c}_{source}")


def day_state(hours: DataFrame, taken_back: bool = False) -> DataFrame:
    """The state of reconciled hours (date, abrv, pm10, valid, onlake, dunes), or what takes them back."""
    return hours.groupBy(*SITE_DAY).agg(*_parts(-1 if taken_back else 1))


def merge_states(*states: DataFrame) -> DataFrame:
    """Sum of states; site-days of which nothing is left have no row."""
    rows = reduce(DataFrame.unionByName, states)
    merged = rows.groupBy(*SITE_DAY).agg(*(F.sum(m).alias(m) for m in MEASURES))
    return merged.filter(F.greatest("hours_good", "hours_other") > 0)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What turns the state of the hours ``before`` into that of ``after``; hours that are in both cancel out."""
    return merge_or_negative(day_state(before, taken_back=True), day_state(after))


def merge_or_negative(*states: DataFrame) -> DataFrame:
    """Sum of states that may be below nothing, without the site-days that it leaves as they are."""
    rows = reduce(DataFrame.unionByName, states)
    merged = rows.groupBy(*SITE_DAY).agg(*(F.sum(m).alias(m) for m in MEASURES))
    return merged.filter(reduce(Column.__or__, (F.col(m) != 0 for m in MEASURES)))


def best_source(state: DataFrame) -> DataFrame:
    """(date, abrv, hours, known, n_..., s_...) of the validated hours of a site-day, or of the others where it has none."""
    names = dict.fromkeys(m.rsplit("_", 1)[0] for m in MEASURES)
    return state.select(*SITE_DAY, *(
        F.when(F.col("hours_good") > 0, F.col(f"{x}_good")).otherwise(F.col(f"{x}_other")).alias(x) for x in names))


def _mean(c: str, over: str | None = None) -> Column:
    return F.try_divide(F.col(f"s_{c}") / SCALE, F.col(over or f"n_{c}"))


def daily_avg_of(state: DataFrame) -> DataFrame:
    """``aggregate.daily_avg`` of the best source's hours."""
    return best_source(state).select(*SITE_DAY, steady(_mean("all")).alias("pm10_avg"))


def contribution_of(state: DataFrame) -> DataFrame:
    """``aggregate.onlake_contribution``: sector sums over all hours, NULL where no direction is known."""
    on, off = (F.when(F.col("known") > 0, half_even(_mean(c, "hours"))) for c in ("on", "off"))
    return best_source(state).select(*SITE_DAY, on.alias("onlake"), off.alias("offlake")).withColumn(
        "pm10_avg", F.bround(F.col("onlake") + F.col("offlake"), 0))


def conditional_means_of(state: DataFrame) -> DataFrame:
    """``aggregate.sector_conditional_means``: each mean over its own hours."""
    pairs = {"24": "all", "onlake": "on", "dunes": "dunes", "offlake": "off"}
    return best_source(state).select(*SITE_DAY, *(
        x for name, c in pairs.items()
        for x in (half_even(_mean(c)).alias(f"pm10_{name}"), F.col(f"n_{c}").alias("n" if name == "24" else f"n_{name}"))))


def daily_contribution_of(state: DataFrame) -> DataFrame:
    """``aggregate.daily_contribution``, which the yearly summary takes."""
    return best_source(state).select(*SITE_DAY, *(
        half_even(_mean(c, "n_all")).alias(f"pm10_{name}") for name, c in (("24", "all"), ("onlake", "on"), ("offlake", "off"))))
