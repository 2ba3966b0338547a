"""Joining, gap filling and splicing of sources."""

from __future__ import annotations

import datetime as dtm
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from airmon.dims import GAP_FILL_PAIRS, REFERENCE_TARGETS
from airmon.functions import timecol as tc
from airmon.operators.calendar import with_bucket, with_hour_ending_date
from airmon.operators.intervals import bucket_intervals, extent_of, within
from airmon.sources.snapshot import settle

OBS_VALUES = ("date", "ws", "wd", "pm10", "onlake_wd", "valid")


def reconcile_sources(
    validated: DataFrame,
    preliminary: DataFrame,
    keys: Sequence[str] = ("abrv", "datetime"),
    values: Sequence[str] = OBS_VALUES,
) -> DataFrame:
    """Full join of two de-duplicated sources; each value comes from the first that has it.

    A validated row without direction takes the preliminary one and still counts as valid.
    """
    keys = list(keys)
    v = validated.select(*keys, *[F.col(c).alias(f"_v_{c}") for c in values])
    p = preliminary.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in values])
    return v.join(p, keys, "full").select(
        *keys, *[F.coalesce(f"_v_{c}", f"_p_{c}").alias(c) for c in values])


def reconcile_hours(
    readings: DataFrame,
    order: str,
    keys: Sequence[str] = ("abrv", "datetime"),
    values: Sequence[str] = ("ws", "wd", "pm10", "onlake_wd"),
) -> DataFrame:
    """De-duplicate both sources and reconcile them in one hash aggregate.

    ``readings`` is the union of the sources, told apart by ``valid``.  Equal to
    ``reconcile_sources`` over two ``dedup_site_hour`` results, but with one scan and one exchange of
    rows already combined per map task, and no sort.
    """
    first_valid = F.when(F.col("valid"), F.col(order))
    first_other = F.when(~F.col("valid"), F.col(order))
    picked = [
        F.coalesce(F.min_by(c, first_valid), F.min_by(c, first_other)).alias(c) for c in values
    ]
    hours = readings.groupBy(*keys).agg(*picked, F.max("valid").alias("valid"))
    return with_hour_ending_date(hours)


def attach_met(pm: DataFrame, met: DataFrame, keys: Sequence[str] = ("abrv", "datetime")) -> DataFrame:
    return pm.join(met.select(*keys, "ws", "wd"), list(keys), "left")


def join_pm_met_inner(pm: DataFrame, met: DataFrame, keys: Sequence[str] = ("deployment", "datetime")) -> DataFrame:
    """Hours that have both a dust reading and a met reading; both sides hold one row per hour."""
    return pm.join(met, list(keys), "inner")


def join_on_date_hour(hourly: DataFrame, met: DataFrame, keys: Sequence[str] = ("date", "hour")) -> DataFrame:
    return hourly.join(met, list(keys), "left")


def attach_hour_counts(breakdown: DataFrame, counts: DataFrame, keys: Sequence[str] = ("date", "abrv")) -> DataFrame:
    return breakdown.join(counts, list(keys), "left")


def attach_site(df: DataFrame, sites: DataFrame, key: str = "abrv") -> DataFrame:
    return df.join(sites, key, "left")


def sites_in_network(
    deployments: DataFrame, network: DataFrame, key: str = "deployment_id", without: Iterable[str] = ()
) -> DataFrame:
    """Deployments with any row in a network's table.  Ids are made distinct in the map tasks first."""
    found = deployments.join(network.select(key).distinct(), key, "left_semi")
    return found.filter(~F.col("deployment").isin(list(without))) if without else found


def override_direction(df: DataFrame, overrides: DataFrame, keys: Sequence[str] = ("abrv", "date")) -> DataFrame:
    """``overrides`` is (abrv, date, onlake_override); a match replaces the direction class."""
    return (
        df.join(overrides, list(keys), "left")
        .withColumn("onlake", F.coalesce("onlake_override", "onlake"))
        .drop("onlake_override")
        .select(*df.columns)
    )


# ---- gap filling ----------------------------------------------------------------------------------

def gap_fill_from_neighbour(df: DataFrame, pairs: Sequence[tuple[str, str]] = GAP_FILL_PAIRS) -> DataFrame:
    """Where a site has no direction, take wind from its neighbour at the same hour.

    Pairs apply in order and a filled hour can feed a later pair.  Only gaps move, and of the sites that pairs
    name only the hours with a gap; everything else is passed by.  A gap meets its hour's involved sites side by
    side, where the chain is evaluated as column expressions.  Expects one row per site-hour.  ``df`` is read for what
    is passed by, for gaps and for donors: give stored rows when it is costly.
    """
    involved = sorted({s for p in pairs for s in p})
    targets = list(dict.fromkeys(t for t, _ in pairs))
    # plain conditions, so that a scan takes them
    is_gap = F.col("abrv").isin(targets) & F.col("wd").isNull() & F.col("datetime").isNotNull()
    gaps = df.filter(is_gap)
    near = df.filter(F.col("abrv").isin(involved)).select("abrv", "datetime", "ws", "wd").join(
        gaps.select("datetime").distinct(), "datetime", "left_semi")
    peers = near.groupBy("datetime").agg(*(
        x for s in involved for own in [F.col("abrv") == s]
        for x in (F.max(own).alias(f"_has_{s}"), F.max(F.when(own, F.col("ws"))).alias(f"_ws_{s}"), F.max(F.when(own, F.col("wd"))).alias(f"_wd_{s}"))))

    now = {s: (F.col(f"_ws_{s}"), F.col(f"_wd_{s}")) for s in involved}
    for target, donor in pairs:
        ws, wd = now[target]
        gap = F.col(f"_has_{target}") & wd.isNull()
        now[target] = (
            F.when(gap, F.coalesce(ws, now[donor][0])).otherwise(ws),
            F.when(gap, now[donor][1]).otherwise(wd),
        )

    def pick(i: int) -> Column:
        out = F.lit(None).cast("double")
        for t in targets:
            out = F.when(F.col("abrv") == t, now[t][i]).otherwise(out)
        return out

    new = {"ws": pick(0).alias("ws"), "wd": pick(1).alias("wd")}
    filled = gaps.join(peers, "datetime").select(*[new.get(c, F.col(c)) for c in df.columns])
    return df.filter(~F.coalesce(is_gap, F.lit(False))).unionByName(filled)


def gap_fill_from_reference(
    df: DataFrame, reference: DataFrame, targets: Sequence[str] = REFERENCE_TARGETS
) -> DataFrame:
    """``ws`` and ``wd`` of the target sites are filled, each on its own, from a station (datetime, ws, wd).

    A station's hour that occurs twice counts once, with its smallest values, so no target row is repeated.
    """
    hours = reference.filter(F.col("datetime").isNotNull()).groupBy("datetime").agg(
        F.min(F.struct("ws", "wd")).alias("_w")).select("datetime", "_w.*")
    copies = hours.select(
        F.explode(F.array(*[F.lit(t) for t in targets])).alias("abrv"),
        "datetime", F.col("ws").alias("_ws"), F.col("wd").alias("_wd"))
    return (
        df.join(copies, ["abrv", "datetime"], "left")
        .withColumn("ws", F.coalesce("ws", "_ws"))
        .withColumn("wd", F.coalesce("wd", "_wd"))
        .select(*df.columns)
    )


# ---- set operations and splices --------------------------------------------------------------------

def union_networks(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def priority_splice(
    primary: DataFrame, fallback: DataFrame, extra: DataFrame | None = None, date: str = "date"
) -> DataFrame:
    """Primary source while it lasts, fallback from its (incomplete) last day on, year by year.

    A year the primary covers to December 31 stays primary alone; a year it lacks is all fallback.
    The last days are one row per calendar year, a proven bound, hence the hint.
    """
    year = F.year(date)
    last = F.broadcast(primary.groupBy(year.alias("_year")).agg(F.max(date).alias("_last")))
    year_end = F.make_date(F.col("_year"), F.lit(12), F.lit(31))

    head = (
        primary.withColumn("_year", year).join(last, "_year")
        .filter((F.col("_last") >= year_end) | (F.col(date) < F.col("_last")))
    )
    tail = (
        fallback.withColumn("_year", year).join(last, "_year", "left")
        .filter(F.col("_last").isNull() | ((F.col("_last") < year_end) & (F.col(date) >= F.col("_last"))))
    )
    out = head.drop("_year", "_last").unionByName(tail.drop("_year", "_last"))
    return out.unionByName(extra) if extra is not None else out


def history_live_splice(history: DataFrame, live: DataFrame, cutover, dt: str = "datetime") -> DataFrame:
    """History before a day, live from that day on, by hour-ending time."""
    first = tc.ntz(dtm.datetime.combine(tc.as_date(cutover), dtm.time()) + dtm.timedelta(seconds=1))
    return history.filter(F.col(dt) < first).unionByName(live.filter(F.col(dt) >= first))


def after_last_of(
    later: DataFrame, earlier: DataFrame, date: str = "date", site: str | None = None
) -> DataFrame:
    """Rows of ``later`` dated after the last day of ``earlier``, overall or site by site.

    Everything is kept where ``earlier`` has nothing.
    """
    if site is None:
        last = earlier.select(F.coalesce(F.max(date), F.lit("0001-01-01").cast("date"))).scalar()
        return later.filter(F.col(date) > last)
    # one row per site, settled so that its size is known and the rows need no shuffle
    last = settle(earlier.groupBy(site).agg(F.max(date).alias("_last")))
    return (
        later.join(last, site, "left")
        .filter(F.col("_last").isNull() | (F.col(date) > F.col("_last")))
        .select(*later.columns)
    )


def append_daily_tail(
    daily: DataFrame, agency: DataFrame, site: str, date: str = "date", key: str = "abrv", source: DataFrame | None = None,
) -> DataFrame:
    """Agency daily values of one site continue the computed series after its last day.

    That day is looked up in ``source``: the rows that ``daily`` was made of, if given, so that the means are not
    computed twice.
    """
    mine = (daily if source is None else source).filter(F.col(key) == site)
    tail = after_last_of(agency.filter(F.col(key) == site), mine, date)
    return daily.unionByName(tail.select(*daily.columns))


def distinct_sites(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


# ---- flux -----------------------------------------------------------------------------------------

def flux_interval_join(counts: DataFrame, periods: DataFrame, bucket_hours: int = 24) -> DataFrame:
    """Each 5-minute count with the collection period (start, end] it belongs to.

    Periods without a mass are left out.  Periods are spread over time buckets and the join is an
    equality on (sensor, bucket) plus the range test, so a long record does not make every count
    scan every period of its sensor, and a hot sensor is split by time.  The spread table is settled:
    counts are shuffled only if it is too large to broadcast.
    """
    usable = periods.filter(F.coalesce("dwp_mass", "district_mass").isNotNull())
    spread = settle(bucket_intervals(
        usable, "start_datetime", "collection_datetime", bucket_hours, extent=extent_of(counts, "datetime")))
    c = with_bucket(counts, "datetime", bucket_hours).alias("c")
    p = spread.alias("p")
    return c.join(
        p,
        (F.col("c.deployment_id") == F.col("p.sensit_deployment_id"))
        & (F.col("c._bucket") == F.col("p._bucket"))
        & within(F.col("c.datetime"), F.col("p.start_datetime"), F.col("p.collection_datetime")),
        "inner",
    ).drop("_bucket")


def collector_name_join(df: DataFrame, deployments: DataFrame) -> DataFrame:
    """Name of the collector (``csc``); rows without a known collector go."""
    names = deployments.select(F.col("deployment_id").alias("csc_deployment_id"), F.col("deployment").alias("csc"))
    return df.join(names, "csc_deployment_id")
