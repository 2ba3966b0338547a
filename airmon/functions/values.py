"""Direction tests and value conversions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from airmon.dims import COLLECTOR_DIVISOR, DUNES_SECTOR, DUNES_SITE, KNOTS_TO_MPS, STANDARD
from airmon.functions.timecol import col


def _num(x: Column | str | float) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else col(x)


def angle_between(wd: Column | str, start: Column | str | float, stop: Column | str | float) -> Column:
    """Is a direction inside the sector running clockwise from ``start`` to ``stop``, ends included?

    A sector whose start is not below its stop passes through north, so it is everything but the
    gap between stop and start.  NULL directions give NULL.
    """
    d, a, b = col(wd), _num(start), _num(stop)
    in_gap = (d > b) & (d < a)
    return F.when(a < b, d.between(a, b)).otherwise(d.between(0.0, 360.0) & ~in_gap)


def in_dunes(wd: Column | str, abrv: Column | str) -> Column:
    return angle_between(wd, *DUNES_SECTOR) & (col(abrv) == DUNES_SITE)


def compass_sector(wd: Column | str, sectors: int = 16) -> Column:
    """0 for the sector centred on north, then clockwise."""
    width = 360.0 / sectors
    return F.floor(F.pmod(col(wd) + F.lit(width / 2), F.lit(360.0)) / F.lit(width)).cast("int")


def value_class(value: Column | str, breaks: Sequence[float]) -> Column:
    """Index of the half-open class [lo, hi): 0 below the first break, len(breaks) from the last on."""
    v = col(value)
    out = F.when(v < breaks[0], 0)
    for i, b in enumerate(breaks[1:], start=1):
        out = out.when(v < b, i)
    return out.when(v.isNotNull(), len(breaks))


def class_label(klass: Column | str, breaks: Sequence[float]) -> Column:
    names = [f"<{breaks[0]:g}"]
    names += [f"{a:g}-{b:g}" for a, b in zip(breaks, breaks[1:])]
    names += [f">={breaks[-1]:g}"]
    return F.get(F.array(*[F.lit(n) for n in names]), col(klass))


def steady(x: Column | str) -> Column:
    """Drop the last digits, which depend on the order in which tasks add doubles up.

    Means lie on a grid far coarser than 1e-6, so this only makes ties and threshold tests repeatable.
    """
    return F.round(col(x), 6)


def half_even(x: Column | str) -> Column:
    """Round to a whole number, ties to even."""
    return F.bround(steady(x), 0)


def knots_to_mps(ws: Column | str) -> Column:
    return col(ws) * KNOTS_TO_MPS


def site_of_key(key: Column | str) -> Column:
    return F.substring(col(key), 1, 2)


def variable_of_key(key: Column | str) -> Column:
    return F.substring(col(key), 4, 2)


def lookup(code: Column | str, mapping: Mapping[str, str]) -> Column:
    """Value for a code, NULL when the code is unknown."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(code))


def site_code(name: Column | str, names: Mapping[str, str]) -> Column:
    """Source name -> site code, given the code -> name table of that source."""
    return lookup(name, {v: k for k, v in names.items()})


def recode(code: Column | str, renamed: Mapping[str, str]) -> Column:
    return F.coalesce(lookup(code, renamed), col(code))


def flag_color(avg: Column | str, limit: float = STANDARD) -> Column:
    return F.when(col(avg) > limit, "red").when(col(avg) <= limit, "black")


def display_label(deployment: Column | str, footnoted: Mapping[str, str] | None = None) -> Column:
    # fixed values: labels shown instead of the deployment name
    shown = footnoted or {"Olancha": "Olancha*", "CoJu-696": "Coso Junction"}
    return recode(deployment, shown)


def report_subtitle(any_preliminary: Column | str) -> Column:
    # fixed value: subtitle of a report that uses preliminary rows
    return F.when(col(any_preliminary), "(from preliminary, unvalidated data)").otherwise("")


def sand_flux_rate(sumpc, sumpc_total, dwp_mass, district_mass) -> Column:
    """Share of the period's counts times the collected mass per inlet area; 0 without counts."""
    mass = F.coalesce(col(dwp_mass), col(district_mass))
    rate = F.try_divide(col(sumpc), col(sumpc_total)) * (mass / COLLECTOR_DIVISOR)
    return F.when(col(sumpc_total) > 0, rate).otherwise(0.0)
