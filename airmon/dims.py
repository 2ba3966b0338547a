"""Fixed reference values and the small dimension tables built from them.

The tables are made from Arrow, so Spark holds them as local relations of known size and its own
``autoBroadcastJoinThreshold`` check decides on broadcasting; the only hinted joins are those with a table
of one row per calendar day or year.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: they must stay as they are for results to agree --------------------------------

#: site code -> deployment name
DEPLOYMENTS = {
    "DS": "Dirty Socks", "SC": "Shell Cut", "ST": "Stanley", "NB": "North Beach",
    "LT": "Lizard Tail", "OL": "Olancha", "MS": "Mill Site", "LP": "Lone Pine", "KE": "Keeler",
    "HW": "Haiwee", "CJ": "CoJu-696",
}
#: site code -> name in the preliminary feed
PRELIMINARY_NAMES = {
    "LP": "LonePine", "KE": "Keeler", "NB": "NorthBch", "LT": "LizardTl", "MS": "MillSite",
    "SC": "ShellCut", "DS": "DirtySox", "OL": "Olancha", "ST": "Stanley",
}
#: site code -> name in the validated feed
VALIDATED_NAMES = {
    "DS": "Dirty Socks", "SC": "Shell Cut", "ST": "Bill Stanley", "NB": "North Beach",
    "LT": "Lizard Tail", "OL": "Olancha", "MS": "Mill", "LP": "Lone Pine", "KE": "Keeler",
}
#: site code -> site number in the agency files
AGENCY_SITES = {
    "NB": "0029", "LT": "0028", "KE": "1003", "MS": "0030", "SC": "0025", "DS": "0022",
    "ST": "0026", "CJ": "1001", "OL": "0021",
}
#: site codes used by older workbooks -> present code
RENAMED_SITES = {"AP": "ST", "DE": "NB"}
#: agency parameter code -> column
PARAMETER_CODES = {81102: "pm10", 61101: "ws_s", 61102: "wd_s", 61103: "ws_r", 61104: "wd_r"}
#: onlake sector per site, degrees, inclusive, clockwise from the first to the second
ONLAKE_SECTORS = {
    "LP": (126.0, 176.0), "KE": (151.0, 296.0), "FR": (224.0, 345.0), "SC": (227.0, 33.0),
    "DS": (234.0, 50.0), "OL": (333.0, 39.0), "ST": (349.0, 230.0), "NB": (55.0, 250.0),
    "LT": (128.0, 288.0), "MS": (157.0, 333.0), "T2": (0.0, 360.0), "HW": (344.0, 17.0),
    "CJ": (347.0, 12.0),
}
#: the dunes sector counts at one site only
DUNES_SITE = "KE"
DUNES_SECTOR = (296.0, 337.0)
#: named site groups
SITE_GROUPS = {
    "South": ("DS", "SC", "ST", "OL", "HW", "CJ"),
    "Shoreline": ("DS", "SC", "ST", "NB", "LT", "OL", "MS", "KE"),
}
#: column order of the wide daily export
EXPORT_SITES = (
    "Olancha", "Dirty Socks", "Stanley", "Shell Cut", "Mill Site", "Keeler", "Lizard Tail",
    "North Beach", "Lone Pine",
)
#: (target, donor) pairs for filling wind gaps, applied in this order
GAP_FILL_PAIRS = (("DS", "SC"), ("SC", "DS"), ("MS", "KE"))
#: sites that take wind from the reference met station
REFERENCE_TARGETS = ("MS", "KE")
#: years of record kept per deployment
RECORD_YEARS = {
    "1551": 2, "1552": 4, "ATower": 10, "Keeler": 11, "LizardTl": 10, "LonePine": 11,
    "NorthBch": 9, "T27": 6, "T29-4S": 2, "T29-4N": 2,
}
#: value breaks of the rose classes
DUST_BREAKS = (20.0, 50.0, 100.0, 150.0)
DUST_BREAKS_LOW = (10.0, 50.0, 100.0, 150.0)
WIND_BREAKS = (3.0, 6.0, 9.0, 12.0)
FLUX_BREAKS = (2.0, 4.0, 6.0, 8.0)
FLUX_BREAKS_LOW = (1.0, 2.0, 3.0, 4.0)
#: daily PM10 standard, assumed background in backfill, hours in a full day
STANDARD = 150.0
BACKGROUND = 20.0
DAY_HOURS = 24
#: lower bound of a credible PM10 reading
PM10_FLOOR = -15.0
#: missing-value marker in workbooks
SENTINEL = -9999.0
KNOTS_TO_MPS = 0.5144
#: collector inlet area divisor of the flux formula
COLLECTOR_DIVISOR = 1.2
LOCAL_ZONE = "America/Los_Angeles"


# ---- tables ---------------------------------------------------------------------------------------

def local_table(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    return spark.createDataFrame(pa.table(columns))


def sector_table(spark: SparkSession, sectors: dict[str, tuple[float, float]] = ONLAKE_SECTORS) -> DataFrame:
    """(abrv, from_deg, to_deg)"""
    return local_table(spark, {
        "abrv": list(sectors),
        "from_deg": [float(v[0]) for v in sectors.values()],
        "to_deg": [float(v[1]) for v in sectors.values()],
    })


def site_group_table(spark: SparkSession) -> DataFrame:
    """(site_group, abrv)"""
    rows = [(g, s) for g, sites in SITE_GROUPS.items() for s in sites]
    return local_table(spark, {"site_group": [r[0] for r in rows], "abrv": [r[1] for r in rows]})


def record_years_table(spark: SparkSession, years: dict[str, int] = RECORD_YEARS) -> DataFrame:
    """(deployment, cutoff)"""
    return local_table(spark, {
        "deployment": pa.array(list(years), pa.string()),
        "cutoff": pa.array(list(years.values()), pa.int32()),
    })
