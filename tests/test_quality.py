import random

import pytest
from pyspark.sql import functions as F

from airmon import dims
from airmon.operators import quality as qc
from airmon.operators.intervals import bucket_intervals, merge_intervals
from helpers import d, rows, t

import datetime as dtm

OBS = "event_id long, abrv string, datetime timestamp_ntz, ws double, wd double, pm10 double, valid boolean"


def test_bounds(spark):
    df = spark.createDataFrame([(1, -15.0), (2, -14.9), (3, None), (4, 5.0)], "k int, pm10 double").withColumn(
        "datetime", F.when(F.col("k") < 4, F.lit("2017-01-01 01:00:00").cast("timestamp_ntz")))
    assert [r.k for r in qc.qc_bounds(df).collect()] == [2]


def test_sentinel_and_nan(spark):
    df = spark.createDataFrame([("a", -9999.0, -9999), ("b", float("nan"), 3)], "s string, x double, n int")
    assert rows(qc.nan_to_null(qc.sentinel_to_null(df)), "s") == [("a", None, None), ("b", None, 3)]


def test_dedup_keeps_the_lowest_row_whole(spark):
    df = spark.createDataFrame([
        (7, "KE", t("2017-01-01 01:00:00"), 1.0, 10.0, 5.0, True),
        (3, "KE", t("2017-01-01 01:00:00"), None, 20.0, 6.0, False),
        (9, "OL", t("2017-01-01 01:00:00"), 2.0, None, 7.0, True),
    ], OBS)
    once = qc.dedup_site_hour(df, ["event_id"])
    assert rows(once, "abrv") == [
        (3, "KE", t("2017-01-01 01:00:00"), None, 20.0, 6.0, False),
        (9, "OL", t("2017-01-01 01:00:00"), 2.0, None, 7.0, True)]
    assert rows(qc.dedup_site_hour(once, ["event_id"]), "abrv") == rows(once, "abrv")
    two = qc.dedup_site_hour(df, ["valid", "event_id"])
    assert rows(two.select("abrv", "event_id"), "abrv") == [("KE", 3), ("OL", 9)]


def test_mixed_day(spark):
    def day(site, date, hours, valid):
        base = t(f"{date} 00:00:00")
        return [(0, site, base + dtm.timedelta(hours=h), 1.0, 1.0, 1.0, valid) for h in hours]

    data = day("KE", "2017-01-01", range(1, 21), True) + day("KE", "2017-01-01", range(21, 25), False)
    data += day("KE", "2017-01-02", range(1, 25), False) + day("OL", "2017-01-01", range(1, 25), False)
    df = spark.createDataFrame(data, OBS).withColumn("date", (F.col("datetime") - F.expr("INTERVAL 1 SECOND")).cast("date"))
    got = qc.drop_mixed_preliminary(df).groupBy("abrv", "date").count()
    assert rows(got, "abrv", "date") == [("KE", d("2017-01-01"), 20), ("KE", d("2017-01-02"), 24), ("OL", d("2017-01-01"), 24)]
    pure = df.filter("date = DATE'2017-01-02'")
    assert qc.drop_mixed_preliminary(pure).count() == 24


def test_last_day_goes(spark):
    df = spark.createDataFrame([(d("2017-01-01"),), (d("2017-01-02"),), (d("2017-01-02"),)], "date date")
    assert [r.date for r in qc.drop_incomplete_last_day(df).collect()] == [d("2017-01-01")]


def test_trim_record(spark):
    df = spark.createDataFrame([
        ("A", t("2012-02-29 01:00:00")), ("A", t("2013-02-28 01:00:00")), ("A", t("2013-02-28 02:00:00")),
        ("B", t("2012-01-01 01:00:00")), ("B", t("2020-01-01 01:00:00"))], "deployment string, datetime timestamp_ntz")
    years = dims.record_years_table(spark, {"A": 1})
    kept = qc.trim_record(df, years)
    assert rows(kept.groupBy("deployment").count(), "deployment") == [("A", 2), ("B", 2)]
    assert rows(qc.trim_record(df, years, strict=True).groupBy("deployment").count()) == [("A", 2)]
    limits = {r.deployment: r.check for r in qc.record_limits(df, years).collect()}
    assert limits == {"A": True, "B": None}


def test_empty_rose_keeps_its_place(spark):
    df = spark.createDataFrame([(d("2017-01-01"), "KE", 1.0, None), (d("2017-01-01"), "OL", 1.0, 3.0)],
                               "date date, abrv string, pm10 double, wd double")
    assert rows(qc.rose_subset(df), "abrv") == [(d("2017-01-01"), "KE", 0, True), (d("2017-01-01"), "OL", 1, False)]


def test_site_filters(spark):
    df = spark.createDataFrame([("KE",), ("HW",), ("OL",)], "abrv string")
    assert {r[0] for r in qc.filter_sites(df, ["KE", "OL"]).collect()} == {"KE", "OL"}
    south = dims.site_group_table(spark).filter("site_group = 'South'")
    assert {r[0] for r in qc.filter_sites(df, south).collect()} == {"HW", "OL"}


# ---- intervals against brute force -------------------------------------------------------------------

def _random_flags(seed, n):
    rnd = random.Random(seed)
    base = t("2024-01-01 00:00:00")
    out = []
    for _ in range(n):
        # a hot deployment holds most flags; lengths from seconds to days; some touch bucket edges
        dep = 1 if rnd.random() < 0.7 else rnd.randrange(2, 5)
        start = base + dtm.timedelta(minutes=rnd.choice([rnd.randrange(0, 7200), 60 * rnd.randrange(0, 120)]))
        length = rnd.choice([dtm.timedelta(seconds=rnd.randrange(1, 90)), dtm.timedelta(minutes=rnd.randrange(1, 500)),
                             dtm.timedelta(days=rnd.randrange(1, 3)), dtm.timedelta(0)])
        out.append((dep, rnd.choice([116, 117]), start, start + length))
    return out


@pytest.mark.parametrize("hours", [1, 6, 24])
@pytest.mark.parametrize("seed", [1, 2])
def test_flag_lookup_equals_brute_force(spark, seed, hours):
    flags = _random_flags(seed, 120)
    rnd = random.Random(seed + 100)
    base = t("2024-01-01 00:00:00")
    readings = []
    for i in range(600):
        when = rnd.choice([base + dtm.timedelta(minutes=rnd.randrange(0, 8000)), rnd.choice(flags)[2], rnd.choice(flags)[3]])
        readings.append((i, 1 if rnd.random() < 0.5 else rnd.randrange(1, 6), when))
    f = spark.createDataFrame(flags, "deployment_id int, field_id int, start_datetime timestamp_ntz, end_datetime timestamp_ntz")
    r = spark.createDataFrame(readings, "i int, deployment_id int, datetime timestamp_ntz")
    got = qc.flag_lookup(r, f, {"bad_ws": 116, "bad_wd": 117}, bucket_hours=hours)

    def hit(dep, when, field):
        return any(a == dep and b == field and lo < when <= hi for a, b, lo, hi in flags)

    want = [(i, dep, w, hit(dep, w, 116), hit(dep, w, 117)) for i, dep, w in readings]
    assert rows(got, "i") == want


def test_merged_intervals_are_disjoint(spark):
    flags = _random_flags(5, 200)
    f = spark.createDataFrame(flags, "k int, field int, lo timestamp_ntz, hi timestamp_ntz").drop("field")
    m = merge_intervals(bucket_intervals(f, "lo", "hi", 6, clip=True), ["k", "_bucket"], "lo", "hi")
    clash = m.alias("a").join(m.alias("b"), F.expr(
        "a.k = b.k AND a._bucket = b._bucket AND a.lo < b.lo AND b.lo <= a.hi"))
    assert clash.count() == 0
