"""Edge cases of time, direction and value columns."""

import pytest
from pyspark.sql import functions as F

from airmon.functions import timecol as tc, values as val
from airmon.operators import quality as qc
from airmon.operators.calendar import with_bucket, with_hour, with_hour_ending_date
from helpers import d, rows, t


def one(spark, schema, values, *cols):
    return tuple(spark.createDataFrame([values], schema).select(*cols).first())


@pytest.mark.parametrize("stamp, date, hour", [
    ("2017-01-02 00:00:00", "2017-01-01", 23),
    ("2017-01-02 01:00:00", "2017-01-02", 0),
    ("2017-01-01 00:00:00", "2016-12-31", 23),
])
def test_midnight_closes_its_day(spark, stamp, date, hour):
    got = one(spark, "dt timestamp_ntz", (t(stamp),), tc.hour_ending_date("dt"), tc.hour_ending_hour("dt"), tc.year_of("dt"))
    assert got == (d(date), hour, d(date).year)


def test_season_uses_the_hour_ending_month(spark):
    df = spark.createDataFrame([(t(x),) for x in (
        "2017-07-01 00:00:00", "2017-07-01 01:00:00", "2017-10-01 00:00:00", "2017-10-01 01:00:00")], "dt timestamp_ntz")
    assert [r[0] for r in df.select(tc.season("dt")).collect()] == ["winter", "summer", "summer", "winter"]


@pytest.mark.parametrize("code, want", [(100, "2011-11-30 01:00:00"), (2300, "2011-11-30 23:00:00"), (2400, "2011-12-01 00:00:00")])
def test_hour_code(spark, code, want):
    got = one(spark, "date date, code int", (d("2011-11-30"), code), tc.hour_code_to_datetime("date", "code"))
    assert got == (t(want),)


def test_excel_serial(spark):
    assert one(spark, "n int", (42736,), tc.excel_serial_date("n")) == (d("2017-01-01"),)


def test_truncate_and_parts(spark):
    got = one(spark, "dt timestamp_ntz, date date, h string", (t("2017-03-12 02:59:59"), d("2017-03-12"), "07:00"),
              tc.truncate_to_hour("dt"), tc.local_from_parts("date", "h"), tc.local_from_parts("date", F.lit("x")),
              tc.local_from_parts("date", F.lit(None).cast("string")))
    assert got == (t("2017-03-12 02:00:00"), t("2017-03-12 07:00:00"), None, None)


def test_daylight_saving(spark):
    df = spark.createDataFrame([(t(x),) for x in (
        "2017-03-12 01:00:00", "2017-03-12 02:00:00", "2017-03-12 03:00:00", "2017-11-05 01:00:00")], "datetime timestamp_ntz")
    assert [r[0].hour for r in qc.drop_nonexistent_local(df).collect()] == [1, 3, 1]
    utc = spark.createDataFrame([(t("2017-11-05 08:00:00"),), (t("2017-11-05 09:00:00"),)], "u timestamp_ntz")
    assert {r[0] for r in utc.select(tc.utc_to_local("u")).collect()} == {t("2017-11-05 01:00:00")}


@pytest.mark.parametrize("lo, hi, wd, inside", [
    *[(227, 33, w, True) for w in (227, 360, 0, 33)], (227, 33, 34, False), (227, 33, 226.9, False), (227, 33, None, None),
    (126, 176, 126, True), (126, 176, 176, True), (126, 176, 125.9, False), (126, 176, None, None),
    (90, 90, 10, True), (0, 360, 0, True), (0, 360, 360, True), (227, 33, 400, False), (227, 33, -5, False),
])
def test_sector(spark, lo, hi, wd, inside):
    got = one(spark, "wd double, lo double, hi double", (None if wd is None else float(wd), float(lo), float(hi)),
              val.angle_between("wd", "lo", "hi"), val.angle_between("wd", lo, hi))
    assert got == (inside, inside)


@pytest.mark.parametrize("site, wd, want", [
    ("ST", None, False), ("KE", None, None), ("KE", 296.0, True), ("KE", 337.1, False), ("ST", 300.0, False)])
def test_dunes(spark, site, wd, want):
    assert one(spark, "wd double, abrv string", (wd, site), val.in_dunes("wd", "abrv")) == (want,)


@pytest.mark.parametrize("wd, sector", [(0.0, 0), (360.0, 0), (348.75, 0), (348.7, 15), (11.24, 0), (11.25, 1), (180.0, 8)])
def test_compass(spark, wd, sector):
    assert one(spark, "wd double", (wd,), val.compass_sector("wd")) == (sector,)


@pytest.mark.parametrize("v, klass, label", [
    (-3.0, 0, "<20"), (20.0, 1, "20-50"), (149.9, 3, "100-150"), (150.0, 4, ">=150"), (None, None, None)])
def test_value_class(spark, v, klass, label):
    breaks = (20.0, 50.0, 100.0, 150.0)
    k = val.value_class("v", breaks)
    assert one(spark, "v double", (v,), k, val.class_label(k, breaks)) == (klass, label)


@pytest.mark.parametrize("v, want", [(149.5, 150.0), (150.5, 150.0), (151.5, 152.0), (150.49999999999997, 150.0), (None, None)])
def test_half_even(spark, v, want):
    assert one(spark, "v double", (v,), val.half_even("v")) == (want,)


def test_flux_rate(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 8.0, 12.0, 6.0), (2, 2.0, 8.0, None, 6.0), (3, 2.0, 0.0, 12.0, 6.0), (4, 2.0, None, 12.0, 6.0)],
        "k int, c double, total double, dwp double, district double")
    got = [r[0] for r in df.orderBy("k").select(val.sand_flux_rate("c", "total", "dwp", "district")).collect()]
    assert got == [2.5, 1.25, 0.0, 0.0]


def test_lookups_and_labels(spark):
    got = one(spark, "c string", ("AP",), val.recode("c", {"AP": "ST"}), val.recode(F.lit("KE"), {"AP": "ST"}),
              val.site_code(F.lit("Mill"), {"MS": "Mill"}), val.site_code(F.lit("?"), {"MS": "Mill"}),
              val.display_label(F.lit("CoJu-696")), val.display_label(F.lit("Keeler")),
              val.flag_color(F.lit(150.0)), val.flag_color(F.lit(151.0)), val.flag_color(F.lit(None).cast("double")))
    assert got == ("ST", "KE", "MS", None, "Coso Junction", "Keeler", "black", "red", None)


def test_period_equals_the_plain_form(spark):
    stamps = ["2016-12-31 23:59:59", "2017-01-01 00:00:00", "2017-01-01 00:00:01", "2017-01-01 00:00:00.5",
              "2017-01-03 00:00:00", "2017-01-03 00:00:00.999999", "2017-01-03 00:00:01"]
    df = spark.createDataFrame([(t(x),) for x in stamps], "datetime timestamp_ntz")
    plain = df.filter(tc.hour_ending_date("datetime").between(d("2017-01-01"), d("2017-01-02")))
    assert rows(qc.filter_period(df, "2017-01-01", "2017-01-02"), "datetime") == rows(plain, "datetime")
    hours = [r[0] for r in qc.filter_hour_range(df, "2017-01-01", "2017-01-02").collect()]
    assert hours == [t("2017-01-03 00:00:00")]


def test_calendar_operators_equal_the_expressions(spark):
    stamps = ["1969-12-31 23:59:59.999999", "1969-06-01 00:00:00", "1970-01-01 00:00:00", "2017-01-02 00:00:00", "2017-01-02 00:00:00.999999",
              "2017-01-02 00:00:01", "2017-03-12 02:30:00", "2017-11-05 01:59:59.5", "2024-02-29 12:00:00"]
    df = spark.createDataFrame([(t(x),) for x in stamps] + [(None,)], "dt timestamp_ntz")
    got = with_hour(with_hour(with_hour_ending_date(df, "dt"), "dt", "h"), "dt", "e", end=True)
    want = df.select("dt", tc.hour_ending_date("dt").alias("date"), tc.truncate_to_hour("dt").alias("h"),
                     (tc.truncate_to_hour("dt") + F.expr("INTERVAL 1 HOUR")).alias("e"))
    assert rows(got, "dt") == rows(want, "dt")
    assert got.columns == want.columns


def test_buckets_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(t(x),) for x in (
        "2017-01-01 06:00:00", "2017-01-01 06:00:00.000001", "2017-01-01 12:00:00", "2017-01-01 12:00:00.000001")], "dt timestamp_ntz")
    ids = [r._bucket for r in with_bucket(df, "dt", 6).orderBy("dt").collect()]
    assert ids[0] != ids[1] == ids[2] != ids[3]
    with pytest.raises(ValueError):
        with_bucket(df, "dt", 5)
