"""Gap filling that moves gaps only, the pyramid of a series, quarantine, bucketed tables, longer chains."""

import datetime as dtm
import random
import re

from pyspark.sql import Observation, functions as F

from airmon import dims
from airmon.catalog.proxy import Proxy
from airmon.operators import exceedance as exc, reconcile as rec
from airmon.plans import agency, history, teom
from airmon.sources import bucketed, quarantine
from helpers import d, plan, rows, t

SF = "/root/testdata/sf0.001"


# ---- gap filling -------------------------------------------------------------------------------------

HOURS = "abrv string, datetime timestamp_ntz, ws double, wd double, note string"


def test_only_involved_sites_and_hours_with_gaps_move(spark, tmp_path):
    rng = random.Random(3)
    first = dtm.datetime(2024, 1, 1)
    data = [(s, first + dtm.timedelta(hours=h), rng.choice([None, 1.0 * h]), rng.choice([None, 2.0 * h, 3.0 * h]), s + str(h))
            for s in ("DS", "SC", "MS", "KE", "OL", "LT") for h in range(200) if rng.random() < 0.9]
    spark.createDataFrame(data + [("DS", None, None, None, "x"), (None, first, 1.0, None, "y")], HOURS).write.parquet(f"{tmp_path}/h")
    df = spark.read.parquet(f"{tmp_path}/h")
    out = rec.gap_fill_from_neighbour(df)
    # by hand: pair after pair
    now = {(s, at): [ws, wd] for s, at, ws, wd, _ in data}
    for target, donor in dims.GAP_FILL_PAIRS:
        for (s, at), v in list(now.items()):
            if s == target and v[1] is None:
                ws, wd = now.get((donor, at), (None, None))
                now[s, at] = [v[0] if v[0] is not None else ws, wd]
    got = {(r.abrv, r.datetime): [r.ws, r.wd] for r in out.collect()}
    assert got == now | {("DS", None): [None, None], (None, first): [1.0, None]} and out.count() == df.count()
    # whatever is exchanged comes from scans restricted to the sites of the pairs; the others have none above them
    text = plan(out)
    passed, moved = text.split("Union")[1].split("FileScan", 1)
    assert "Exchange" not in passed
    scans = re.findall(r"FileScan.*", moved)[1:]
    assert scans and all("In(abrv, [" in s for s in scans)
    assert "Window" not in text


def test_gap_fill_twice_changes_nothing(spark):
    p = Proxy(spark, SF)
    once = rec.gap_fill_from_neighbour(p.demixed.select("abrv", "datetime", "pm10", "ws", "wd")).cache()
    order = ("abrv", "datetime")
    assert rows(rec.gap_fill_from_neighbour(once), *order) == rows(once, *order)


# ---- pyramid -----------------------------------------------------------------------------------------

def test_every_level_has_the_envelope_of_the_readings(spark):
    rng = random.Random(6)
    first = dtm.datetime(2020, 1, 1)
    data = [(s, first + dtm.timedelta(hours=rng.randrange(30_000)), float(rng.randrange(500))) for s in "ab" for _ in range(400)]
    df = spark.createDataFrame(data + data[:9] + [("a", None, 1.0), ("a", first, None)], "abrv string, datetime timestamp_ntz, pm10 double")
    got = exc.continuity_pyramid(df, levels=5).collect()
    origin = dtm.datetime(1, 1, 1)
    for level in range(5):
        width = dtm.timedelta(hours=8 ** (level + 1))
        want = {}
        for s, at, v in data + data[:9]:
            want.setdefault((s, origin + (at - origin) // width * width), []).append((at, v))
        mine = {(r.abrv, r.start): (r.first, r.last, r.low, r.high, r.n, r.from_time, r.to_time) for r in got if r.level == level}
        assert mine == {k: (min(x)[1], max(x)[1], min(v for _, v in x), max(v for _, v in x), len(x), min(x)[0], max(x)[0]) for k, x in want.items()}


def test_a_view_has_a_bounded_number_of_points(spark):
    first = dtm.datetime(2000, 1, 1)
    df = spark.range(0, 50_000).select(F.lit("a").alias("abrv"), F.col("id").cast("double").alias("pm10"),
                                       (F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("datetime"))
    pyramid = exc.continuity_pyramid(df).cache()
    for hours in (10, 1000, 49_999):
        view = exc.continuity_view(pyramid, first, first + dtm.timedelta(hours=hours), points=200)
        found = view.agg(F.count("*"), F.countDistinct("level"), F.min("low"), F.max("high")).first()
        assert found[0] <= 200 and found[1] == 1 and found[2] == 0 and found[3] >= hours


def test_the_series_is_not_sorted_by_the_operator(spark):
    assert "rangepartitioning" not in plan(exc.continuity_series(Proxy(spark, SF).demixed))


# ---- quarantine --------------------------------------------------------------------------------------

def checked(spark, tmp_path, name, text, layout):
    (tmp_path / name).write_text(text)
    return quarantine.checked(spark, str(tmp_path / name), layout)


def reasons(df):
    return [tuple(r[quarantine.REASONS]) for r in df.collect()]


def test_faults_are_named_and_missing_values_are_none(spark, tmp_path):
    head = "Site.Num,Date.Local,X24.Hour.Local,Sample.Measurement,Sample.Duration,Method.Description\n"
    df = checked(spark, tmp_path, "api.csv", head + "29,2017-01-01,01:00,5.5,1 HOUR,TEOM\n29,2017-01-01,02:00,NA,1 HOUR,TEOM\n"
                 ",2017-13-01,24:00,five,1 HOUR,TEOM\n29,2017-01-01\n29,2017-01-01,03:00, 7 ,1 HOUR,TEOM\n", quarantine.LAYOUTS["api_csv"])
    assert reasons(df) == [(), (), ("Site.Num: missing", "Date.Local: no date", "X24.Hour.Local: no clock", "Sample.Measurement: no number"),
                           ("record: no row of this layout", "X24.Hour.Local: missing"), ()]


def test_every_layout_takes_good_rows(spark, tmp_path):
    good = {
        "met": ("date,hour,ws_10m,wd_10m\n", "1/2/2017,100,1.5,90\n1/2/17,2400,NA,\n", "1/2/2017,130,1,1\n32/1/2017,100,1,x\n",
                [("hour: no hour code",), ("date: no short date", "wd_10m: no number")]),
        "flux": ("datetime,csc,sand_flux,invalid\n", "2018-02-01 00:05:00,c,1.5,FALSE\n", "2018-02-01,c,1.5,maybe\n",
                 [("datetime: no local time", "invalid: no truth")]),
    }
    for name, (head, rows_, bad, want) in good.items():
        assert reasons(checked(spark, tmp_path, name, head + rows_ + bad, quarantine.LAYOUTS[name])) == [()] * rows_.count("\n") + want, name
    sheet = quarantine.workbook_layout(["date", "hour", "KE"])
    (tmp_path / "sheet").write_text("41000,100,1.5\n2012-04-01,200,-9999\n41000,300,bad\n,,\n")
    assert reasons(quarantine.checked(spark, str(tmp_path / "sheet"), sheet, header=False)) == [
        (), (), ("KE: no number",), ("date: missing", "hour: missing")]
    (tmp_path / "json").write_text('{"Site Num": "0029", "Date GMT": "2020-01-01", "24 Hour GMT": "10:00"}\n{"Site Num": broken\n')
    assert reasons(quarantine.checked(spark, str(tmp_path / "json"), quarantine.LAYOUTS["api_json"])) == [
        (), ("record: no row of this layout", "Site Num: missing", "Date GMT: missing", "24 Hour GMT: missing")]


def test_one_pass_lands_quarantines_and_counts(spark, tmp_path):
    layout, out, seen = quarantine.LAYOUTS["met"], str(tmp_path / "out"), Observation()
    df = checked(spark, tmp_path, "met.csv", "date,hour,ws_10m,wd_10m\n1/2/2017,100,1.5,90\n1/2/2017,x,1.5,90\n1/3/2017,x,1.5,y\n", layout)
    quarantine.land(df, out, seen)
    assert seen.get == {"rows": 3, "quarantine": 2}
    assert rows(quarantine.landed(spark, out, layout)) == [("1/2/2017", "100", "1.5", "90")]
    bad = quarantine.landed(spark, out, layout, "quarantine")
    assert bad.count() == 2 and all(r[quarantine.FILE].endswith("met.csv") for r in bad.collect())
    assert sorted((r.file.split("/")[-1], r.reason, r["count"]) for r in quarantine.fault_counts(bad).collect()) == [
        ("met.csv", "hour: no hour code", 2), ("met.csv", "wd_10m: no number", 1)]


# ---- bucketed tables ---------------------------------------------------------------------------------

def test_joins_on_stored_site_hours_move_nothing(spark):
    p = Proxy(spark, SF)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = ("abrv", "datetime", "date", "ws", "wd", "pm10", "onlake_wd", "valid")
        plain = [p.source(v).select(*columns) for v in (True, False)]
        stored = [bucketed.store_by_site_hour(x, 4) for x in plain]
        met = p.met_table.join(p.deployments, "deployment_id").select("abrv", "datetime", F.col("ws_10m").alias("ws"), F.col("wd_10m").alias("wd"))
        met_stored = bucketed.store_by_site_hour(met, 4)
        hours = rec.reconcile_sources(*stored)
        assert "Exchange" not in plan(hours)
        order = ("abrv", "datetime")
        assert rows(hours.select(*columns), *order) == rows(rec.reconcile_sources(*plain).select(*columns), *order)
        pm, other = (x.select("abrv", "datetime", "pm10") for x in (stored[0], plain[0]))
        assert "Exchange" not in plan(rec.attach_met(pm, met_stored))
        assert rows(rec.attach_met(pm, met_stored), *order) == rows(rec.attach_met(other, met), *order)
        # the first row of a site-hour is found inside its bucket, too
        from airmon.operators.quality import dedup_site_hour
        assert "Exchange" not in plan(dedup_site_hour(stored[0], ["pm10"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


# ---- chains ------------------------------------------------------------------------------------------

def test_splice_keeps_each_hour_once(spark):
    columns = "abrv string, datetime timestamp_ntz, pm10 double, ws double, wd double"
    book = spark.createDataFrame([("KE", t("2017-06-30 23:00:00"), 1.0, 1.0, 1.0), ("KE", t("2017-07-01 00:00:00"), 2.0, None, None),
                                  ("KE", t("2017-07-01 01:00:00"), 9.0, 1.0, 1.0), ("ZZ", t("2017-01-01 01:00:00"), 3.0, 1.0, 1.0)], columns)
    live = spark.createDataFrame([("KE", t("2017-07-01 00:00:00"), 8.0, 1.0, 1.0), ("KE", t("2017-07-01 01:00:00"), 4.0, 1.0, 1.0),
                                  ("KE", t("2017-07-01 01:00:00"), 5.0, 1.0, 1.0)], columns)
    sites = spark.createDataFrame([("KE", "Keeler", 1.0, 2.0)], "abrv string, deployment string, x double, y double")
    got = history.spliced_hours(book, live, sites, d("2017-07-01"))
    assert rows(got.select("abrv", "datetime", "pm10", "deployment"), "abrv", "datetime") == [
        ("KE", t("2017-06-30 23:00:00"), 1.0, "Keeler"), ("KE", t("2017-07-01 00:00:00"), 2.0, "Keeler"), ("KE", t("2017-07-01 01:00:00"), 4.0, "Keeler"),
        ("ZZ", t("2017-01-01 01:00:00"), 3.0, None)]


def test_agency_days_have_all_columns(spark):
    stacked = spark.createDataFrame([("0029", d("2017-01-01"), 81102, "x", 5.0, "u"), ("0029", d("2017-01-01"), 81102, "x", 4.0, "u"),
                                     ("9999", d("2017-01-01"), 81102, "x", 4.0, "u"), ("0029", d("2019-01-01"), 81102, "x", 4.0, "u")],
                                    "site_num string, date date, code int, desc string, value double, units string")
    got = agency.agency_days(stacked, "2017-01-01", "2017-12-31")
    assert got.columns == ["date", "abrv", "pm10", "ws_s", "wd_s", "ws_r", "wd_r"]
    assert rows(got) == [(d("2017-01-01"), "NB", 4.0, None, None, None, None)]


def test_flagged_wind_is_left_out_of_usable_hours(spark):
    dust = spark.createDataFrame([("T", t(f"2017-01-01 0{h}:00:00"), 1.0 * h) for h in range(1, 6)], "deployment string, datetime timestamp_ntz, pm10 double")
    analog = spark.createDataFrame([(1, t(f"2017-01-01 0{h}:00:00"), 1.0, None if h == 4 else 2.0) for h in range(1, 5)],
                                   "deployment_id int, datetime timestamp_ntz, ws_wvc double, wd_wvc double")
    names = spark.createDataFrame([(1, "T")], "deployment_id int, deployment string")
    flags = spark.createDataFrame([(1, 117, t("2017-01-01 01:30:00"), t("2017-01-01 02:30:00"))],
                                  "deployment_id int, field_id int, start_datetime timestamp_ntz, end_datetime timestamp_ntz")
    hours = teom.flagged_wind_hours(dust, analog, names, flags, "2017-01-01", "2017-01-01", ["T"])
    assert rows(hours.select("pm10", "invalid_ws", "invalid_wd"), "pm10") == [(1.0, False, False), (2.0, False, True), (3.0, False, False), (4.0, False, False)]
    assert sorted(r.pm10 for r in teom.usable_wind_hours(hours).collect()) == [1.0, 3.0]
