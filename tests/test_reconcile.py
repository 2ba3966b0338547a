import datetime as dtm
import random

from pyspark.sql import functions as F

from airmon import dims
from airmon.operators import quality as qc, reconcile as rec
from helpers import d, rows, t

SRC = ("abrv string, datetime timestamp_ntz, date date, ws double, wd double, pm10 double, onlake_wd boolean, valid boolean")
H1, H2 = t("2017-01-01 01:00:00"), t("2017-01-01 02:00:00")


def test_coalesce_is_per_column(spark):
    v = spark.createDataFrame([("KE", H1, d("2017-01-01"), 2.0, None, 10.0, None, True)], SRC)
    p = spark.createDataFrame([
        ("KE", H1, d("2017-01-01"), 9.0, 200.0, 99.0, True, False), ("OL", H2, d("2017-01-01"), 1.0, 1.0, 1.0, False, False)], SRC)
    got = rows(rec.reconcile_sources(v, p).select("abrv", "ws", "wd", "pm10", "onlake_wd", "valid"), "abrv")
    assert got == [("KE", 2.0, 200.0, 10.0, True, True), ("OL", 1.0, 1.0, 1.0, False, False)]


def test_one_pass_equals_dedup_and_join(spark):
    rnd = random.Random(3)
    base = t("2017-01-01 00:00:00")
    data = [(i, "KE" if rnd.random() < 0.4 else rnd.choice(["OL", "DS"]), base + dtm.timedelta(hours=rnd.randrange(1, 60)),
             rnd.choice([None, float(i)]), rnd.choice([None, float(i)]), float(i), rnd.choice([None, True, False]), rnd.random() < 0.5)
            for i in range(500)]
    df = spark.createDataFrame(data, "event_id long, abrv string, datetime timestamp_ntz, ws double, wd double, pm10 double, onlake_wd boolean, valid boolean")
    dated = df.withColumn("date", (F.col("datetime") - F.expr("INTERVAL 1 SECOND")).cast("date"))
    joined = rec.reconcile_sources(
        qc.dedup_site_hour(dated.filter("valid"), ["event_id"]), qc.dedup_site_hour(dated.filter("NOT valid"), ["event_id"]))
    cols = ["abrv", "datetime", "date", "ws", "wd", "pm10", "onlake_wd", "valid"]
    one = rec.reconcile_hours(df, "event_id").select(*cols)
    assert rows(one, "abrv", "datetime") == rows(joined.select(*cols), "abrv", "datetime")
    keys = df.select("abrv", "datetime").distinct().count()
    assert one.count() == keys


def test_gap_fill_chain(spark):
    df = spark.createDataFrame([
        ("DS", H1, None, None), ("SC", H1, 3.0, 30.0), ("MS", H1, 5.0, None), ("KE", H1, 7.0, 70.0),
        ("DS", H2, 1.0, 10.0), ("SC", H2, None, None), ("MS", H2, 5.0, 50.0),
        ("OL", H2, None, None),
    ], "abrv string, datetime timestamp_ntz, ws double, wd double")
    got = {(r.abrv, r.datetime): (r.ws, r.wd) for r in rec.gap_fill_from_neighbour(df).collect()}
    assert got[("DS", H1)] == (3.0, 30.0)
    assert got[("MS", H1)] == (5.0, 70.0)
    assert got[("SC", H2)] == (1.0, 10.0)
    assert got[("MS", H2)] == (5.0, 50.0)
    assert got[("OL", H2)] == (None, None)
    assert len(got) == df.count()


def test_gap_fill_feeds_the_next_pair(spark):
    df = spark.createDataFrame([("A", H1, 1.0, 11.0), ("B", H1, None, None), ("C", H1, None, None)],
                               "abrv string, datetime timestamp_ntz, ws double, wd double")
    got = {r.abrv: r.wd for r in rec.gap_fill_from_neighbour(df, [("B", "A"), ("C", "B")]).collect()}
    assert got == {"A": 11.0, "B": 11.0, "C": 11.0}
    back = {r.abrv: r.wd for r in rec.gap_fill_from_neighbour(df, [("C", "B"), ("B", "A")]).collect()}
    assert back == {"A": 11.0, "B": 11.0, "C": None}


def test_reference_fill_is_per_column(spark):
    df = spark.createDataFrame([("MS", H1, None, 5.0), ("KE", H1, 2.0, None), ("OL", H1, None, None)],
                               "abrv string, datetime timestamp_ntz, ws double, wd double")
    ref = spark.createDataFrame([(H1, 8.0, 80.0)], "datetime timestamp_ntz, ws double, wd double")
    assert rows(rec.gap_fill_from_reference(df, ref).select("abrv", "ws", "wd"), "abrv") == [
        ("KE", 2.0, 80.0), ("MS", 8.0, 5.0), ("OL", None, None)]


def _dated(spark, name, dates):
    return spark.createDataFrame([(name, d(x)) for x in dates], "src string, date date")


def test_priority_splice(spark):
    primary = _dated(spark, "p", ["2016-12-30", "2016-12-31", "2017-05-01", "2017-05-02"])
    fallback = _dated(spark, "f", ["2016-06-01", "2017-04-30", "2017-05-01", "2017-05-02", "2017-06-01", "2018-01-05"])
    extra = _dated(spark, "x", ["2016-01-01"])
    got = rows(rec.priority_splice(primary, fallback, extra), "date", "src")
    assert [(s, str(x)) for s, x in got] == [
        ("x", "2016-01-01"), ("p", "2016-12-30"), ("p", "2016-12-31"), ("p", "2017-05-01"),
        ("f", "2017-05-02"), ("f", "2017-06-01"), ("f", "2018-01-05")]


def test_history_live_splice(spark):
    stamps = ["2017-06-30 23:00:00", "2017-07-01 00:00:00", "2017-07-01 01:00:00"]
    h = spark.createDataFrame([("h", t(x)) for x in stamps], "s string, datetime timestamp_ntz")
    l = spark.createDataFrame([("l", t(x)) for x in stamps], "s string, datetime timestamp_ntz")
    assert [(r.s, r.datetime.hour) for r in rec.history_live_splice(h, l, "2017-07-01").orderBy("datetime").collect()] == [
        ("h", 23), ("h", 0), ("l", 1)]


def test_after_last_and_tail(spark):
    a = spark.createDataFrame([("CJ", d("2017-01-01"), 1.0), ("KE", d("2017-01-05"), 1.0)], "abrv string, date date, pm10_24 double")
    b = spark.createDataFrame([("CJ", d("2017-01-01"), 2.0), ("CJ", d("2017-01-02"), 2.0), ("KE", d("2017-01-09"), 2.0),
                               ("ZZ", d("2000-01-01"), 2.0)], "abrv string, date date, pm10_24 double")
    tail = rows(rec.append_daily_tail(a, b, "CJ"), "abrv", "date")
    assert [(x[0], str(x[1])) for x in tail] == [("CJ", "2017-01-01"), ("CJ", "2017-01-02"), ("KE", "2017-01-05")]
    assert rec.after_last_of(b, a.filter("abrv = 'none'")).count() == 4
    per_site = rows(rec.after_last_of(b, a, site="abrv"), "abrv", "date")
    assert [(x[0], str(x[1])) for x in per_site] == [("CJ", "2017-01-02"), ("KE", "2017-01-09"), ("ZZ", "2000-01-01")]


def test_networks_and_overrides(spark):
    deps = spark.createDataFrame([(1, "Haiwee"), (2, "T29"), (3, "T30")], "deployment_id int, deployment string")
    net = spark.createDataFrame([(1,), (2,), (2,)], "deployment_id int")
    assert [r.deployment for r in rec.sites_in_network(deps, net, without=["Haiwee"]).collect()] == ["T29"]
    df = spark.createDataFrame([("OL", d("2017-01-01"), None), ("OL", d("2017-01-02"), False)], "abrv string, date date, onlake boolean")
    fix = dims.local_table(spark, {"abrv": ["OL"], "date": [d("2017-01-01")], "onlake_override": [True]})
    assert [r.onlake for r in rec.override_direction(df, fix).orderBy("date").collect()] == [True, False]


def test_collection_period_ends(spark):
    start, end = t("2018-02-01 00:00:00"), t("2018-02-03 12:00:00")
    periods = spark.createDataFrame([(1, 101, start, end, 10.0, 12.0, None), (2, 102, start, end, 10.0, None, None)],
        "sensit_deployment_id int, csc_deployment_id int, start_datetime timestamp_ntz, collection_datetime timestamp_ntz,"
        " sumpc_total double, dwp_mass double, district_mass double")
    sec = dtm.timedelta(seconds=1)
    counts = spark.createDataFrame([(i, x, 1.0) for i in (1, 2) for x in (start, start + sec, t("2018-02-02 00:00:00"), end, end + sec)],
        "deployment_id int, datetime timestamp_ntz, sumpc double")
    for hours in (1, 24):
        got = rows(rec.flux_interval_join(counts, periods, hours).select("deployment_id", "datetime"), "datetime")
        assert got == [(1, start + sec), (1, t("2018-02-02 00:00:00")), (1, end)]


def test_overlapping_periods_against_brute_force(spark):
    rnd = random.Random(11)
    base = t("2018-02-01 00:00:00")
    ps = []
    for k in range(40):
        lo = base + dtm.timedelta(minutes=rnd.randrange(0, 20000))
        ps.append((rnd.choice([1, 1, 1, 2]), k, lo, lo + dtm.timedelta(minutes=rnd.randrange(1, 9000)), 1.0, 1.0, None))
    cs = [(rnd.choice([1, 1, 2, 3]), base + dtm.timedelta(minutes=5 * rnd.randrange(0, 6000)), 1.0) for _ in range(400)]
    periods = spark.createDataFrame(ps, "sensit_deployment_id int, csc_deployment_id int, start_datetime timestamp_ntz,"
        " collection_datetime timestamp_ntz, sumpc_total double, dwp_mass double, district_mass double")
    counts = spark.createDataFrame(cs, "deployment_id int, datetime timestamp_ntz, sumpc double")
    got = sorted(rows(rec.flux_interval_join(counts, periods).select("deployment_id", "datetime", "csc_deployment_id")))
    want = sorted((c[0], c[1], p[1]) for c in cs for p in ps if c[0] == p[0] and p[2] < c[1] <= p[3])
    assert got == want
