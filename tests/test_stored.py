"""Writers told what they cover, the one-pass report, day sums by batches, gaps over bucket edges."""

import datetime as dtm
import random
import re

import pytest
from pyspark.sql import functions as F

from airmon.catalog.proxy import Proxy
from airmon.operators import aggregate as agg, daystate as ds
from airmon.plans import rolling, shoreline
from airmon.sources import sinks
from airmon.sources.published import Published
from airmon.sources.snapshot import settle
from helpers import d, plan, rows, t

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def proxy(spark):
    return Proxy(spark, SF)


def test_plain_writers_remove_covered_parts_without_rows(spark, tmp_path):
    def day(*days):
        return spark.createDataFrame([(d(x), 1) for x in days], "date date, n int")
    def stored(name):  # noqa: E306
        return sorted(x.name.split("=")[1] for x in (tmp_path / name).glob("*=*"))
    sinks.write_report_tables({"report": day("2020-01-01", "2020-01-02", "2020-02-01")}, str(tmp_path))
    sinks.write_report_tables({"report": day("2020-01-02")}, str(tmp_path), covers=[d("2020-01-01"), d("2020-01-02"), d("2020-01-03")])
    assert stored("report") == ["2020-01-02", "2020-02-01"]
    sinks.write_report_tables({"report": day().limit(0)}, str(tmp_path), covers=[d("2020-01-02")])
    assert stored("report") == ["2020-02-01"]
    for years in (["2018-01-01", "2019-01-01"], ["2019-01-01"]):
        sinks.write_stacked_aqs(spark.createDataFrame([(d(y),) for y in years], "date_utc date"), f"{tmp_path}/stacked", years=[2018, 2019])
    assert stored("stacked") == ["2019"]
    hours = spark.createDataFrame([(d(x), t(f"{x} 01:00:00"), "Keeler", 5.0) for x in ("2020-01-01", "2020-01-02")],
                                  "date date, datetime timestamp_ntz, deployment string, pm10 double")
    both = [d("2020-01-01"), d("2020-01-02")]
    sinks.write_daily_wide_csv(hours, str(tmp_path / "daily"), days=both)
    sinks.write_daily_wide_csv(hours.filter("date > '2020-01-01'"), str(tmp_path / "daily"), days=both)
    assert stored("daily/pm10") == ["2020-01-02"]


@pytest.mark.parametrize("strict", [False, True])
def test_one_pass_report_equals_the_tables(spark, proxy, strict):
    blind = F.when(~F.col("abrv").isin("DS", "NB"), F.col("onlake"))
    hours = settle(proxy.classified.withColumn("onlake", blind))
    one = settle(shoreline.report_rows(hours, proxy.site, strict))
    for name, table in shoreline.report_tables(hours, proxy.site, strict).items():
        columns = ["date", *(c.split()[0] for c in shoreline.REPORT[name].split(", "))]
        got = one.filter(F.col("table") == name).select(columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, table.select(columns).collect())), name
        assert [x.split()[1] for x in shoreline.REPORT[name].split(", ")] == [got.schema[c].dataType.simpleString().replace("bigint", "long") for c in columns[1:]]


def test_one_pass_report_has_one_scan_and_one_exchange(spark, proxy, tmp_path):
    proxy.classified.write.parquet(f"{tmp_path}/hours")
    text = plan(shoreline.report_rows(spark.read.parquet(f"{tmp_path}/hours"), proxy.site))
    assert len(re.findall("FileScan", text)) == 1
    assert len(re.findall("Exchange hashpartitioning", text)) == 1 and "hashpartitioning(date" in text


def test_a_withdrawn_day_leaves_every_report_table(spark, proxy, tmp_path):
    store, hours = Published(spark, str(tmp_path)), settle(proxy.classified)
    every, day = (d("2024-01-01"), d("2024-12-31")), d("2024-01-12")
    shoreline.publish_report(store, hours, proxy.site, every)
    assert all(day in {r.date for r in shoreline.read_report(store, n).select("date").collect()} for n in shoreline.REPORT)
    shoreline.publish_report(store, hours.filter(F.col("date") != day), proxy.site, (day, day))
    for name in shoreline.REPORT:
        days = {r.date for r in shoreline.read_report(store, name).select("date").collect()}
        assert day not in days and len(days) > 20


# ---- day sums -----------------------------------------------------------------------------------------

READING = "event_id long, abrv string, datetime timestamp_ntz, date date, ws double, wd double, pm10 double, onlake_wd boolean, valid boolean"


def random_readings(seed, n=3000):
    rng = random.Random(seed)
    first = dtm.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        at = first + dtm.timedelta(hours=rng.randrange(1, 24 * 6))
        wd = rng.choice([None, float(rng.randrange(360))])
        out.append((i, rng.choice(["KE", "SC", "XX"]), at, (at - dtm.timedelta(seconds=1)).date(), 1.0, wd, rng.randrange(0, 50000) / 100, None, rng.random() < 0.4))
    rng.shuffle(out)
    return out


def test_state_after_batches_equals_one_pass(spark, proxy, tmp_path):
    data = random_readings(1)
    whole = spark.createDataFrame(data, READING)
    days = rolling.RollingDays(Published(spark, f"{tmp_path}/a"), proxy.sectors)
    # three batches; the last has late hours of the first day and readings that win over stored ones
    for part in (data[:1500], data[1500:2400], data[2400:]):
        days.add(spark.createDataFrame(part, READING))
    once = rolling.RollingDays(Published(spark, f"{tmp_path}/b"), proxy.sectors)
    once.add(whole)
    columns = ["date", "abrv", *ds.MEASURES]
    got = rows(days.state().select(columns), "date", "abrv")
    assert got == rows(once.state().select(columns), "date", "abrv") and len(got) == 18
    hours = days._classified(whole)
    from airmon.operators.quality import drop_mixed_preliminary
    best = drop_mixed_preliminary(hours)
    order = ("date", "abrv")
    for mine, theirs in ((ds.daily_avg_of, agg.daily_avg), (ds.contribution_of, agg.onlake_contribution),
                         (ds.conditional_means_of, agg.sector_conditional_means), (ds.daily_contribution_of, agg.daily_contribution)):
        want = theirs(best)
        assert rows(mine(days.state()).select(want.columns), *order) == rows(want, *order), theirs.__name__


def test_a_batch_touches_its_own_days_only(spark, proxy, tmp_path):
    days = rolling.RollingDays(Published(spark, str(tmp_path)), proxy.sectors)
    data = random_readings(2, 600)
    days.add(spark.createDataFrame(data, READING))
    before = days.store.entries()
    late = [(-1, "KE", dtm.datetime(2024, 1, 3, 5), d("2024-01-03"), 1.0, 200.0, 77.0, None, True)]
    assert days.add(spark.createDataFrame(late, READING)) == [d("2024-01-03")]
    now = days.store.entries()
    assert {k for k in now if now[k] != before.get(k)} == {("hours", "2024-01-03"), ("days", "2024-01-03")}
    assert days.add(spark.createDataFrame([], READING)) == []


def test_states_merge_in_any_order_and_back(spark):
    hours = [(d("2024-01-01"), "KE", x / 100, x % 2 == 0, x % 3 == 0 if x % 5 else None, None) for x in range(200)]
    df = spark.createDataFrame(hours, "date date, abrv string, pm10 double, valid boolean, onlake boolean, dunes boolean")
    a, b = df.filter("pm10 < 0.7"), df.filter("pm10 >= 0.7")
    whole = ds.day_state(df).select(*ds.MEASURES).collect()
    assert ds.merge_states(ds.day_state(b), ds.day_state(a)).select(*ds.MEASURES).collect() == whole
    assert ds.merge_states(ds.day_state(df), ds.day_state(b, taken_back=True)).select(*ds.MEASURES).collect() == ds.day_state(a).select(*ds.MEASURES).collect()
    assert ds.merge_states(ds.day_state(df), ds.day_state(df, taken_back=True)).count() == 0
    assert ds.changes(df, df).count() == 0


# ---- gaps ---------------------------------------------------------------------------------------------

def test_gaps_over_the_edges_of_buckets(spark):
    rng = random.Random(9)
    first = dtm.datetime(1, 1, 1)
    data, want = [], []
    for site in ("a", "b"):
        at = sorted({rng.randrange(0, 87_000_000) for _ in range(40)} | {511, 512, 1024, 262143, 262144, 262146} | set(range(5000, 7000)))
        data += [(site, first + dtm.timedelta(hours=h)) for h in at]
        want += [(site, first + dtm.timedelta(hours=p + 1), first + dtm.timedelta(hours=h - 1), h - p - 1) for p, h in zip(at, at[1:]) if h > p + 1]
    df = spark.createDataFrame(data + data[:5] + [("a", None)], "abrv string, datetime timestamp_ntz")
    assert sorted(rows(agg.missing_ranges(df))) == sorted(want)
    assert agg.missing_ranges(df.limit(0)).count() == 0


def test_no_gap_window_spans_a_record(spark, proxy):
    windows = re.findall(r"Window \[.*", plan(agg.missing_ranges(proxy.record)))
    assert windows and all("bucket" in w for w in windows)
