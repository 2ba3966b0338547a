import json

from airmon import schemas
from airmon.dims import EXPORT_SITES
from airmon.sources import files, sinks, snapshot, tables
from helpers import d, plan, rows, t


def test_mixed_dates_and_crlf(spark, tmp_path):
    f = tmp_path / "met.csv"
    f.write_bytes(b"date,hour,ws_10m,wd_10m\r\n11/30/2011,100,0.9,218.9\r\n11/30/2011,2400,16.4,353.8\r\n"
                  b"6/9/2012,2300,15.7,27\r\n03/31/17,100,17.46,21.80\r\n")
    assert rows(files.read_hour_code_csv(spark, str(f)), "datetime") == [
        (t("2011-11-30 01:00:00"), 0.9, 218.9), (t("2011-12-01 00:00:00"), 16.4, 353.8),
        (t("2012-06-09 23:00:00"), 15.7, 27.0), (t("2017-03-31 01:00:00"), 17.46, 21.8)]


def test_wide_workbook_skips_its_preamble(spark, tmp_path):
    f = tmp_path / "sheet.csv"
    f.write_text("Model update\n,,,\nunits,ug,ug,x\n\nDATE,HOUR,KE,Lookup\n42736,100,5.5,a\n42736,2400,-9999,b\n")
    got = files.read_wide_workbook(spark, str(f), ["date", "hour", "KE", "Lookup"], ["date", "hour", "KE"])
    assert rows(got, "hour") == [(42736, 100, 5.5), (42736, 2400, -9999.0)]


def test_api_json_arrays(spark, tmp_path):
    row = {"State Code": "06", "County Code": "027", "Site Num": "0029", "Parameter Code": "81102",
           "Date GMT": "2017-11-05", "24 Hour GMT": "08:00", "Sample Measurement": "12.5"}
    (tmp_path / "a.json").write_text(json.dumps([row, {**row, "24 Hour GMT": "09:00"}, {**row, "Site Num": "9999"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"State Code": "END OF FILE"}], indent=1))
    got = files.read_aqs_json(spark, str(tmp_path), ["0029"], multi_line=True)
    assert [r.datetime for r in got.collect()] == [t("2017-11-05 01:00:00")] * 2
    assert {"site_num", "parameter_code", "24_hour_gmt"} <= set(got.columns)


def test_api_csv(spark, tmp_path):
    f = tmp_path / "y.csv"
    f.write_text("Site.Num,Date.Local,X24.Hour.Local,Sample.Measurement,Sample.Duration,Method.Description\n"
                 "29,2017-01-02,00:00,5,1 HOUR,R&P TEOM 1400\n29,2017-01-01,05:00,6,1 HOUR,BAM\n7,2017-01-01,05:00,6,1 HOUR,TEOM\n")
    assert rows(files.read_aqs_api_csv(spark, str(f)).select("abrv", "pm10", "date", "year")) == [("NB", 5.0, d("2017-01-01"), 2017)]


def _bulk_line(state, county, site, value, schema, value_col):
    cells = {"State Code": state, "County Code": county, "Site Num": site, "Parameter Code": "81102",
             "Parameter Name": "PM10", "Date GMT": "2017-01-01", "Date Local": "2017-01-01", "Time GMT": "08:00",
             value_col: value, "Units of Measure": "ug"}
    return ",".join(f'"{cells.get(f.name, "")}"' for f in schema)


def test_bulk_stack(spark, tmp_path):
    for name, schema, col in (("hourly", schemas.BULK_HOURLY, "Sample Measurement"), ("daily", schemas.BULK_DAILY, "Arithmetic Mean")):
        head = ",".join(f'"{f.name}"' for f in schema)
        for year in (2016, 2017):
            lines = [head, _bulk_line("06", "027", "0021", "5.5", schema, col), _bulk_line("06", "029", "0021", "1", schema, col),
                     _bulk_line("32", "027", "0021", "1", schema, col), _bulk_line("06", "027", "0099", "1", schema, col)]
            (tmp_path / f"{name}_{year}.csv").write_text("\n".join(lines) + "\n")
    hourly = files.stack_aqs_hourly(spark, f"{tmp_path}/hourly_*.csv")
    assert rows(hourly) == [("0021", d("2017-01-01"), "08:00", 81102, "PM10", 5.5, "ug", None)] * 2
    assert hourly.drop("poc").schema == schemas.AGENCY_HOURLY
    daily = files.stack_aqs_daily(spark, f"{tmp_path}/daily_*.csv")
    assert rows(daily) == [("0021", d("2017-01-01"), 81102, "PM10", 5.5, "ug")] * 2
    out = f"{tmp_path}/stacked"
    sinks.write_stacked_aqs(hourly, out)
    assert spark.read.parquet(out).filter("year = 2017").count() == 2


def test_stacked_round_trip(spark, tmp_path):
    f = tmp_path / "h.csv"
    f.write_text("site,date,hour,code,desc,value,units\n0029,2017-01-01,08:00,81102,PM10,5,ug\n")
    assert rows(files.agency_long(files.read_aqs_hourly(spark, str(f))).select("abrv", "datetime", "date")) == [
        ("NB", t("2017-01-01 00:00:00"), d("2016-12-31"))]
    g = tmp_path / "d.csv"
    g.write_text("site,date,code,desc,value,units\n0029,2017-01-01,81102,PM10,5,ug\n")
    assert rows(files.read_aqs_daily(spark, str(g))) == [("0029", d("2017-01-01"), 81102, "PM10", 5.0, "ug")]


def test_flux_csv(spark, tmp_path):
    f = tmp_path / "f.csv"
    f.write_text("datetime,csc,sand_flux,invalid\n2018-02-01 00:05:00,1313,0.5,false\n")
    assert rows(files.read_flux_csv(spark, str(f))) == [(t("2018-02-01 00:05:00"), "1313", 0.5, False)]


def test_reader_filters_reach_the_scan(spark, tmp_path):
    raw = spark.createDataFrame([
        (1, t("2017-01-01 00:00:00"), "Keeler", 1.0, 10.0, 5.0, True), (2, t("2017-01-02 00:00:00"), "Keeler", 1.0, 10.0, 5.0, True),
        (3, t("2017-01-02 00:00:00"), "Keeler", 1.0, 10.0, 6.0, True), (4, t("2017-01-02 00:00:00"), "Elsewhere", 1.0, 10.0, 6.0, True),
        (5, t("2017-03-12 02:00:00"), "Keeler", 1.0, 10.0, 6.0, True), (6, t("2017-01-01 05:00:00"), "Keeler", 1.0, 10.0, float("nan"), True),
    ], "event_id long, datetime timestamp_ntz, site string, aspd double, dir double, teom double, from_lake boolean")
    raw.withColumn("unused", raw.dir).write.parquet(f"{tmp_path}/raw")
    got = tables.read_preliminary(tables.open_table(spark, f"{tmp_path}/raw"), "2017-01-01", "2017-04-01", ["KE"], order=["event_id"])
    assert rows(got.select("abrv", "datetime", "date", "pm10", "valid")) == [
        ("KE", t("2017-01-02 00:00:00"), d("2017-01-01"), 5.0, False)]
    text = plan(got)
    pushed = [line for line in text.splitlines() if "PushedFilters" in line][0]
    assert "GreaterThanOrEqual(datetime" in pushed and "LessThan(datetime" in pushed and "site" in pushed
    assert "unused" not in text and "Python" not in text


def test_teom_eras(spark):
    cols = "datetime timestamp_ntz, deployment string, {} double, invalid boolean"
    old = spark.createDataFrame([(t("2017-09-20 01:00:00"), "Haiwee", 1.0, False), (t("2017-09-20 02:00:00"), "Haiwee", 1.0, True)], cols.format("pm10_std_avg"))
    new = spark.createDataFrame([(t("2017-10-01 01:00:00"), "Haiwee", 2.0, False), (t("2017-10-01 01:00:00"), "Other", 2.0, False)], cols.format("pm10_1hour_stp"))
    def read(a, b):
        return [r.pm10 for r in tables.read_teom_by_era(old, new, a, b, "2017-09-26", ["Haiwee"]).orderBy("datetime").collect()]
    assert read("2017-01-01", "2017-12-31") == [1.0, 2.0]
    assert read("2017-01-01", "2017-09-26") == [1.0]
    assert read("2017-09-27", "2017-12-31") == [2.0]


def test_snapshot_is_only_refreshed_when_asked(spark, tmp_path):
    p = f"{tmp_path}/snap"
    snapshot.snapshot(spark.range(3), p)
    assert snapshot.snapshot(spark.range(9), p, refresh=False).count() == 3
    assert snapshot.snapshot(spark.range(9), p).count() == 9


def test_daily_wide_csv(spark, tmp_path):
    df = spark.createDataFrame([(d("2017-01-01"), t("2017-01-02 00:00:00"), "Keeler", 5.0), (d("2017-01-01"), t("2017-01-01 01:00:00"), "Olancha", 6.0),
                                (d("2017-01-03"), t("2017-01-03 01:00:00"), "Keeler", 7.0), (d("2017-01-09"), t("2017-01-09 01:00:00"), "Keeler", 8.0)],
                               "date date, datetime timestamp_ntz, deployment string, pm10 double")
    out = tmp_path / "daily"
    sinks.write_daily_wide_csv(df, str(out), days=["2017-01-01", "2017-01-03"])
    assert sorted(x.name for x in out.glob("pm10/date=*")) == ["date=2017-01-01", "date=2017-01-03"]
    part, = out.glob("pm10/date=2017-01-01/*.csv")
    lines = part.read_text().splitlines()
    assert lines[0] == ",".join(["datetime", *EXPORT_SITES])
    assert [x[:19] for x in lines[1:]] == ["2017-01-01T01:00:00", "2017-01-02T00:00:00"]


def test_sorted_csv(spark, tmp_path):
    out = tmp_path / "sorted"
    sinks.write_sorted_csv(spark.range(1000).selectExpr("(id * 37) % 1000 AS datetime"), str(out))
    values = [int(x) for f in sorted(out.glob("part-*.csv")) for x in f.read_text().splitlines()[1:]]
    assert values == list(range(1000))


def test_agency_hours_over_the_autumn_change(spark):
    from airmon.plans import agency
    from airmon.schemas import AGENCY_HOURLY

    def row(hour, code, value, site="0029"):
        return (site, d("2017-11-05"), hour, code, "x", value, "u")

    stacked = spark.createDataFrame([
        row("09:00", 81102, 2.0), row("08:00", 81102, 1.0), row("08:00", 61101, 10.0), row("10:00", 81102, 3.0),
        row("10:00", 61104, 90.0), row("10:00", 61102, 80.0), row("07:00", 81102, 9.0), row("08:00", 81102, 7.0, "9999"),
    ], AGENCY_HOURLY)
    got = agency.agency_hours(stacked, "2017-11-05", "2017-11-05")
    # 07:00 UTC is local midnight and closes the day before
    assert rows(got.select("abrv", "datetime", "ws", "wd", "pm10"), "datetime") == [
        ("NB", t("2017-11-05 01:00:00"), 5.144, None, 1.0), ("NB", t("2017-11-05 02:00:00"), None, 90.0, 3.0)]
