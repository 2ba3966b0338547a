"""Rows that must not be lost, invented or multiplied without a word."""

import pytest
from pyspark.sql import functions as F

from airmon import schemas
from airmon.operators import aggregate as agg, quality as qc, reconcile as rec
from airmon.plans import agency, flux
from airmon.session import clear_scratch, scratch_folder, scratch_path
from airmon.sources import files, sinks, tables
from helpers import d, plan, rows, t

FLAGS = "deployment_id int, field_id int, start_datetime timestamp_ntz, end_datetime timestamp_ntz"


def test_a_flag_without_an_end_is_open_and_a_long_one_is_cheap(spark):
    readings = spark.createDataFrame([(1, t("2020-01-01 05:00:00")), (1, t("2020-01-03 05:00:00")), (2, t("2020-01-02 05:00:00")), (3, None), (4, t("2020-01-02 05:00:00"))],
                                     "deployment_id int, datetime timestamp_ntz")
    flags = spark.createDataFrame([(1, 7, t("2020-01-02 00:00:00"), None), (2, 7, t("1990-01-01 00:00:00"), t("9999-12-31 00:00:00")),
                                   (4, 7, t("2020-01-02 05:00:00"), t("2020-01-02 05:00:00"))], FLAGS)
    got = qc.flag_lookup(readings, flags, {"invalid": 7}, bucket_hours=1)
    assert rows(got, "deployment_id", "datetime") == [
        (1, t("2020-01-01 05:00:00"), False), (1, t("2020-01-03 05:00:00"), True), (2, t("2020-01-02 05:00:00"), True), (3, None, False),
        (4, t("2020-01-02 05:00:00"), False)]
    from airmon.operators.intervals import bucket_intervals, extent_of
    cut = bucket_intervals(flags, "start_datetime", "end_datetime", 1, extent=extent_of(readings, "datetime"))
    assert cut.count() < 100
    assert qc.flag_lookup(readings.limit(0), flags, {"invalid": 7}).count() == 0


def test_nan_is_no_reading(spark):
    df = spark.createDataFrame([(t("2020-01-01 01:00:00"), float("nan")), (t("2020-01-01 02:00:00"), 3.0)], "datetime timestamp_ntz, pm10 double")
    assert qc.qc_bounds(df).count() == 1
    met = spark.createDataFrame([(1, t("2020-01-01 01:00:00"), float("nan"), 2.0)], "deployment_id int, datetime timestamp_ntz, ws_10m double, wd_10m double")
    names = spark.createDataFrame([(1, "Keeler")], "deployment_id int, deployment string")
    assert tables.read_met_hourly(met, names).first().ws is None


def test_a_write_keeps_other_days_years_and_variables(spark, tmp_path):
    def day(x):
        return spark.createDataFrame([(d(x), 1)], "date date, n int")
    for x in ("2020-01-01", "2020-02-01", "2020-02-01"):
        sinks.write_report_tables({"a": day(x)}, f"{tmp_path}/report")
    assert rows(spark.read.parquet(f"{tmp_path}/report/a").select("date"), "date") == [(d("2020-01-01"),), (d("2020-02-01"),)]
    for y in ("2019-01-01", "2020-01-01"):
        sinks.write_stacked_aqs(spark.createDataFrame([(d(y),)], "date_utc date"), f"{tmp_path}/stacked")
    assert sorted(r.year for r in spark.read.parquet(f"{tmp_path}/stacked").collect()) == [2019, 2020]
    hours = spark.createDataFrame([(d("2020-01-01"), t("2020-01-01 01:00:00"), "Keeler", 5.0, 6.0)], "date date, datetime timestamp_ntz, deployment string, pm10 double, ws double")
    for v in ("pm10", "ws"):
        sinks.write_daily_wide_csv(hours, f"{tmp_path}/daily", v)
    assert sorted(x.name for x in (tmp_path / "daily").iterdir() if x.is_dir()) == ["pm10", "ws"]


def test_workbook_serials_and_missing_cells(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("A workbook,,\ndate,hour,KE\n41000,100,1.5\n41000.0,200,2.5\n2012-04-01,300,NA\n,,\n")
    got = files.read_wide_workbook(spark, str(tmp_path / "sheet.csv"), ["date", "hour", "KE"])
    assert rows(got, "hour") == [(41000, 100, 1.5), (41000, 200, 2.5), (41000, 300, None)]


def test_json_rows_without_a_first_cell_stay(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Site Num": "0029", "Date GMT": "2020-01-01", "24 Hour GMT": "10:00"}\n{"State Code": "END OF FILE"}\n')
    assert [r.site_num for r in files.read_aqs_json(spark, str(tmp_path / "a.json")).collect()] == ["0029"]


def test_unknown_sites_are_an_error(spark):
    table = spark.createDataFrame([], "event_id long, datetime timestamp_ntz, site string, aspd double, dir double, teom double, from_lake boolean")
    with pytest.raises(ValueError, match="XX"):
        tables.read_preliminary(table, "2020-01-01", "2020-01-02", ["KE", "XX"], order=["event_id"])


def test_repeated_station_hours_multiply_nothing(spark):
    hour = t("2020-01-01 01:00:00")
    target = spark.createDataFrame([("KE", hour, 5.0, None, None)], "abrv string, datetime timestamp_ntz, pm10 double, ws double, wd double")
    station = spark.createDataFrame([(hour, 2.0, 90.0), (hour, 3.0, 80.0)], "datetime timestamp_ntz, ws double, wd double")
    assert rows(rec.gap_fill_from_reference(target, station)) == [("KE", hour, 5.0, 2.0, 90.0)]
    counts = spark.createDataFrame([(hour, "c", 3e-7)], "datetime timestamp_ntz, csc string, sand_flux double")
    assert [r.sand_flux for r in flux.hourly_flux_with_wind(counts, station).collect()] == [3e-7]
    assert agg.hourly_flux_sum(counts).first().sand_flux == 3e-7


def test_agency_hours_are_whole_rows_and_prune_the_scan(spark, tmp_path):
    def row(hour, code, value, poc=1):
        return ("0029", d("2017-11-05"), hour, code, "x", value, "u", poc)
    schema = schemas.AGENCY_HOURLY.simpleString()[7:-1].replace(":", " ") + ", poc int"
    # 08:00 and 09:00 UTC are the same clock hour; the earlier has no direction
    stacked = spark.createDataFrame([row("08:00", 81102, 10.0, 2), row("08:00", 81102, 30.0, 1), row("09:00", 81102, 20.0), row("09:00", 61104, 200.0)], schema)
    for order in (stacked, stacked.orderBy(F.desc("value"))):
        assert rows(agency.agency_hours(order, "2017-11-05", "2017-11-05").select("pm10", "wd")) == [(30.0, None)]
    sinks.write_stacked_aqs(stacked, f"{tmp_path}/stacked")
    text = plan(agency.agency_hours(spark.read.parquet(f"{tmp_path}/stacked"), "2017-11-05", "2017-11-05"))
    scan = next(x for x in text.splitlines() if "FileScan" in x)
    assert "year" in scan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(date_utc" in scan and "In(site_num" in scan


def test_scratch_can_be_cleared(spark):
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert path.startswith(scratch_folder(spark)) and spark.conf.get("spark.checkpoint.dir") in path
    clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
