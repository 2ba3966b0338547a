from pyspark.sql import functions as F

from airmon.operators import aggregate as agg, direction, exceedance as exc, quality as qc, reshape
from helpers import d, rows, t

D1 = d("2017-01-01")
OBS = "date date, abrv string, pm10 double, wd double, onlake boolean, dunes boolean, valid boolean"


def obs(spark, *triples, site="KE"):
    return spark.createDataFrame([(D1, site, float(p), None, on, None, True) for p, on in triples], OBS)


def test_three_thresholds(spark):
    # mean 149.5: not an exceedance, but in the site table; label 150 is black
    df = obs(spark, (149, True), (150, True))
    assert exc.exceedances(df).count() == 0
    b = exc.site_day_breakdown(df)
    sites = spark.createDataFrame([("KE", "Keeler", 1.0, 2.0)], "abrv string, deployment string, x double, y double")
    assert rows(exc.exceed_site_table(b, sites)) == [(D1, "Keeler", 150.0, 0.0)]
    assert exc.daily_map_labels(b, sites).first().flag_color == "black"
    assert exc.daily_map_labels(exc.site_day_breakdown(obs(spark, (151, True))), sites).first().flag_color == "red"


def test_contribution_leaves_unknown_directions_out(spark):
    df = obs(spark, (100, True), (50, False), (30, None))
    assert rows(agg.onlake_contribution(df)) == [(D1, "KE", 33.0, 17.0, 50.0)]
    assert agg.daily_avg_rounded(df).first().pm10_avg == 60.0
    assert rows(agg.onlake_hour_counts(df)) == [(D1, "KE", 1, 1)]
    hours = agg.hours_in_site_day(df)
    assert {r.n_hours for r in hours.collect()} == {3}


def test_day_without_direction(spark):
    df = obs(spark, (100, None))
    assert rows(agg.onlake_contribution(df)) == [(D1, "KE", None, None, None)]
    assert agg.onlake_contribution(df, strict=True).count() == 0


def test_contribution_fills_one_sided_days(spark):
    assert rows(agg.onlake_contribution(obs(spark, (100, True)))) == [(D1, "KE", 100.0, 0.0, 100.0)]


def test_hours_add_up(spark):
    df = obs(spark, (1, True), (2, False), (3, None), (4, True))
    r = exc.site_day_breakdown(df).first()
    assert r.hrs_onlake + r.hrs_offlake + 1 == df.count()


def test_avg_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(D1, "KE", None)], "date date, abrv string, pm10 double")
    assert rows(agg.avg_pm10(df)) == [(D1, "KE", 0.0, 0)]
    assert agg.daily_contribution(df.withColumn("onlake", F.lit(True))).first().pm10_24 is None


def test_backfill(spark):
    df = spark.createDataFrame([(200.0, 18)], "pm10_24 double, n long")
    assert agg.backfill_24h(df, measures=[("pm10_24", "n")]).first().pm10_24 == 155.0


def test_event_classes(spark):
    df = spark.createDataFrame([(1, 150.0, 150.0), (2, 149.0, 150.0), (3, 150.0, 149.0), (4, 1.0, 1.0)],
                               "k int, pm10_onlake double, pm10_offlake double")
    assert [r["class"] for r in exc.classify_event(df).orderBy("k").collect()] == ["mixed", "offlake", "onlake", "mixed"]


def test_empty_sector_and_dunes(spark):
    cols = "abrv string, pm10_24 double, n long, pm10_onlake double, n_onlake long, pm10_dunes double, n_dunes long, pm10_offlake double, n_offlake long"
    df = spark.createDataFrame([
        ("KE", 200.0, 24, None, 0, 160.0, 2, 200.0, 24), ("OL", 200.0, 24, 200.0, 24, None, 0, None, 0),
        ("KE", 100.0, 24, None, 0, None, 0, None, 0)], cols)
    over = exc.exceeding_days(df)
    got = {r.abrv: r for r in exc.attribute_exceedances(over).collect()}
    assert len(got) == 2
    # dunes flag is judged on 160, the mean before backfill; the backfilled value is (160*2 + 20*22)/24
    assert (got["KE"].dunes_flag, got["KE"].pm10_dunes, got["KE"].n_dunes) == (True, 32.0, 2)
    assert (got["OL"].dunes_flag, got["OL"].pm10_dunes, got["OL"].n_dunes) == (None, None, None)
    assert (got["KE"].pm10_onlake, got["KE"]["class"], got["OL"]["class"]) == (20.0, "offlake", "onlake")


def test_best_source_equals_demix(spark):
    df = spark.createDataFrame(
        [(D1, "KE", 10.0, True), (D1, "KE", 99.0, False), (D1, "OL", 7.0, False), (d("2017-01-02"), "KE", 3.0, True)],
        "date date, abrv string, pm10 double, valid boolean")
    assert rows(agg.best_source_daily_avg(df), "date", "abrv") == rows(
        agg.daily_avg(qc.drop_mixed_preliminary(df)), "date", "abrv")


def test_missing_hours(spark):
    df = spark.createDataFrame([("KE", t(f"2017-01-01 0{h}:00:00")) for h in (1, 2, 3)] + [("OL", t("2017-01-01 01:00:00")), ("OL", t("2017-01-01 05:00:00"))],
                               "abrv string, datetime timestamp_ntz")
    assert {r.abrv: r.missing for r in agg.missing_hours(df).collect()} == {"KE": -1, "OL": 2}


def test_yearly(spark):
    df = spark.createDataFrame([(D1, 10.0, 4.0, 6.0), (d("2017-06-01"), 30.0, 20.0, 1.0)],
                               "date date, pm10_24 double, pm10_onlake double, pm10_offlake double")
    assert rows(agg.yearly_station_summary(df)) == [(2017, 20.0, 30.0, 20.0, 6.0, round(2 / 365, 6))]


def test_rose_counts_are_whole(spark):
    df = spark.createDataFrame([(D1, "KE", float(p), float(w)) for p, w in [(10, 0), (160, 359), (160, 360), (30, 90)]] + [(D1, "KE", None, 3.0), (D1, "KE", 3.0, None)],
                               "date date, abrv string, pm10 double, wd double")
    rose = direction.rose_table(df)
    assert rose.agg(F.sum("hours"), F.round(F.sum("share"), 6)).first() == (4, 1.0)
    assert {(r.sector, r.label, r.hours) for r in rose.collect()} == {(0, "<20", 1), (0, ">=150", 2), (4, "20-50", 1)}


def test_reshape(spark):
    df = spark.createDataFrame([(1, "a", 81102, 5.0), (0, "a", 81102, 4.0), (2, "a", 61104, 90.0)], "o int, k string, code int, value double")
    wide = reshape.pivot_parameters(df, ["k"], "o")
    assert wide.columns == ["k", "pm10", "ws_s", "wd_s", "ws_r", "wd_r"]
    assert rows(reshape.resultant_over_scalar(wide)) == [("a", 4.0, None, 90.0)]
    only = wide.select("k", "wd_s")
    assert reshape.resultant_over_scalar(only).columns == ["k", "ws", "wd"]
    assert reshape.ensure_columns(only, ["wd_s", "x", "k"]).columns == ["wd_s", "x", "k"]
    sheet = spark.createDataFrame([(1, 100, 2.0, 20.0, 3.0)], "date int, hour int, KE_ws double, KE_wd double, OL_ws double")
    assert rows(reshape.unpivot_site_variables(sheet), "abrv") == [(1, 100, "KE", 2.0, 20.0), (1, 100, "OL", 3.0, None)]
    names = reshape.normalise_names(spark.createDataFrame([(1, 2)], "`Site Num` int, `24 Hour GMT` int"))
    assert names.columns == ["site_num", "24_hour_gmt"]


def test_export_has_all_sites_in_order(spark):
    from airmon.dims import EXPORT_SITES

    df = spark.createDataFrame([(D1, t("2017-01-01 01:00:00"), "Keeler", 5.0), (D1, t("2017-01-01 01:00:00"), "Haiwee", 5.0)],
                               "date date, datetime timestamp_ntz, deployment string, pm10 double")
    wide = reshape.pivot_sites(df)
    assert wide.columns == ["date", "datetime", *EXPORT_SITES]
    r = wide.first()
    assert r["Keeler"] == 5.0 and r["Olancha"] is None
