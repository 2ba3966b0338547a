"""Versioned tables: refresh by part, withdrawn days, atomic switch."""

import datetime as dtm

import pytest
from pyspark.sql import functions as F

from airmon.sources.published import Conflict, Published, content_state, file_state
from helpers import d, plan, rows

DAYS = [d(f"2024-01-{i:02d}") for i in range(1, 9)]


def readings(spark, days=DAYS, add=0):
    values = [(x, i, float(i * x.day + add)) for x in days for i in range(4)]
    return spark.createDataFrame(values, "date date, site int, value double")


def tagged(df, name="t"):
    return df.withColumn("table", F.lit(name))


def land(df, path):
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def means(df):
    return df.groupBy("date").agg(F.sum("value").alias("total")).select("total", "date")


def test_a_refresh_reads_and_writes_only_changed_days(spark, tmp_path):
    source, store = f"{tmp_path}/source", Published(spark, f"{tmp_path}/store")
    land(readings(spark), source)

    def open_():
        return spark.read.schema("site int, value double, date date").parquet(source)

    built = []

    def build(days):
        part = open_().filter(F.col("date").isin(days))
        built.append((days, {f.split("date=")[1][:10] for f in part.inputFiles()}, plan(part)))
        return means(part)

    assert store.refresh("t", file_state(open_()), build).changed == DAYS
    first = store.version()
    changed = [DAYS[1], DAYS[4], DAYS[6]]
    land(readings(spark, changed, 7), source)
    done = store.refresh("t", file_state(open_()), build)
    assert done.changed == changed and done.withdrawn == [] and done.kept == 5
    days, files, text = built[1]
    assert days == changed and files == {str(x) for x in changed} and "PartitionFilters: [isnotnull(date" in text or "date#" in text
    assert rows(store.read("t", "total double"), "date") == rows(means(open_()), "date")
    # the files of the other days are those of the first run
    before, now = store.entries(first), store.entries()
    assert {k for k in now if now[k].commit != before[k].commit} == {("t", str(x)) for x in changed}
    # nothing new: nothing written
    assert store.refresh("t", file_state(open_()), build).changed == [] and store.version() == 2 and len(built) == 2


def test_content_state_sees_values_not_files(spark):
    a, b = content_state(readings(spark)), content_state(readings(spark).repartition(5).orderBy(F.desc("value")))
    assert a == b and len(a) == 8
    assert {k for k, x in content_state(readings(spark, DAYS[:3]).union(readings(spark, DAYS[3:], 1))).items() if x != a[k]} == set(DAYS[3:])
    twice = readings(spark).union(readings(spark, DAYS[:1]))
    assert {k for k, x in content_state(twice).items() if x != a[k]} == {DAYS[0]}


def test_a_day_gone_from_the_source_is_withdrawn(spark, tmp_path):
    store = Published(spark, str(tmp_path))
    store.refresh("t", content_state(readings(spark)), lambda days: means(readings(spark, days)))
    left = readings(spark, DAYS[2:])
    done = store.refresh("t", content_state(left), lambda days: means(left.filter(F.col("date").isin(days))))
    assert done.withdrawn == DAYS[:2] and done.changed == []
    assert [r.date for r in store.read("t", "total double").orderBy("date").collect()] == DAYS[2:]
    # a day whose rows all fail the build has no rows but is not computed again
    store.refresh("u", content_state(left), lambda days: means(left).filter("false"))
    assert store.read("u", "total double").count() == 0
    assert store.refresh("u", content_state(left), lambda days: pytest.fail("nothing changed")).kept == 6


def test_a_covered_day_without_rows_goes_in_the_same_switch(spark, tmp_path):
    store = Published(spark, str(tmp_path))
    store.write(tagged(readings(spark), "a").union(tagged(readings(spark), "b")), (DAYS[0], DAYS[-1]))
    old = store.version()
    store.write(tagged(readings(spark, DAYS[2:4], 1), "a"), (DAYS[1], DAYS[4]))
    schema = "site int, value double"
    assert sorted({r.date for r in store.read("a", schema).collect()}) == [DAYS[0], *DAYS[2:4], *DAYS[5:]]
    assert sorted({r.date for r in store.read("b", schema).collect()}) == [DAYS[0], *DAYS[5:]]
    # the version before is still whole
    assert store.read("a", schema, version=old).count() == store.read("b", schema, version=old).count() == 32


def test_failed_and_competing_writes_change_nothing(spark, tmp_path):
    store = Published(spark, str(tmp_path))
    store.write(tagged(readings(spark)), (DAYS[0], DAYS[-1]))
    broken = tagged(readings(spark)).withColumn("value", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.write(broken, (DAYS[0], DAYS[-1]))
    with pytest.raises(ValueError, match="outside the covered days"):
        store.write(tagged(readings(spark)), DAYS[:1])
    assert store.version() == 1 and store.read("t", "site int, value double").count() == 32
    # both started from version 1
    late = Published(spark, str(tmp_path))
    late.version = lambda: 1
    store.write(tagged(readings(spark, DAYS[:1])), DAYS[:1])
    with pytest.raises(Conflict):
        late.write(tagged(readings(spark, DAYS[:2])), DAYS[:2])
    assert store.version() == 2
    assert store.vacuum(versions=1) > 0
    assert store.read("t", "site int, value double").count() == 32


def test_an_empty_store(spark, tmp_path):
    store = Published(spark, str(tmp_path))
    assert store.version() == 0 and store.read("t", "value double").columns == ["value", "date"]
    assert store.vacuum() == 0
    store.write(tagged(readings(spark).limit(0)), (dtm.date(2024, 1, 1), dtm.date(2024, 1, 2)))
    assert store.version() == 1 and store.entries() == {}
