"""Every registered query against its SQL, and the contract of the entry module."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from airmon.catalog.registry import ORACLES, QUERIES

SF = os.environ.get("AIRMON_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_all_operators_have_a_query_and_sql():
    # 107 operators, eleven whole reports and report tables, and fifteen of stored tables, gaps and longer chains
    assert len(QUERIES) == 133
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "no_sites_exceeding"]
    assert df.count() == 30


@pytest.mark.parametrize("sf, hours, demixed, days, exceeding, dates", [
    ("sf0.001", 911, 696, 259, 108, 30),
    ("sf0.01", 5079, 4167, 270, 106, 29),
])
def test_known_counts(spark, sf, hours, demixed, days, exceeding, dates):
    from airmon.catalog.proxy import Proxy
    from airmon.operators import aggregate, exceedance

    p = Proxy(spark, f"/root/testdata/{sf}")
    assert p.hours.count() == hours
    assert p.demixed.count() == demixed
    assert aggregate.daily_avg(p.demixed).count() == days
    over = exceedance.exceedances(p.demixed)
    assert over.count() == exceeding
    assert over.select("date").distinct().count() == dates


def test_results_do_not_depend_on_the_session_zone(spark):
    names = ["sites_exceeding_per_day", "utc_to_local", "drop_nonexistent_local", "hourly_flux_sum", "read_hour_code_csv"]
    con = oracle.connect(SF)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for n in names:
            assert oracle.compare(entry.queries()[n](spark, SF), con, entry.oracle_sql()[n]) == [], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
