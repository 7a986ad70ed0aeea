"""Windows over stored bars: no exchange, no sort, and filters that reach the files."""

import uuid

import pytest

from barloom.operators import trend, volatility
from barloom.sources import layout
from barloom.sources.bars import bars_week


@pytest.fixture
def stored(spark, data, tmp_path):
    name = f"bars_{uuid.uuid4().hex}"
    yield layout.store_bars(bars_week(spark, data), name, 3, str(tmp_path / "bars"))
    spark.sql(f"DROP TABLE {name}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_need_no_exchange_and_no_sort(spark, data, stored):
    make = lambda b: trend.add_sma(b, "close", 20).withColumn("percent_b", volatility.percent_b("close", 20))
    assert set(layout.files_by_bucket(stored).values()) == {1}
    assert "Exchange" in plan_of(make(bars_week(spark, data)))
    plan = plan_of(make(stored))
    assert "Exchange" not in plan and "Window" in plan
    with layout.presorted(spark):
        df = make(stored)
        plan = plan_of(df)
        assert "Exchange" not in plan and "Sort [" not in plan
        got = sorted(map(tuple, df.select("ticker", "trading_date", "sma").collect()))
    assert got == sorted(map(tuple, make(bars_week(spark, data)).select("ticker", "trading_date", "sma").collect()))
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_filters_reach_the_files(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    part = layout.part_of(stored, ["Brand#11"], "1996-01-01", "1996-06-30")
    plan = plan_of(part)
    assert "PushedFilters: [" in plan and "EqualTo(ticker,Brand#11)" in plan.replace("In(ticker, [Brand#11])", "EqualTo(ticker,Brand#11)") and "GreaterThanOrEqual(trading_date" in plan
    assert "SelectedBucketsCount: 1 out of 3" in plan_of(trend.add_sma(part, "close", 5))
    assert {r["ticker"] for r in part.collect()} <= {"Brand#11"}


def test_refusals(spark, data):
    with pytest.raises(ValueError):
        layout.store_bars(bars_week(spark, data), "never", 0)
