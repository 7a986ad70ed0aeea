"""SQL functions, table functions and views give what the Python calls give."""

import pytest

from barloom.operators import structure
from barloom.plans import indicators, surface, workflow
from barloom.sources.bars import bars_week

KEYS = ["provider", "ticker", "trading_date"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_table_functions_equal_the_operators(spark, data):
    names = [*KEYS, "zigzag_price", "zigzag_direction", "zigzag_return", "zigzag_bars"]
    got = workflow.QUERIES["q03_sql_zigzag"](spark, data)
    assert got.columns == names
    assert rows(got) == rows(workflow.rounded(structure.add_zigzag(bars_week(spark, data)).select(*names)))
    assert any(r[3] is not None for r in rows(got))
    assert rows(workflow.QUERIES["q04_sql_backtest"](spark, data)) == rows(workflow.QUERIES["k01_backtest"](spark, data))
    state = spark.sql("SELECT * FROM zigzag_state(TABLE({b}) PARTITION BY (provider, ticker) ORDER BY trading_date)", b=bars_week(spark, data))
    want = structure.add_zigzag_state(bars_week(spark, data)).select(*KEYS, *[f"__z_{n}" for n in structure.STATE])
    assert rows(workflow.rounded(state)) == rows(workflow.rounded(want.toDF(*state.columns)))


def test_scalar_functions_are_expressions(spark, data):
    assert "typical_price" in surface.register(spark)
    df = spark.sql("SELECT typical_price(high, low, close) AS t FROM {b}", b=bars_week(spark, data))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "typical_price" not in plan.split("AS t")[0].replace("typical_price.", "")
    got = spark.sql("SELECT divide_or_null(1D, 0D), divide_or_null(1D, 4D), finite_or_null(double('nan')), percent_b_of(3D, 1D, 5D), body_fraction(1D, 3D, 1D, 2D), valid_bar(1D, null, 1D, 1D), net_return_of(100D, 110D, 0D)").first()
    assert tuple(got) == (None, 0.25, None, 0.5, 0.5, False, 0.1)


def test_bad_calls_are_refused_before_anything_runs(spark, data):
    surface.register(spark)
    b = bars_week(spark, data)
    for call, what in (
        ("zigzag(TABLE({b}) PARTITION BY ticker ORDER BY (trading_date), -1.0D, 10)", "deviation"), ("zigzag(TABLE(SELECT 1 AS x), 5.0D, 10)", "missing"),
        ("ewm(TABLE(SELECT 'p' AS provider, 't' AS ticker, 1 AS trading_date, 1.0D AS x), 2.0D)", "alpha"), ("backtest(TABLE({b}), '{{}}')", "missing"),
    ):
        with pytest.raises(Exception, match=what):
            spark.sql(f"SELECT * FROM {call}", b=b)


def test_views(spark, data):
    names = surface.open_views(spark, bars_week(spark, data), workflow._signals(spark, data), workflow.RULES)
    assert {"bars", "quality_state", "default_features", "backtest_rows"} <= set(names)
    assert spark.sql("SELECT count(*) FROM bars").first()[0] == bars_week(spark, data).count()
    assert "rsi" in " ".join(spark.table("default_features").columns)
    assert spark.sql("SELECT count(DISTINCT run) FROM backtest_rows").first()[0] == 2
    assert indicators.QUERIES
